"""Golden micro-cases for the scoring rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.functions import scoring as sc
from shortlist.functions import text as tx
from shortlist.operators import rank as rk


@pytest.mark.parametrize("years,min_exp,expected", [
    (0, 0, 0.1), (1, 2, 0.0), (2, 2, 0.1), (5, 2, 0.4), (11, 2, 1.0), (30, 2, 1.0)])
def test_experience_score(spark, years, min_exp, expected):
    df = spark.createDataFrame([(years,)], "y bigint")
    assert df.select(sc.experience_score("y", min_exp)).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize("skills_list,score,passes", [
    ("Python, SQL", 1.0, True), ("python", 0.5, True), ("sql", 0.0, False), ("", 0.0, False)])
def test_skills_score_with_mandatory(spark, skills_list, score, passes):
    df = spark.createDataFrame([(skills_list,)], "s string")
    cand = tx.split_skill_list("s")
    row = df.select(sc.skills_score(cand, ["python", "sql"], ["python"]).alias("a"),
                    sc.passes_mandatory(cand, ["python"]).alias("b")).first()
    assert (row["a"], row["b"]) == (score, passes)


def test_skills_score_nothing_required(spark):
    df = spark.createDataFrame([("",), ("rust",)], "s string")
    got = df.select(sc.skills_score(tx.split_skill_list("s"), [], [])).collect()
    assert [r[0] for r in got] == [1.0, 1.0]


def test_bare_bang_blocks_everyone(spark):
    req, mand = sc.split_skills(["!"])
    assert (req, mand) == ([""], [""])
    df = spark.createDataFrame([("python",), ("",)], "s string")
    got = df.select(sc.passes_mandatory(tx.split_skill_list("s"), mand)).collect()
    assert [r[0] for r in got] == [False, False]


def test_split_skills_driver_side():
    assert sc.split_skills(["!python", " sql ", "! go"]) == (["python", "sql", "go"], ["python", "go"])


@pytest.mark.parametrize("x,expected", [
    (0.12345, 0.1234), (0.00005, 0.0), (0.00015, 0.0001), (0.00025, 0.0002),
    (0.62505, 0.625), (0.45675, 0.4568)])
def test_rounding_matches_numpy(spark, x, expected):
    df = spark.createDataFrame([(x,)], "x double")
    got = df.select(sc.round_half_even(F.col("x"), 4)).first()[0]
    assert got == expected == float(np.round(x, 4))


def test_rounding_random_values_equal_numpy(spark):
    rng = np.random.default_rng(7)
    xs = [float(v) for v in rng.uniform(-1, 1, 2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(sc.round_half_even(F.col("x"), 4)).collect()]
    assert got == [float(v) for v in np.round(np.array(xs), 4)]


@pytest.mark.parametrize("scores,low,high", [
    ([.1, .2, .3, .4], .22, .325), ([.5, .5, .5], .5, .5), ([.9], .9, .9),
    ([.1234, .2345, .3456, .4567, .5678], .30116, .4567)])
def test_thresholds(spark, scores, low, high):
    df = spark.createDataFrame([(s,) for s in scores], "Final_Score double")
    row = rk.thresholds(df).first()
    assert (row["low"], row["high"]) == (low, high)
    assert row["low"] == round(float(np.quantile(scores, 0.4)), 6)


@pytest.mark.parametrize("score,expected", [(.4, "High"), (.325, "High"), (.3, "Medium"),
                                             (.22, "Medium"), (.1, "Low")])
def test_label(spark, score, expected):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(sc.label("s", .22, .325)).first()[0] == expected


def test_reason_full_and_baseline(spark):
    df = spark.createDataFrame([(0.8, 3, "sql"), (0.2, 0, "rust"), (0.6, 0, "")],
                               "sem double, y bigint, s string")
    got = [r[0] for r in df.select(sc.reason("sem", "y", "s", ["SQL", "go"])).collect()]
    assert got[0] == ("Selected because of: strong semantic alignment with the job description; "
                      "3 years of relevant experience; matches skills: SQL")
    assert got[1] == "Baseline match"
    assert got[2] == "Selected because of: moderate semantic alignment"


def test_reason_keeps_request_order_duplicates_and_first_five(spark):
    df = spark.createDataFrame([(0.0, 0, "a, b, c, d, e, f")], "sem double, y bigint, s string")
    got = df.select(sc.reason("sem", "y", "s", ["F", "a", "a", "b", "c", "d"])).first()[0]
    assert got == "Selected because of: matches skills: F, a, a, b, c"


def test_display_helpers(spark):
    df = spark.createDataFrame([(0.98765, "score_distribution")], "r double, n string")
    row = df.select(sc.percent_text("r").alias("p"), sc.title_text("n").alias("t")).first()
    assert (row["p"], row["t"]) == ("98.8%", "Score Distribution")
