"""Distributions and classification metrics against plain numpy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.operators import metrics as mt


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    xs = np.round(rng.uniform(-0.3, 1.0, 3000), 4)
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    got = mt.histogram(df, "v", 20).orderBy("bin").collect()
    counts, edges = np.histogram(xs, bins=20)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["bin_lo"] for r in got] == edges[:-1].tolist()
    assert got[-1]["bin_hi"] == edges[-1]
    assert sum(r["count"] for r in got) == len(xs)


def test_histogram_single_value_widens(spark):
    df = spark.createDataFrame([(3,), (3,)], "v bigint")
    got = mt.histogram(df, "v", 15).orderBy("bin").collect()
    counts, edges = np.histogram(np.array([3, 3]), bins=15)
    assert [r["count"] for r in got] == counts.tolist()
    assert got[0]["bin_lo"] == edges[0] == 2.5


def test_histogram_integer_values(spark):
    ys = [0, 1, 1, 2, 5, 7, 13, 13, 13, 4]
    df = spark.createDataFrame([(y,) for y in ys], "v bigint")
    got = mt.histogram(df, "v", 15).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram(np.array(ys), bins=15)[0].tolist()


def test_density_matches_gaussian_kde(spark):
    rng = np.random.default_rng(5)
    xs = np.round(rng.normal(0.3, 0.1, 500), 4)
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    got = mt.density_curve(df, "v").orderBy("point").collect()
    n = len(xs)
    h = xs.std(ddof=1) * n ** (-0.2)
    grid = np.linspace(xs.min(), xs.max(), 200)
    pdf = np.exp(-0.5 * ((grid[:, None] - xs[None, :]) / h) ** 2).sum(axis=1) / (n * h * math.sqrt(2 * math.pi))
    expected = pdf * n * (xs.max() - xs.min()) / 20
    assert len(got) == 200
    assert np.allclose([r["density"] for r in got], expected, atol=1e-5)
    assert np.allclose([r["x"] for r in got], grid, atol=1e-6)


def test_density_empty_for_constant(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "v double")
    assert mt.density_curve(df, "v").count() == 0


def _pairs(spark, pairs):
    return spark.createDataFrame(pairs, "a string, p string")


def test_confusion_and_per_class(spark):
    pairs = [("High", "High"), ("High", "Low"), ("Medium", "Medium"), ("Low", "Low"),
             ("Low", "Medium"), ("Low", "Low")]
    df = _pairs(spark, pairs)
    cm = {r["actual"]: (r["High"], r["Medium"], r["Low"]) for r in mt.confusion_matrix(df, "a", "p").collect()}
    assert cm == {"High": (1, 0, 1), "Medium": (0, 1, 0), "Low": (0, 1, 2)}
    per = {r["label"]: r for r in mt.per_class_metrics(df, "a", "p").collect()}
    assert per["High"]["precision"] == 1.0 and per["High"]["recall"] == 0.5
    assert per["Low"]["precision"] == pytest.approx(2 / 3)
    assert per["Low"]["f1"] == pytest.approx(2 * 2 / (3 + 3))
    assert per["Medium"]["support"] == 1


def test_absent_class_counts_zero_in_macro(spark):
    df = _pairs(spark, [("High", "High"), ("High", "High")])
    m = mt.classification_metrics(df, "a", "p").first()
    assert m["accuracy"] == 1.0
    assert m["macro_precision"] == m["macro_recall"] == m["macro_f1"] == 0.3333


def test_undefined_ratios_are_zero(spark):
    df = _pairs(spark, [("High", "Low")])
    per = {r["label"]: r for r in mt.per_class_metrics(df, "a", "p").collect()}
    assert per["Medium"]["precision"] == 0.0 and per["Medium"]["f1"] == 0.0
    assert per["High"]["recall"] == 0.0


def test_metrics_on_integer_labels(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "a int, p int")
    m = mt.classification_metrics(df, "a", "p", (1, 0)).first()
    assert m["accuracy"] == 0.75
    cm = mt.confusion_matrix(df, "a", "p", (1, 0)).collect()
    assert [(r["actual"], r["1"], r["0"]) for r in cm] == [("1", 1, 1), ("0", 0, 2)]
