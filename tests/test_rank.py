"""Ranking: expected results on the driver tables, the split rule, and properties."""

from pyspark.sql import functions as F

from paths import SF0001, SF001
from shortlist.functions.scoring import Criteria
from shortlist.operators import rank as rk
from shortlist.plans import catalog as cat
from shortlist.plans import fixtures as fx


def test_minimum_slice_sf0001_expected(spark):
    result = cat.stored_ranking(spark, SF0001)
    summary = result.summary.first()
    assert (summary["total"], summary["eligible"], summary["returned_top"]) == (200, 85, 5)
    thr = result.thresholds.first()
    assert (thr["low"], thr["high"]) == (0.15246, 0.2802)
    counts = {r["Label"]: r["n"] for r in result.scored.groupBy("Label").agg(F.count("*").alias("n")).collect()}
    assert counts == {"High": 50, "Medium": 70, "Low": 80}
    top = [(r["Resume_ID"], r["Final_Score"]) for r in result.top_records().collect()]
    assert top == [("R0012", 0.6211), ("R0192", 0.4762), ("R0026", 0.473),
                   ("R0108", 0.4525), ("R0066", 0.4379)]


def _toy(spark):
    rows = [("1", True, .9), ("2", False, .95), ("3", True, .5), ("4", True, .7), ("5", False, .1)]
    df = spark.createDataFrame(rows, "Resume_ID string, Eligible boolean, Final_Score double")
    return df.withColumn("Source_File", F.lit("a.zip"))


def test_split_rule(spark):
    df = _toy(spark)
    top = [r["Resume_ID"] for r in rk.top_candidates(df, 2).collect()]
    assert top == ["1", "4"]
    others = [r["Resume_ID"] for r in rk.others_ordered(df, 2).collect()]
    assert others == ["3", "2", "5"]
    s = rk.summary(df, 2).first()
    assert (s["total"], s["eligible"], s["returned_top"]) == (5, 3, 2)


def test_split_when_fewer_eligible_than_n(spark):
    df = _toy(spark)
    assert [r["Resume_ID"] for r in rk.top_candidates(df, 10).collect()] == ["1", "4", "3"]
    assert sorted(r["Resume_ID"] for r in rk.others(df, 10).collect()) == ["2", "5"]
    assert rk.summary(df, 10).first()["returned_top"] == 3
    assert rk.others(df, 0).count() == 5


def test_ties_break_by_id(spark):
    rows = [("b", True, .5), ("a", True, .5), ("c", True, .5)]
    df = spark.createDataFrame(rows, "Resume_ID string, Eligible boolean, Final_Score double") \
        .withColumn("Source_File", F.lit("x"))
    assert [r[0] for r in rk.top_candidates(df, 2).select("Resume_ID").collect()] == ["a", "b"]
    assert [r[0] for r in rk.others(df, 2).select("Resume_ID").collect()] == ["c"]


def test_split_properties_sf001(spark):
    result = cat.ranking(spark, SF001)
    scored = result.scored
    top = result.top.select("Resume_ID", "Eligible", "Final_Score").collect()
    rest = result.others.select("Resume_ID", "Eligible", "Final_Score").collect()
    all_ids = {r[0] for r in scored.select("Resume_ID").collect()}
    top_ids, rest_ids = {r[0] for r in top}, {r[0] for r in rest}
    assert top_ids | rest_ids == all_ids and not (top_ids & rest_ids)
    assert all(r["Eligible"] for r in top)
    eligible_rest = [r["Final_Score"] for r in rest if r["Eligible"]]
    assert min(r["Final_Score"] for r in top) >= max(eligible_rest)
    # Label is monotone in score.
    order = {"Low": 0, "Medium": 1, "High": 2}
    labelled = sorted((r["Final_Score"], order[r["Label"]]) for r in scored.select("Final_Score", "Label").collect())
    assert all(a[1] <= b[1] for a, b in zip(labelled, labelled[1:]))


def test_adding_a_mandatory_skill_never_grows_eligible(spark):
    base = Criteria(top_n=5, min_exp=2, skills=("python", "sql"))
    stricter = Criteria(top_n=5, min_exp=2, skills=("!python", "sql"))
    n1 = cat.stored_ranking(spark, SF0001, base).summary.first()["eligible"]
    n2 = cat.stored_ranking(spark, SF0001, stricter).summary.first()["eligible"]
    assert n2 <= n1


def test_result_independent_of_partitioning(spark):
    a = cat.stored_ranking(spark, SF0001).top_records().collect()
    res = cat.resumes(spark, SF0001).repartition(7)
    b = rk.rank(res, cat.semantic(spark, SF0001).repartition(3), cat.CRITERIA).top_records().collect()
    assert a == b


def test_rank_many_matches_single_queries_and_cuts_early(spark):
    queries = [(c, fx.query_vector(spark, SF0001, vid)) for c, vid in cat.MANY_QUERIES]
    many = rk.rank_many(cat.resumes(spark, SF0001), fx.embeddings(spark, SF0001), queries)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan
    got = {}
    for r in many.collect():
        got.setdefault(r["jd_id"], []).append((r["rank"], r["Resume_ID"], r["Final_Score"], r["Label"]))
    for crit, vid in cat.MANY_QUERIES:
        sem = rk.semantic_scores(fx.embeddings(spark, SF0001), fx.query_vector(spark, SF0001, vid),
                                 out_key="doc_id")
        single = rk.rank(cat.resumes(spark, SF0001), sem, crit).top_records().collect()
        expect = [(i + 1, r["Resume_ID"], r["Final_Score"], r["Label"]) for i, r in enumerate(single)]
        assert sorted(got.get(crit.jd_id, [])) == expect


def test_top_plan_is_take_ordered(spark):
    result = cat.stored_ranking(spark, SF0001)
    plan = result.top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_response_document(spark):
    row = cat.stored_ranking(spark, SF0001).response().first()
    assert row["summary"]["total"] == 200
    assert row["metrics"]["accuracy"] == 1.0
    assert [r["Resume_ID"] for r in row["top_candidates"]] == ["R0012", "R0192", "R0026", "R0108", "R0066"]


def test_response_as_json(spark):
    import json
    result = cat.stored_ranking(spark, SF0001)
    doc = json.loads(result.response_json().first()["json"])
    assert list(doc) == ["summary", "thresholds", "metrics", "top_candidates"]
    assert doc["summary"] == {"total": result.scored.count(), "eligible": 85, "returned_top": 5}
    assert [r["Resume_ID"] for r in doc["top_candidates"]] == [
        r["Resume_ID"] for r in result.top.orderBy(*rk.ranking_order(result.top)).collect()]


def test_candidate_cards(spark):
    cards = rk.candidate_cards(cat.stored_ranking(spark, SF0001).top).collect()
    assert [c["rank"] for c in cards] == [1, 2, 3, 4, 5]
    assert cards[0]["score"] == "0.621"
    assert all(len(c["skills"]) <= 6 for c in cards)


def test_empty_input_guard(spark):
    import pytest
    res = cat.resumes(spark, SF0001).where("doc_id < 0")
    with pytest.raises(ValueError):
        rk.rank(res, cat.semantic(spark, SF0001), cat.CRITERIA, require_rows=True)
    assert rk.rank(res, cat.semantic(spark, SF0001), cat.CRITERIA).summary.first()["total"] == 0


def test_ranked_rows_observation(spark):
    from pyspark.sql import Observation
    obs = Observation("rank")
    rk.rank(cat.resumes(spark, SF0001), cat.semantic(spark, SF0001), cat.CRITERIA, observation=obs)
    assert obs.get["ranked_rows"] == 200


def test_bucketed_tables_join_without_shuffle(spark, scratch):
    from shortlist.sources.tables import write_bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        res = write_bucketed(cat.resumes(spark, SF0001).drop("Resume_Text"), "bk_resumes", "doc_id", 4)
        sem = write_bucketed(cat.semantic(spark, SF0001), "bk_semantic", "doc_id", 4)
        scored = rk.score(res, sem, cat.CRITERIA)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        top = rk.top_candidates(rk.with_labels(scored), 5).select("Resume_ID").collect()
        assert [r[0] for r in top] == ["R0012", "R0192", "R0026", "R0108", "R0066"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bk_resumes")
        spark.sql("DROP TABLE IF EXISTS bk_semantic")


def test_top_and_others_cover_equal_ids_over_archives(spark):
    """Two archives number their members alike: top and others still hold every row once."""
    rows = [(a, "R0001", "cv.pdf", 0.9, True) for a in ("x.zip", "y.zip")] + [("z.zip", "R0001", "cv.pdf", 0.2, False)]
    df = spark.createDataFrame(rows, "archive string, Resume_ID string, Source_File string, Final_Score double, Eligible boolean")
    for n in (0, 1, 2, 3):
        assert rk.top_candidates(df, n).count() + rk.others(df, n).count() == 3


def test_ranking_follows_the_job_description_over_every_document(spark):
    import dataclasses

    import pytest
    res = cat.resumes(spark, SF001)
    result = rk.rank_documents(res, cat.CRITERIA)
    assert result.summary.first()["total"] == res.count() == result.scored.count() == 1000
    other = dataclasses.replace(cat.CRITERIA, job_description="Rust and Linux systems work")
    a = {r["doc_id"]: r["Semantic_Score"] for r in result.scored.collect()}
    b = {r["doc_id"]: r["Semantic_Score"] for r in rk.score_documents(res, other).collect()}
    assert a.keys() == b.keys() and a != b
    with pytest.raises(ValueError, match="cannot be empty"):
        rk.rank_documents(res, dataclasses.replace(cat.CRITERIA, job_description="  "))


def test_ranking_by_description_of_an_empty_table(spark):
    res = cat.resumes(spark, SF0001).limit(0)
    assert rk.rank_documents(res, cat.CRITERIA).summary.first()["total"] == 0
