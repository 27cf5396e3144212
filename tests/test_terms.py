"""Term index, criteria tables and vocabulary tables."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from paths import SF0001
from shortlist.functions import text as tx
from shortlist.functions.scoring import Criteria
from shortlist.operators import rank as rk
from shortlist.operators.criteria import criteria_table, rank_table
from shortlist.operators.embed import embed_corpus, embed_queries
from shortlist.operators.terms import open_index, transient_index, write_batch
from shortlist.functions.vectors import cosine_to
from shortlist.operators.vocabulary import skills_by_vocabulary, vocabulary_matches
from shortlist.plans import catalog as cat
from shortlist.plans import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().toString()


def _scores(df):
    return {r["doc_id"]: r["Semantic_Score"] for r in df.collect()}


def _by_vectors(spark, resumes, text):
    """The same cosines from dense vectors."""
    counted, encoder = embed_corpus(resumes, "Resume_Text")
    q, = embed_queries(encoder, spark, [text])
    return {r["doc_id"]: r["s"] for r in encoder.vectors(counted).select("doc_id", cosine_to("embedding", q).alias("s")).collect()}


def test_postings_give_the_cosines_of_dense_vectors(spark):
    res = cat.resumes(spark, SF0001)
    got = transient_index(res).semantic([cat.CRITERIA.job_description], ["Semantic_Score"])
    assert _scores(got) == _by_vectors(spark, res, cat.CRITERIA.job_description)
    plan = _plan(rk.score_documents(res, cat.CRITERIA))
    assert "aggregate(" not in plan and "zip_with" not in plan


def test_reranking_reads_no_text_and_equals_a_full_ranking(spark, scratch):
    res, path = cat.resumes(spark, SF0001), f"{scratch}/index"
    for b in range(3):
        write_batch(res.where(F.col("doc_id") % 3 == b), path, b)
    index = open_index(spark, path)
    for crit in (cat.CRITERIA, cat.RERANK_CRITERIA):
        again = index.semantic([crit.job_description], ["Semantic_Score"])
        assert all(f.startswith(f"file:{path}/") or f.startswith(f"file://{path}/") for f in again.inputFiles())
        assert "Resume_Text" not in _plan(again) and "documents.parquet" not in _plan(again)
        full, stored = rk.rank_documents(res, crit), rk.rank_index(index, crit)
        assert full.top_records().collect() == stored.top_records().collect()
        assert sorted(full.other_records().collect()) == sorted(stored.other_records().collect())
        assert full.response().first() == stored.response().first()


def test_a_new_batch_is_merged(spark, scratch):
    """Frequencies add up; norms of old batches stay as long as the weights do; a repeated batch replaces itself."""
    import os
    res, path = cat.resumes(spark, SF0001), f"{scratch}/index"
    write_batch(res.where("doc_id % 2 = 0"), path, 0)
    first = open_index(spark, path)
    assert first.n_docs == 100 and _scores(first.semantic(["data"], ["Semantic_Score"])) == _by_vectors(
        spark, res.where("doc_id % 2 = 0"), "data")
    for _ in range(2):
        write_batch(res.where("doc_id % 2 = 1"), path, 1)
    both = open_index(spark, path)
    assert both.n_docs == 200
    want = _by_vectors(spark, res, "Rust and sql and data")
    assert _scores(both.semantic(["Rust and sql and data"], ["Semantic_Score"])) == want
    made = f"{path}/norms/fit={both.fit_name()}/_batch=0/_SUCCESS"
    before = os.stat(made).st_mtime_ns
    assert _scores(open_index(spark, path).semantic(["Rust and sql and data"], ["Semantic_Score"])) == want
    assert os.stat(made).st_mtime_ns == before
    # A batch without its frequencies isn't complete and isn't read.
    res.where("doc_id < 5").withColumn("_doc", F.col("doc_id")).write.parquet(f"{path}/rows/_batch=7")
    assert open_index(spark, path).rows.count() == 200


def test_index_of_odd_texts(spark, scratch):
    rows = [(1, ""), (2, None), (3, "--- !!"), (4, "data data engineer"), (4, "data data engineer"), (5, "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id int, Resume_Text string")
    write_batch(df, f"{scratch}/index")
    index = open_index(spark, f"{scratch}/index")
    got = sorted((r["doc_id"], r["s"] > 0) for r in index.semantic(["Data engineer"], ["s"]).collect())
    assert got == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, False)]
    with pytest.raises(ValueError, match="cannot be empty"):
        index.semantic([" "], ["s"])
    with pytest.raises(ValueError, match="_doc"):
        write_batch(df.withColumn("_doc", F.lit(1)), f"{scratch}/other")
    empty = transient_index(df.limit(0))
    assert empty.semantic(["data"], ["s"]).collect() == []


# --- criteria as rows ---------------------------------------------------------

def test_criteria_table_equals_single_rankings(spark):
    res = cat.resumes(spark, SF0001)
    index = transient_index(res)
    crits = [c for c, _ in cat.MANY_QUERIES] + [
        Criteria("!!", 4, 1, ("python", "Python", " ! sql"), 7), Criteria("Rust", 0, 0, (), 8), Criteria("zzzz qqqq", 300, 3, ("!",), 9)]
    got = {}
    for r in rank_table(index, criteria_table(spark, crits)).collect():
        got.setdefault(r["jd_id"], []).append((r["rank"], tuple(r)[2:]))
    for c in crits:
        want = [(i + 1, tuple(r)) for i, r in enumerate(rk.rank_index(index, c).top_records().collect())]
        assert sorted(got.get(c.jd_id, [])) == want


def test_defaults_and_wrong_criteria(spark):
    schema = "jd_id int, job_description string, top_n int, min_exp int, skills array<string>"
    index = transient_index(cat.resumes(spark, SF0001))
    rows = rank_table(index, spark.createDataFrame([(5, "data", None, None, None)], schema)).collect()
    assert [r["rank"] for r in sorted(rows)] == [1, 2, 3, 4, 5]
    for bad, why in (([], "at least one"), ([(1, "a", 1, 1, None)] * 2, "unique"), ([(None, "a", 1, 1, None)], "unique"),
                     ([(1, "a", -1, 1, None)], "top_n")):
        with pytest.raises(ValueError, match=why):
            rank_table(index, spark.createDataFrame(bad, schema))
    with pytest.raises(Exception, match="cannot be empty"):
        rank_table(index, spark.createDataFrame([(1, " \t", 1, 1, None)], schema)).collect()


def test_ten_thousand_criteria(spark):
    """The plan is as large as for one query; every query has its rows."""
    res = cat.resumes(spark, SF0001).limit(40)
    index = transient_index(res)
    words = ["python", "sql", "rust", "linux", "kafka", "spark", "data", "engineer"]
    many = spark.range(10_000).select(
        F.col("id").cast("int").alias("jd_id"),
        F.concat_ws(" ", *[F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("id") % k + 1).cast("int")) for k in (3, 5, 7)]).alias("job_description"),
        F.lit(2).alias("top_n"), (F.col("id") % 4).cast("int").alias("min_exp"), F.array().cast("array<string>").alias("skills"))
    got = rank_table(index, many)
    assert got.groupBy("jd_id").count().where("count = 2").count() == 10_000
    one = rank_table(index, many.where("jd_id = 1"))
    assert abs(len(_plan(got)) - len(_plan(one))) < 2000
    assert sorted(got.where("jd_id = 1").collect()) == sorted(one.collect())


def test_a_ranking_takes_sums_of_its_own_rows(spark):
    """No shuffle and no join by document; experience patterns run once a row."""
    res = cat.resumes(spark, SF0001)
    scored = rk.score_documents(res, cat.CRITERIA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in scored and "Join" not in scored
    huge = 2 ** 40
    from shortlist.operators.terms import row_sums
    import numpy as np
    rows = spark.createDataFrame([(0, [(0, 3), (2, huge)]), (1, []), (2, [(1, 5)])], "id int, _terms array<struct<bucket:int,n:bigint>>")
    got = {r["id"]: r["s"] for r in rows.select("id", row_sums(np.array([1, 2, 0]), np.array([[1], [10], [2 ** 20 + 1]]))("_terms").alias("s")).collect()}
    assert got == {0: [9, 3 + huge * (2 ** 20 + 1)], 1: [0, 0], 2: [100, 50]}


def test_criteria_in_the_row_equal_criteria_by_postings(spark, monkeypatch):
    from shortlist.operators import criteria as cr
    res, table = cat.resumes(spark, SF0001).where("doc_id < 200"), fx.criteria(spark, SF0001).where("jd_id < 12")
    queries = cr.parsed(table)
    index = transient_index(res)
    plan = cr.scored_pairs(index, queries, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" not in plan.split("Join Inner")[0] and plan.count("Join LeftOuter") <= 1   # the queries' norms only
    here = sorted(map(str, cr.scored_pairs(index, queries, 12).collect()))
    monkeypatch.setattr(cr, "IN_ROW", 0)
    assert here == sorted(map(str, cr.scored_pairs(index, queries, 12).collect())) and len(here) == 12 * index.n_docs


# --- vocabulary tables --------------------------------------------------------

def _contained(rows, entries):
    return sorted((k, e) for k, t in rows if t is not None for e in {e for e in entries if e is not None} if e in t.lower())


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_vocabulary_table(spark, monkeypatch, bound):
    from shortlist.operators import vocabulary as vo
    monkeypatch.setattr(vo, "BROADCAST_ROWS", bound)
    rows = [(1, "Uses PYTHON, C++ and C# — naïve café\nmachine\nlearning"), (2, ""), (3, None), (4, "go"), (5, "😀 emoji 😀😀ab tail"),
            (6, "aaaaaaaa"), (7, "a\n\nb  c"), (8, "ends with sq"), (9, "sql" * 2000)]
    entries = ["python", "c++", "c#", "go", "", None, "python", "machine learning", "café", "naïve", "sql", "q", "😀😀ab", "😀", "aaaa", "aaaaaaaaa",
               "a\n\nb", "Python", "learning", "l", "lsqlsqls", "—", "nothing like this"]
    docs = spark.createDataFrame(rows, "doc_id int, raw_text string")
    vocab = spark.createDataFrame([(e,) for e in entries], "skill string")
    got = vocabulary_matches(docs, vocab, ["doc_id"])
    assert sorted(map(tuple, got.collect())) == _contained(rows, entries)
    lists = {r["doc_id"]: r["skills"] for r in skills_by_vocabulary(docs, vocab, ["doc_id"]).collect()}
    want = {k: [] for k, _ in rows}
    for k, e in _contained(rows, entries):
        want[k].append(e)
    assert lists == {k: sorted(v) for k, v in want.items()}
    assert vocabulary_matches(docs, vocab.limit(0), ["doc_id"]).collect() == []
    assert vocabulary_matches(docs.limit(0), vocab, ["doc_id"]).collect() == []


def test_vocabulary_table_equals_the_literal_scan_without_python(spark):
    docs = fx.resumes_raw(spark, SF0001)
    vocab = spark.createDataFrame([(s,) for s in tx.SKILLS_VOCAB], "skill string")
    found = skills_by_vocabulary(docs, vocab, ["doc_id"])
    assert sorted(map(tuple, found.select("doc_id", "Skills_List").collect())) == sorted(
        map(tuple, docs.select("doc_id", tx.skills_joined("raw_text")).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "PythonUDF") if node in plan]


def test_large_vocabulary(spark):
    """6,000 entries, most of them in no text."""
    docs = fx.documents(spark, SF0001).select("doc_id", "text")
    vocab = fx.vocabulary(spark, SF0001).union(spark.range(6_000).select(F.concat(F.lit("term "), F.hex(F.col("id") * 7919)))).distinct()
    got = sorted(map(tuple, vocabulary_matches(docs, vocab, ["doc_id"], "text").collect()))
    assert got == _contained([(r[0], r[1]) for r in docs.collect()], [r[0] for r in vocab.collect()])


def test_short_vocabulary_is_tested_in_passing(spark):
    """No grams, no shuffle of matches, and each text is tested once (no filter that repeats the test)."""
    found = cat.q_skills_theta_join(spark, SF0001)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert sum(line.count("Contains(") + line.count("contains(") for line in plan.splitlines()) <= len(tx.SKILLS_VOCAB)


@pytest.mark.parametrize("positions", [1 << 21, 64])
def test_vocabulary_scanned_in_the_tasks(spark, monkeypatch, positions):
    """Rows, repeated keys, gram widths, and a plan that neither explodes grams nor shuffles texts."""
    from shortlist.operators import vocabulary as vo
    monkeypatch.setattr(vo, "LITERAL_ROWS", 0)
    rows = [(1, "Uses PYTHON, C++ and C# — naïve café\nmachine\nlearning"), (2, ""), (3, None), (4, "go"), (5, "😀 emoji 😀😀ab tail"),
            (6, "aaaaaaaa"), (7, "a\n\nb  c"), (8, "ends with sq"), (9, "sql" * 200), (10, "l"), (10, "data science and machine learning"), (11, None)]
    entries = ["python", "c++", "c#", "go", "", None, "python", "machine learning", "café", "naïve", "sql", "q", "😀😀ab", "😀", "aaaa", "aaaaaaaaa",
               "a\n\nb", "Python", "learning", "l", "lsqlsqls", "—", "nothing like this", "learnings", "and machine learning", "s sq", "sq", "sql" * 30]
    docs, vocab = spark.createDataFrame(rows, "doc_id int, raw_text string"), spark.createDataFrame([(e,) for e in entries], "skill string")
    want = {k: [] for k, _ in rows}
    for k, e in sorted(set(_contained(rows, entries))):
        want[k].append(e)
    for some in (docs, docs.where("doc_id <> 10")):
        got = skills_by_vocabulary(some, vocab, ["doc_id"])
        keys = {r[0] for r in some.select("doc_id").collect()}
        assert got.count() == len(keys) and {r["doc_id"]: r["skills"] for r in got.collect()} == {k: v for k, v in want.items() if k in keys}
        assert sorted(map(tuple, vocabulary_matches(some, vocab, ["doc_id"]).collect())) == sorted((k, e) for k in keys for e in want[k])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "Exchange" not in plan
    monkeypatch.setattr(vo, "SCAN_POSITIONS", positions)
    import pyarrow as pa
    scanner = vo.Scanner(sorted({e for e in entries if e is not None}))
    texts = pa.array([None, "x", *[t.lower() if t is not None else None for _, t in rows], "y"]).slice(2, len(rows))
    assert scanner.found(texts).to_pylist() == [sorted({e for e in entries if e is not None and t is not None and e in t.lower()}) for _, t in rows]


# --- repeated rows ------------------------------------------------------------

def test_repeated_rows_are_in_the_top_or_in_the_others(spark):
    row = ("R0001", "cv.pdf", "python data work " * 5, "a@b.co", "", 6, "python, sql")
    res = spark.createDataFrame([row] * 5, "Resume_ID string, Source_File string, Resume_Text string, Email string, Phone string, Exp_Years bigint, Skills_List string")
    for n in (0, 1, 3, 7):
        crit = dataclasses.replace(cat.CRITERIA, top_n=n)
        got = rk.rank_documents(res, crit)
        assert (got.top.count(), got.others.count()) == (min(n, 5), 5 - min(n, 5))
        sem = spark.createDataFrame([("R0001", 0.5)], "Resume_ID string, Semantic_Score double")
        by_vector = rk.rank(res, sem, crit, on="Resume_ID")
        assert (by_vector.top.count(), by_vector.others.count()) == (min(n, 5), 5 - min(n, 5))
