"""Skew-safe ordinals, embeddings and the embedding cache."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF0001
from shortlist.functions.vectors import cosine, cosine_to, l2_normalize
from shortlist.operators import embed as em
from shortlist.operators.ordinal import ordinal_within


@pytest.fixture
def many_parts(spark):
    """Small sort parts that are not put together again, so groups span several."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _same_as_row_number(df):
    got = ordinal_within(df, "g", "k").select("g", "k", "idx")
    expect = df.select("g", "k", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long").alias("idx"))
    key = lambda r: (r["g"] or "", r["k"], r["idx"])
    assert sorted(map(key, got.collect())) == sorted(map(key, expect.collect()))


def test_ordinal_matches_row_number_with_hot_group(spark, many_parts):
    rows = [("hot", i) for i in range(0, 3000, 3)] + [("cold", i) for i in range(50)] + [(None, 7), (None, 2)]
    _same_as_row_number(spark.createDataFrame(rows, "g string, k long"))
    _same_as_row_number(spark.createDataFrame([], "g string, k long"))


def test_ordinal_of_keys_clustered_at_many_scales(spark, many_parts):
    """Half of the rows lie at each smaller scale: parts stay even, whatever the spread of keys."""
    keys = sorted({(1 << 60) >> s | i for s in range(0, 60, 6) for i in range(200)})
    df = spark.createDataFrame([("hot", k) for k in keys] + [("cold", 3)], "g string, k long")
    _same_as_row_number(df)
    from shortlist.operators.ordinal import _sorted
    sizes = [r["count"] for r in _sorted(df, F.col("g").asc(), F.col("k").asc()).groupBy("_part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < len(keys) / 2


def test_ordinal_reads_its_input_only_to_sort_it(spark):
    """The plan after the sort scans the stored slim table, twice at most, and never the input."""
    df = spark.read.parquet(f"{SF0001}/documents.parquet").select("source", "doc_id")
    plan = ordinal_within(df, "source", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    leaves = [x for x in plan.splitlines() if "Relation" in x]
    assert 1 <= len(leaves) <= 2 and all("_at" in x for x in leaves)


def test_positions_follow_the_order(spark, many_parts):
    from shortlist.operators.ordinal import with_position
    df = spark.createDataFrame([(i * 7919 % 500, i) for i in range(500)], "v long, extra long")
    got = with_position(df, F.desc("v")).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 501))
    assert [r["v"] for r in got] == list(range(499, -1, -1))
    assert with_position(df.where("v < 0"), F.desc("v")).collect() == []


def test_cosine_forms_agree(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=16).tolist()
    vs = rng.normal(size=(50, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)] + [(99, [0.0] * 16)],
                               "id int, v array<float>")
    out = df.select("id", cosine_to("v", q).alias("a"),
                    cosine("v", F.array(*[F.lit(x) for x in q])).alias("b")).collect()
    for r in out:
        assert r["a"] == r["b"]
    assert [r["a"] for r in out if r["id"] == 99] == [0.0]
    vd = vs.astype(np.float64)
    expect = vd @ np.array(q) / (np.linalg.norm(vd, axis=1) * np.linalg.norm(q))
    assert np.allclose([r["a"] for r in out if r["id"] != 99], expect, atol=1e-12)


def test_l2_normalize_takes_the_norm_once(spark):
    """A vector of 20,000 components: with the norm taken again for each, 4 * 10^8 steps a row."""
    import time
    df = spark.range(16).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: (i + F.col("id")).cast("double")).alias("v")).persist()
    df.count()
    start = time.time()
    got = df.select(F.sum(F.aggregate(l2_normalize("v"), F.lit(0.0), lambda a, x: a + x * x)).alias("s")).first()["s"]
    assert abs(got - 16) < 1e-9 and time.time() - start < 20
    from shortlist.operators import embed as em
    docs = spark.createDataFrame([(1, "rust and linux, linux"), (2, ""), (3, None), (4, "sql")], "id int, t string")
    out = em.embed_hashed(docs, "t", 64)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, (counted, model) = {r["id"]: r["embedding"] for r in out.collect()}, em.embed_corpus(docs, "t", 64)
    assert got == {r["id"]: r["u"] for r in model.vectors(counted).select("id", l2_normalize("embedding").alias("u")).collect()}


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(l2_normalize("v")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def _char_encoder():
    def encode(texts):
        out = np.zeros((len(texts), 8))
        for i, t in enumerate(texts):
            for ch in t:
                out[i, ord(ch) % 8] += 1.0
        return out
    return encode


def test_embed_with_pluggable_encoder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "hello world"), (3, "")], "id int, t string")
    got = {r["id"]: r["embedding"] for r in em.embed(df, "t", _char_encoder).collect()}
    assert len(got[1]) == 8
    assert abs(sum(x * x for x in got[2]) - 1.0) < 1e-5
    assert got[3] == [0.0] * 8


def test_hashed_embedding_and_query(spark):
    docs = spark.createDataFrame([(1, "python spark sql"), (2, "rust c++ linux"), (3, "python pandas")],
                                 "id int, t string")
    model = em.hashed_encoder_model(docs, "t", dim=64)
    vecs = em.apply_hashed(model, docs)
    q = em.embed_query(model, spark, "python")
    scores = {r["id"]: r["s"] for r in vecs.select("id", cosine_to("embedding", q).alias("s")).collect()}
    assert scores[1] > scores[2] and scores[3] > scores[2]


def test_encoders_with_other_settings_are_kept_apart(spark):
    def factory(scale):
        def make():
            return lambda texts: np.array([[scale * len(t), 1.0] for t in texts])
        return make
    df = spark.createDataFrame([("abc",)], "t string")
    got = [em.embed(df, "t", factory(s), normalize=False).first()["embedding"][0] for s in (1.0, 2.0)]
    assert got == [3.0, 6.0]


def test_hashed_vectors_are_whole_numbers(spark):
    docs = spark.createDataFrame([("a a b",), ("a",), ("",), (None,)], "t string")
    model = em.hashed_encoder_model(docs, "t", dim=4096)
    vectors = [r["embedding"] for r in em.apply_hashed(model, docs).collect()]
    assert sorted(x for x in vectors[0] if x) == [3.0, 4.0]       # b: 4 // 1 has 3 bits; a: twice 4 // 2, 2 bits
    assert [x for x in vectors[1] if x] == [2.0] and not any(vectors[2]) and not any(vectors[3])


def test_cache_only_embeds_new_texts(spark, scratch):
    path = f"{scratch}/cache"
    calls = []

    def encode(df, col):
        calls.append(df.count())
        return em.embed(df, col, _char_encoder)

    a = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha")], "id int, t string")
    cache = em.update_cache(a, path, "t", encode)
    assert cache.count() == 2 and calls == [2]
    b = spark.createDataFrame([(4, "beta"), (5, "gamma")], "id int, t string")
    assert [r["id"] for r in em.cache_misses(b, cache, "t", "id", cache_hash_col="text_hash").collect()] == [5]
    cache = em.update_cache(b, path, "t", encode)
    assert cache.count() == 3 and calls == [2, 1]
    vecs = em.lookup_vectors(a.unionByName(b), cache, "t", "id")
    assert vecs.count() == 5


def test_hashed_embeddings_on_documents(spark):
    from shortlist.plans.catalog import q_embed_documents
    out = q_embed_documents(spark, SF0001)
    rows = out.collect()
    assert len(rows) == 200
    assert all(len(r["embedding"]) == em.DEFAULT_DIM for r in rows)


def test_cosine_to_sql_and_column_forms_are_identical(spark):
    rng = np.random.default_rng(7)
    q = rng.normal(size=24).tolist() + [1e-300, -2.5e-7, 0.0, -0.0, 123456.789]
    dim = len(q)
    vs = rng.normal(size=(40, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)] + [(99, [0.0] * dim)],
                               "id int, v array<float>")
    out = df.select("id", cosine_to("v", q).alias("a"), cosine_to(F.col("v"), q).alias("b")).collect()
    assert len(out) == 41
    for r in out:
        assert r["a"] == r["b"]
    bad = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<float>")
    with pytest.raises(Exception, match="dimension differs"):
        bad.select(cosine_to("v", q)).collect()


def test_extract_numbered_numbers_before_the_gate(spark):
    """Ordinals count every member of the group, including ones the length gate drops."""
    from shortlist.operators.extract import extract_numbered
    body = "Contact a@b.cd, 5 years of experience with Python and SQL " * 2
    rows = [("z1", 1, "z1/1.txt", body), ("z1", 2, "z1/2.txt", "short"), ("z1", 5, "z1/5.txt", body),
            (None, 3, "3.txt", body), ("z2", 4, "z2/4.txt", body)]
    df = spark.createDataFrame(rows, "archive string, doc_id long, name string, raw_text string")
    got = sorted((r["archive"] or "", r["Resume_ID"], r["Source_File"], r["Exp_Years"])
                 for r in extract_numbered(df, "archive", "doc_id").collect())
    assert got == [("", "R0001", "3.txt", 5), ("z1", "R0001", "1.txt", 5),
                   ("z1", "R0003", "5.txt", 5), ("z2", "R0001", "4.txt", 5)]


@pytest.mark.parametrize("dim", [2, 384, 1024, 3072])
def test_cosine_to_any_dimension(spark, dim):
    q = [((i * 7) % 13 - 6) / 3 for i in range(dim)]
    v = [((i * 5) % 11 - 5) / 7 for i in range(dim)]
    df = spark.createDataFrame([(v,), ([0.0] * dim,)], "v array<float>")
    got = [r.s for r in df.select(cosine_to("v", q).alias("s")).collect()]
    v32 = [float(__import__("numpy").float32(x)) for x in v]
    want = sum(a * b for a, b in zip(v32, q)) / (sum(a * a for a in v32) * sum(b * b for b in q)) ** 0.5
    assert abs(got[0] - want) < 1e-12 and got[1] == 0.0
    from shortlist.operators.rank import semantic_scores_many
    ids = df.withColumn("vec_id", F.lit(1))
    assert semantic_scores_many(ids, [q, q], vector_col="v").count() == 2
    with pytest.raises(Exception, match="dimension"):
        semantic_scores_many(ids, [q + [1.0]], vector_col="v").collect()


def test_ordinals_of_keys_that_span_all_longs(spark):
    from shortlist.operators.ordinal import ordinal_within
    keys = [-2**63, -2**62, -1, 0, 1, 5, 2**62, 2**63 - 1]
    df = spark.createDataFrame([("g", k) for k in keys], "g string, k long")
    out = ordinal_within(df, "g", "k")
    assert dict(out.dtypes)["idx"] == "bigint"
    assert [r["k"] for r in out.orderBy("idx").collect()] == keys
