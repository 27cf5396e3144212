"""Near-duplicates by the LSH forest against all pairs."""

import random

import brute
import numpy as np
import pytest
from test_operators import docs, empty, stored, texts  # noqa: F401 (fixtures)


def _near(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k:k + 1] = rng.choice([[], [f"new{rng.randrange(9999)}"], [w[k], "more"]])
    return " ".join(w)


def _corpus(seed=2, families=25, most=14):
    rng = random.Random(seed)
    out = [*texts(), "Same Case Here now", "same case here NOW", "a b", "A  b", "b a", "a"]
    for _ in range(families):
        base = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 40, 150, 700])))
        size = len(base.split())
        out += [_near(rng, base, rng.randrange(0, max(2, size // 25))) for _ in range(rng.randrange(1, most))]
        out += [base] * rng.randrange(3)
    rng.shuffle(out)
    return out


def _check(got, rows):
    want = brute.jaccard_components(rows)
    have = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert have == sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, want)), key=str)


def test_near_duplicates(spark, scratch):
    from shortlist.llm.minhash import near_duplicates
    rows = list(enumerate(_corpus()))
    rows += [(3, rows[3][1]), (None, rows[10][1]), (None, "an id that is null and a text of its own")]
    df = stored(spark, scratch, [(i, t, 7, "x", 5) for i, t in rows], "doc_id bigint, text string, rid int, labels string, n int")
    _check(near_duplicates(df).collect(), rows)


def test_large_regions_and_groups(spark, scratch, monkeypatch):
    """One family of near copies, most pairs of it below the threshold, with tiny regions, blocks and salts."""
    from shortlist.llm import minhash
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = list(enumerate([_near(rng, base, rng.randrange(2, 9)) for _ in range(150)] + [base] * 40 + _corpus(4, 6, 5)))
    for name, value in (("REGION", 6), ("BLOCK", 16), ("HOT", 7), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(minhash.candidates, "__defaults__", (6, 16))
    _check(minhash.near_duplicates(stored(spark, scratch, rows, "doc_id bigint, text string")).collect(), rows)


def test_edge_tables(spark, docs, empty):  # noqa: F811
    from shortlist.llm.minhash import near_duplicates
    assert near_duplicates(docs).count() == docs.count()
    assert near_duplicates(empty).collect() == []


@pytest.mark.parametrize("k", [2, 5, 40, 300])
def test_overlaps(k):
    from shortlist.llm.minhash import overlaps
    rng = np.random.default_rng(k)
    sets = [np.unique(np.concatenate([rng.integers(0, 400, 60), np.arange(1000, 1000 + rng.integers(0, 30))])).astype(np.uint64) for _ in range(k)]
    got = overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(k) for j in range(0, k, 7))


def test_trees_keep_the_chance_of_a_miss():
    from shortlist.llm.minhash import DEPTHS, MISS, trees_for
    for depth in DEPTHS:
        assert (1 - 0.85 ** depth) ** trees_for(depth, 85) <= MISS


def test_query_and_its_sql(spark, scratch):
    import duckdb
    from shortlist.llm.queries import ORACLE_SQL, op11_minhash
    rows = list(enumerate(_corpus(6, 15, 9)))
    stored(spark, scratch, rows, "doc_id bigint, text string", "documents.parquet")
    got = op11_minhash(spark, scratch)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = sorted((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute.jaccard_components(rows)))
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{scratch}/documents.parquet/*.parquet'")
    assert sorted(con.sql(ORACLE_SQL["op11_minhash"]).fetchall()) == want
