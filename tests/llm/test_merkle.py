"""The Merkle manifest against its definition."""

import random

import brute
import pytest
from pyspark.sql import functions as F
from test_operators import stored, texts

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _rows(groups, seed=1):
    rng, out = random.Random(seed), []
    for name, n in groups:
        out += [(name, rng.choice([None, "de", "fr"]), rng.choice([None, 5, 70]), rng.choice([*texts()[:12], "a\nb", "\n"])) for _ in range(n)]
    rng.shuffle(out)
    rows = [(i * 7, *r) for i, r in enumerate(out)]
    return [*rows, *rows[:3], (rows[0][0], *rows[1][1:]), (None, *rows[0][1:]), (2 ** 62 + 1, *rows[0][1:])]


def _same(got, rows):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.merkle(rows).values()))


@pytest.mark.parametrize("levels,groups", [
    (1, [(None, 1), ("", 2), ("é", 40), ("z", 3), ("a", 10), ("b", 1)]),
    (2, [("hot", 90), *[(f"s{i:02}", 1 + i % 4) for i in range(31)]]),
    (2, [("one", 9)]), (7, [("one", 28), ("two", 3)])])
def test_manifest(spark, scratch, levels, groups):
    from shortlist.llm.merkle import manifest
    rows = _rows(groups)
    docs = stored(spark, scratch, [(*r, 1, "x", 2) for r in rows], SCHEMA + ", i int, tree string, pack int")
    got = manifest(docs, tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))},
                   when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0, levels=levels)
    _same(got.collect(), rows)
    held = manifest(docs, levels=levels).collect()
    assert len(held) == len(rows) and all(r.verified for r in held)


def test_single_row_and_empty_table(spark, scratch):
    from shortlist.llm.merkle import manifest
    row = (5, "s", None, 3, "a\nb")
    got = manifest(stored(spark, scratch, [row], SCHEMA, "single")).collect()
    assert len(got) == 1 and got[0].root == got[0].subroot == got[0].leaf
    assert manifest(stored(spark, scratch, [], SCHEMA, "none", 1)).collect() == []


def test_query_and_its_sql(spark, scratch):
    import duckdb
    from shortlist.llm.queries import ORACLE_SQL, op12_merkle
    rows = [r for r in _rows([(None, 4), ("b", 60), ("a", 1), ("ä", 11)])[:-6]]
    stored(spark, scratch, rows, SCHEMA, "documents.parquet")
    got = op12_merkle(spark, scratch)
    assert got.columns == COLUMNS
    _same(got.collect(), rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{scratch}/documents.parquet/*.parquet'")
    _same(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op12_merkle']})").fetchall(), rows)
