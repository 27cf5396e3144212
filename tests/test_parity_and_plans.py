"""Every registered query equals its DuckDB oracle; physical plans have the intended shape."""

import os
import sys

import duckdb
import pytest

from paths import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "tools"))
from parity import TABLES, compare  # noqa: E402

from shortlist.plans.catalog import QUERIES  # noqa: E402
from shortlist.plans.oracle import ORACLE_SQL  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    line, ok = compare(spark, duck, SF0001, name, QUERIES[name], ORACLE_SQL.get(name))
    assert ok, line


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_prunes_columns_and_stays_native(spark):
    plan = _plan(QUERIES["extract_email"](spark, SF0001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in plan


def test_semantic_scores_read_only_vectors(spark):
    plan = _plan(QUERIES["semantic_scores"](spark, SF0001))
    assert "label" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns[:2] == ["Resume_ID", "Source_File"]
    assert df.count() == 5
    assert set(QUERIES) <= set(entry.queries())
