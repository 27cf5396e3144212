"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tools/parity.py [sf_dir] [name ...]

Compares row count, column names and the multiset of rows (values compared
exactly; floats by repr).  Prints one line per query and a summary.
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", repr(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    if hasattr(v, "asDict"):
        return ("r", tuple(norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, norm(x)) for k, x in v.items())))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return f"{name:28s} rows={len(s_rows):6d} spark={t1 - t0:6.2f}s (no oracle)", True
    res = con.sql(sql)
    d_cols = res.columns
    d_rows = res.fetchall()
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"cols spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problems.append(f"values differ: {diff}")
    ok = not problems
    line = f"{name:28s} rows={len(s_rows):6d} spark={t1 - t0:6.2f}s duck={t2 - t1:6.2f}s {'OK' if ok else 'FAIL'}"
    if problems:
        line += "\n    " + "\n    ".join(p[:1500] for p in problems)
    return line, ok


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    import duckdb
    from shortlist.plans.catalog import QUERIES
    from shortlist.plans.oracle import ORACLE_SQL
    from shortlist.session import local_session
    spark = local_session(8, 8, checkpoint_dir=tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    if os.environ.get("PARITY_LAZY"):
        # Behave as a session without a checkpoint folder: every query stays one lazy plan.
        import shortlist.session as ses
        ses.checkpoint_dir = lambda _spark: None
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = []
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        try:
            line, ok = compare(spark, con, sf, name, fn, ORACLE_SQL.get(name))
        except Exception as exc:  # report and go on
            line, ok = f"{name:28s} ERROR {type(exc).__name__}: {str(exc)[:1500]}", False
        print(line, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
