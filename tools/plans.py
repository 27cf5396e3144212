"""Summarise the executed physical plan of every registered query.

Usage: python tools/plans.py [sf_dir] > PLANS.md

Each query is run once (so AQE has its final plan); the summary lists the
shuffles, joins, aggregates, window limits, top-N nodes and Python nodes in
the final plan, including those inside scalar subqueries.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NODES = [
    ("Exchange hashpartitioning", "hash shuffle"),
    ("Exchange rangepartitioning", "range shuffle"),
    ("Exchange RoundRobinPartitioning", "round-robin spread"),
    ("Exchange SinglePartition", "single-partition exchange"),
    ("BroadcastExchange", "broadcast"),
    ("BroadcastHashJoin", "broadcast hash join"),
    ("SortMergeJoin", "sort-merge join"),
    ("ShuffledHashJoin", "shuffled hash join"),
    ("BroadcastNestedLoopJoin", "nested-loop join"),
    ("CartesianProduct", "cartesian product"),
    ("TakeOrderedAndProject", "top-N heap"),
    ("WindowGroupLimit", "window group limit"),
    ("Window ", "window"),
    ("HashAggregate", "hash aggregate"),
    ("ObjectHashAggregate", "object hash aggregate"),
    ("SortAggregate", "sort aggregate"),
    ("Subquery", "scalar subquery"),
    ("MapInPandas", "Python (mapInPandas)"),
    ("ArrowEvalPython", "Python (pandas UDF)"),
    ("BatchEvalPython", "Python (row UDF)"),
    ("Generate", "generate/explode"),
]


def summarise(plan: str) -> str:
    counts = []
    for needle, label in NODES:
        n = plan.count(needle)
        if needle == "Window ":
            n = len(re.findall(r"(?<!Group)Window \[", plan))
        if needle == "HashAggregate":
            n = len(re.findall(r"(?<!Object)HashAggregate\(", plan))
        if n:
            counts.append(f"{label} ×{n}")
    scans = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
    return "; ".join(counts) + ("\n  - scans: " + ", ".join(f"`{s}`" for s in scans) if scans else "")


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    from shortlist.plans.catalog import QUERIES
    from shortlist.session import local_session
    spark = local_session(8, 8, checkpoint_dir=tempfile.mkdtemp(prefix="run-", dir="/tmp"),
                          **{"spark.ui.showConsoleProgress": "false"})
    print(f"# Executed plans of the registered queries ({os.path.basename(sf)}, local[8], AQE on)\n")
    print("Generated by `tools/plans.py`. Ranking queries read the scored table that was written once\n"
          "under the checkpoint folder, so their plans start at a small parquet scan.\n")
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"- **{name}**: {summarise(plan)}")


if __name__ == "__main__":
    main(sys.argv[1:])
