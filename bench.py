"""Headline-query timings.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` (default 8) and prints one JSON line.  Each query
is executed in full through a ``noop`` sink (no rows travel to the driver),
after one warm-up pass of the whole set so JIT and file listings are warm.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "extract_fields",        # stage 1: document → resume row
    "resume_table",          # archive semantics: skew-safe ordinals + extraction
    "top_candidates",        # flagship: top-N ranked records
    "rank_candidates",       # whole response (summary, thresholds, metrics, top ids)
    "others_pool",           # corpus-size remainder
    "topn_per_query",        # several criteria at once
    "score_histogram",
    "score_density",
    "html_text",
    "embedding_cache_misses",
    "quality_metrics",
)


def run(spark, fn, sf: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from shortlist.plans.catalog import QUERIES
    from shortlist.session import local_session
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = local_session(cpus, max(cpus, 8), checkpoint_dir=os.path.join(scratch, "checkpoints"),
                          **{"spark.ui.showConsoleProgress": "false",
                             "spark.eventLog.enabled": "false"})
    names = [n for n in HEADLINE if n in QUERIES]
    warm = os.environ.get("BENCH_WARMUP", "1") != "0"
    if warm:
        for name in names:
            run(spark, QUERIES[name], sf)
    timings = {name: round(run(spark, QUERIES[name], sf), 3) for name in names}
    base = os.path.basename(sf.rstrip("/"))
    scale = float(base[2:]) if base.startswith("sf") else None
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": scale, "cpus": cpus,
                      "warmup": warm}))


if __name__ == "__main__":
    main()
