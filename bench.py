"""Headline-query benchmark.

/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed in full through the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p1_layer1_family",
    "p2_layer1_top10",
    "p3_final_vote",
    "o26_variant_stability",
    "o27_admission_scenarios",
    "o31_graph_propagate",
    "o32_embedding_variant",
    "o36_coborrow_candidates",
    "o22_top1",
    "o28_admission_gate",
    "p4_full_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from ballot.plans.registry import QUERIES
    from ballot.session import build_session

    spark = build_session(cpus=cpus)
    timings: dict[str, float] = {}
    # Warm-up, not timed: the same queries once on the smallest scale, so JVM
    # class loading and JIT compilation are not billed to the first query.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm) and warm.rstrip("/") != sf_dir:
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    # Input sizes (parquet row counts), after the timed section.
    input_rows = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
        for t in ("orders", "lineitem", "customer", "part", "embeddings")
    }
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {
        "metric": "headline_queries_total_wall",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus) if str(cpus).isdigit() else cpus,
        "spark": spark.version,
        "warmup": warm if warm and os.path.isdir(warm) else None,
        "input_rows": input_rows,
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
