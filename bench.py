"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Results are written to
the no-op sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.plans import catalog  # noqa: E402
from factloom.session import build_session  # noqa: E402

HEADLINE = [
    "s1_latest_scan", "q1_profile", "p1_filter_language", "s10_apply_changes", "s11_source_sync", "t1_text_chunks", "t4_csv_batches", "t8_x18_masked_text",
    "t9_page_text", "g9_mention_edges", "a3_mention_nodes", "g3_pair_classes", "g4_w2_supersession", "l1_vector_top_k", "r1_vector_search",
    "r2_keyword_search", "r3_about_search", "r6_hybrid_search", "r6_hybrid_depth2", "g12_multihop_walk", "f0_mark_expired", "c4_p6_verdicts",
    "c1_community_detection", "f8_land_merges", "f11_maintenance_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("factloom-bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
