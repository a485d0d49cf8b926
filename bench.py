"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from ripplework.plans import catalogue
from ripplework.session import local_session

HEADLINES = (
    "impact_rings", "impact_generic_graph", "source_impact", "analyze_symbols", "import_resolution", "call_resolution_ladder",
    "symbol_diff", "change_status", "graph_edge_diff", "innermost_interval", "quiescence_states", "gap_sessions",
    "intent_matches", "map_cap", "layout_coords", "parse_status",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("ripplework-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    timings = {}
    for name in HEADLINES:
        begun = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": spark.sparkContext.defaultParallelism,
        "spark": spark.version, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}))
    spark.stop()


if __name__ == "__main__":
    main()
