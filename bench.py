"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from lineagraph.plans.queries import QUERIES

HEADLINE = [
    "lin_01_derivation", "lin_02_members_as_of", "lin_02_members_at", "lin_03_was_derived_from", "rul_30_slices", "rul_24_indirect_activations",
    "act_05_stacks", "sum_04_namespace_match", "sum_07_edge_counts", "eva_01_query_evaluations", "rul_14_lines_of_activations", "trl_13_versioned_files", "clu_09_propagated", "his_01_history_edges",
    "lin_01_navigate", "lin_03_derived_from_all", "sum_04_graph_edges", "dif_07_tree_distances", "psp_06_control_flow", "rul_08_successor_ranges",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[1]](spark, folder).write.format("noop").mode("overwrite").save()  # the session's first query also starts it up
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
