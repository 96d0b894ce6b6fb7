"""Headline benchmark: prints one JSON line with seconds per query (median of runs)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import queries  # noqa: E402

HEADLINE = [
    "color_histogram", "palette_info", "top_colors", "nearest_palette", "apply_color_map", "trim_transparent",
    "block_representative_auto", "finalist_reduce_p5", "scale_down_sprite", "resample_nearest", "edge_map", "sharpen",
    "local_delta", "material_maps", "connected_components", "color_coherence", "kmeans_palette_lab", "grid_quality",
    "detect_pitch", "grid_vote", "suggest_tile_grids", "asset_locations", "full_recipes", "branch_rows",
    "resolve_linked_cels", "revision_conflicts", "online_sessions", "validate_recipes", "apply_recipe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.driver.memory", "20g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries.all_queries()
    registry["color_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up cost
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
