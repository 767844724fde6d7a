"""Time the registered queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from roomfold.plans.catalog import QUERIES
from roomfold.session import build_session, drop_stages

# One query per stage of the pipeline; BENCH_QUERIES=all times every registered query.
HEADLINE = [
    "frame_stride", "motion_keyframes", "visual_keyframes", "photo_selection", "back_projection", "voxel_sums",
    "frame_fusion", "statistical_outliers", "robust_extents", "median_and_mad", "convex_hulls", "calibration_profiles",
    "metric_scale", "measurement_rows", "measurement_intervals", "integrity_references", "integrity_agreement",
    "room_components", "spanning_tree", "cycle_check", "room_overlaps", "wall_association", "opening_clusters",
    "opening_fusion", "surface_association", "damage_fusion", "wall_gaps", "solid_wall_runs", "descriptor_matches",
    "loop_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else [n for n in HEADLINE if n in QUERIES]
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, driver_memory="20g")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        drop_stages(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": cpus, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
