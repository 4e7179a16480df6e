"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the threads,
BENCH_QUERIES a comma-separated list (or `all`) of registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "A2_cell_sum A3_cell_mean A4_cell_majority A5_sampled_majority A6_cells_to_labels A7_layer_stats P12_robust_clip "
    "J1_regrid_nearest J2_regrid_bilinear J5_held_out_maps J6_footprint_exclusion J10_training_pixels "
    "L1_effective_source L4_metadata_merge L5_stroke_fold L8_region_fill L10_stroke_rasterise L11_painting_fingerprint "
    "R1_stratified_sample R2_per_cell_sample R3_balanced_cap S2_catalog_normalise S11_content_digests S13_archive_members "
    "G2_alias_groups G4_tile_contexts N1_slope N2_gaussian N6_sky_view_wide N8_nearest_fill N11_terrain_features "
    "E2_fold_plan E3_eligible_cells E7_class_metrics E8_pooled_summary M1_forest"
).split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from cellscape.plans import QUERIES
    from cellscape.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not a query
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        # Every row and column is produced and nothing reaches the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
