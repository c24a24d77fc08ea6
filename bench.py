"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from emberscan.plans import registry
from emberscan.session import local_session

HEADLINE = (
    "flagship_ranked_candidates", "slides_background", "nearest_coincidence", "interval_candidates", "rank_far",
    "network_components", "neighbour_pairs", "points_inside_extents", "islands_1d", "window_chain_clusters",
    "event_catalogue", "percolation_tiles", "pixel_events", "detector_edges", "detector_events", "tile_coherence",
    "candidate_features", "dbscan_labels", "window_moments", "energy_quantiles_band", "trigger_summary",
    "event_significance", "match_injections", "efficiency_bins", "mode_roc", "roc_auc", "session_events",
    "overlap_add_stitch", "search_triggers", "whitened_series", "sky_grid_weights",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    registry.load()
    spark = local_session(cpus, partitions=cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    # Start the JVM and the Python workers before the clock does.
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
