"""Wall time of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dwellgraph.session import local_session  # noqa: E402
from dwellgraph.workloads.queries import QUERIES  # noqa: E402

HEADLINE = [
    "stay_runs", "segments", "drift_removed", "pingpong_collapsed", "merge_stays", "residence_points", "region_merge",
    "clean_traces", "graph_undirected", "threshold_graphs", "weight_quartiles", "adjacency", "node_transitions",
    "edge_transitions", "walks_first_order", "walks_second_order", "walks_thresholds", "poi_flatten", "place_details",
    "pois_within", "user_meetings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["cdr_located"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
