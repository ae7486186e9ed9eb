"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from frota.plans.queries import REGISTRY
from frota.session import local_session

HEADLINE = [
    "track_orders",
    "current_allocation",
    "order_history",
    "customer_orders",
    "put_latest_allocation",
    "latency_report",
    "nearest_node_customers",
    "nearest_couriers_top3",
    "shortest_distances",
    "paths",
    "best_courier_by_road",
    "dispatch",
    "apply_status_updates",
    "release_couriers",
    "new_orders",
    "stream_positions",
    "dispatch_routes",
    "delivery_routes",
    "stream_status",
    "stream_tracking",
    "stream_dispatch",
    "stream_fleet",
    "road_distances_regions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    REGISTRY["total_requests"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
