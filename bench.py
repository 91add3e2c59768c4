"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores. Each query runs to the end into a no-op sink, so results are computed in full but not
collected. All queries run in two passes of one session and the better time counts: at these
sizes a first run mostly measures class loading and code generation. Planning is part of the time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.plans import REGISTRY  # noqa: E402
from gridloom.session import build_session  # noqa: E402

HEADLINE = [
    "mean_by_key",
    "mean_per_file",
    "cell_mean_bands",
    "cell_mean_fixed",
    "raster_stats",
    "stack_years",
    "idx_to_ijk",
    "place_z_threshold",
    "place_x_balanced",
    "positional_index",
    "densify",
    "halo_exchange",
    "dense_brick",
    "ghost_brick",
    "ray_matrix",
    "forward_project",
    "art_reconstruct",
    "tomo_pipeline",
    "stream_batch_stats",
    "reduce_custom",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    first = {name: run(name) for name in HEADLINE}
    seconds = {name: round(min(first[name], run(name)), 3) for name in HEADLINE}
    values = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "annual_mean_values_per_sec": round(values / seconds["mean_by_key"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
