"""Time the headline queries and print one JSON line; each figure goes to stderr at once, and a run that is ended by a
signal prints what it has.

Every result row is produced (``noop`` sink). 'prepare' is the one-off join, split and write that the
page queries read from; it is timed on its own and counted in the total.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from pyspark.sql import SparkSession

from parcelcast.plans import catalog

HEADLINE = [
    "scan_deliveries", "temporal_split", "kpis_actual", "by_zone", "by_road", "traffic_impact", "flashcards",
    "error_evolution", "error_histogram", "road_box", "profile_describe", "kpis_confidence", "scaler_stats",
    "scale_numeric", "one_hot", "ordinal_encode", "scenario_daily", "zone_risk", "scenario_daily_full",
    "kpis_future", "ridge1d", "train_ridge", "train_glm", "train_all", "batch_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("parcelcast-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.python.unix.domain.socket.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    times: dict[str, float] = {}

    def report() -> None:
        print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                          "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)

    def ended(*_) -> None:
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, ended)

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)

    timed("prepare", lambda: catalog._prepared(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    report()
    spark.stop()


if __name__ == "__main__":
    main()
