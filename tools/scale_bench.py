"""Timings of the design choices on a larger, partitioned copy of the check view.

    python tools/scale_bench.py [sf_dir] [copies] [existing_copy_root]

The ``policy_log`` view of ``sf_dir`` is replicated ``copies`` times (``explode(sequence)``,
same hours, same policies) and written once as ``subscriber=/year=/month=/day=/hour=``
Parquet below the scratch folder; every timing then reads that copy.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from hitfeed.fixtures import NOW, POLICY_LOG_DDL, policy_log, write_partitioned  # noqa: E402
from hitfeed.plans.export import export_feed, export_multi  # noqa: E402
from hitfeed.plans.feed import FeedSpec  # noqa: E402
from hitfeed.plans.hour_table import refresh_hour_table  # noqa: E402
from hitfeed.plans.refresh import refresh_feed  # noqa: E402
from hitfeed.plans.sync import sync_partitions  # noqa: E402
from hitfeed.operators.multifeed import Feed  # noqa: E402
from hitfeed.registry import FEEDS  # noqa: E402
from hitfeed.schemas import struct_from_ddl  # noqa: E402
from hitfeed.session import build_session, scratch_path  # noqa: E402
from hitfeed.sinks.csv import write_csv  # noqa: E402
from hitfeed.sources.logs import read_logs  # noqa: E402
from hitfeed.sources.partitions import add_partitions, create_log_table, stored_partitions  # noqa: E402


def timed(fn, reps=2, warm=True):
    if warm:
        fn()
    runs = []
    for _ in range(reps):
        t = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t)
    return round(statistics.median(runs), 2)


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    k = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    spark = build_session("local[8]", 8, app_name="hitfeed-scale")
    base = policy_log(spark, sf)
    big = (base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy"))
               .withColumn("event_id", F.col("event_id") * k + F.col("_copy")).drop("_copy"))
    if len(sys.argv) > 3:
        root, setup = sys.argv[3], 0.0
    else:
        root = scratch_path(spark, "scale")
        t0 = time.perf_counter()
        write_partitioned(big, root)
        setup = round(time.perf_counter() - t0, 1)
    logs = read_logs(spark, root, struct_from_ddl(POLICY_LOG_DDL))
    rows = logs.count()
    spec72 = FeedSpec(parent_policies="error,p3", hours_ago=72)
    wide = FeedSpec(parent_policies="error,p3,view", hours_ago=720)
    out = {}
    for mode in ("overlap", "after", "inside"):
        out[f"export_720h_{mode}"] = timed(lambda: noop(export_feed(logs, wide, NOW, mode=mode)))
    out["export_72h_pruned"] = timed(lambda: noop(export_feed(logs, spec72, NOW)))
    out["multi_feed_one_pass"] = timed(lambda: noop(export_multi(logs, FEEDS, NOW)))
    out["multi_feed_pass_per_feed"] = timed(lambda: [noop(export_feed(logs, f.spec, NOW)) for f in FEEDS])
    same = [Feed(n, FeedSpec(parent_policies=p, hours_ago=720, full_days=True))
            for n, p in (("a", "error,p3"), ("b", "p1,signup"), ("c", "view,click"))]
    out["multi_feed_same_window_one_pass"] = timed(lambda: noop(export_multi(logs, same, NOW)))
    out["multi_feed_same_window_per_feed"] = timed(lambda: [noop(export_feed(logs, f.spec, NOW)) for f in same])

    prev = write_csv(export_feed(logs.filter(F.col("start_time") < (NOW - 3600) * 1_000_000), wide, NOW - 3600),
                     scratch_path(spark, "scale-prev"), order_by="start_time")
    out["csv_full_recompute"] = timed(lambda: write_csv(export_feed(logs, wide, NOW), scratch_path(spark, "s"),
                                                        order_by="start_time"))
    out["csv_refresh_hourly"] = timed(lambda: refresh_feed(spark, logs, wide, NOW, scratch_path(spark, "s"),
                                                           previous=prev, hourly=True))
    out["csv_single_task_write"] = timed(lambda: write_csv(export_feed(logs, wide, NOW), scratch_path(spark, "s"),
                                                           order_by="start_time", single_file=True))

    spec_hours = FeedSpec(parent_policies="error,p3,view", hours_ago=168)
    ht = scratch_path(spark, "scale-hours")
    refresh_hour_table(spark, logs.filter(F.col("start_time") < (NOW - 3600) * 1_000_000), spec_hours, NOW - 3600, ht)
    out["hour_table_full_build"] = timed(lambda: refresh_hour_table(spark, logs, spec_hours, NOW,
                                                                    scratch_path(spark, "s")), reps=1, warm=False)
    out["hour_table_refresh_hourly"] = timed(lambda: refresh_hour_table(spark, logs, spec_hours, NOW, ht,
                                                                        hourly=True))

    def sync(lookback):
        name = "scale_" + scratch_path(spark, "t").rsplit("-", 1)[1]
        create_log_table(spark, name, logs.schema, root)
        add_partitions(spark, name, stored_partitions(spark, root).filter(F.col("hour") < NOW - 86400))
        t = time.perf_counter()
        sync_partitions(spark, name, root, lookback_hours=lookback, now=NOW)
        return round(time.perf_counter() - t, 2)
    out["sync_full_listing"] = sync(None)
    out["sync_lookback_48h"] = sync(48)
    print(json.dumps({"metric": "scale_bench_sec", "rows": rows, "copies": k, "setup_write_sec": setup,
                      "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
