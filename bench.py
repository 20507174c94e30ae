"""Headline timings.  Prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion (``noop`` sink or a real CSV write) after one warm-up run;
the reported time is the median of ``BENCH_REPS`` runs.  Pairs measure the comparisons of
refresh vs full recompute, range-ordered vs single-task write, native vs Python rendering.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from hitfeed.fixtures import NOW, partitioned_copy, policy_log  # noqa: E402
from hitfeed.functions.render import csv_safe  # noqa: E402
from hitfeed.operators.hits import explode_policies  # noqa: E402
from hitfeed.operators.multifeed import Feed  # noqa: E402
from hitfeed.plans.export import export_feed, export_multi  # noqa: E402
from hitfeed.plans.feed import FeedSpec  # noqa: E402
from hitfeed.plans.hour_table import refresh_hour_table  # noqa: E402
from hitfeed.plans.hour_versions import HourOutput, refresh_hours_feed  # noqa: E402
from hitfeed.plans.refresh import refresh_feed  # noqa: E402
from hitfeed.registry import FEEDS, FLAGSHIP  # noqa: E402
from hitfeed.session import build_session, scratch_path  # noqa: E402
from hitfeed.plans.sync import sync_partitions  # noqa: E402
from hitfeed.sinks.csv import write_csv  # noqa: E402
from hitfeed.sources.logs import read_logs  # noqa: E402
from hitfeed.sources.partitions import create_log_table  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPS = int(os.environ.get("BENCH_REPS", "3"))


SAME_WINDOW = [Feed(n, FeedSpec(parent_policies=p, hours_ago=720, full_days=True))
               for n, p in (("a", "error,p3"), ("b", "p1,signup"), ("c", "view,click"))]


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session(f"local[{CPUS}]", CPUS, app_name="hitfeed-bench")
    log = policy_log(spark, SF)
    wide = FeedSpec(parent_policies="error,p3,view", hours_ago=720)

    # previous snapshot for the refresh: the feed as exported an hour earlier
    prev = write_csv(export_feed(log.filter(F.col("start_time") < (NOW - 3600) * 1_000_000), wide, NOW - 3600),
                     scratch_path(spark, "bench-prev"), order_by="start_time")

    # hour table as it stood an hour ago, refreshed in place by each timed run (idempotent)
    spec_hours = FeedSpec(parent_policies="error,p3,view", hours_ago=168)
    hour_table = scratch_path(spark, "bench-hours")
    refresh_hour_table(spark, log.filter(F.col("start_time") < (NOW - 3600) * 1_000_000), spec_hours,
                       NOW - 3600, hour_table)

    hour_feed = [HourOutput("bench_hours", scratch_path(spark, "bench-feed-table")),
                 HourOutput("bench_feed", scratch_path(spark, "bench-feed"), "csv")]
    refresh_hours_feed(spark, log.filter(F.col("start_time") < (NOW - 3600) * 1_000_000), wide, NOW - 3600, *hour_feed)

    # a stored copy with real partition directories: here the hour bounds prune the scan
    root = partitioned_copy(spark, SF)
    stored = read_logs(spark, root, log.schema)

    def sync():
        name = "bench_" + scratch_path(spark, "t").rsplit("-", 1)[1]
        create_log_table(spark, name, log.schema, root)
        sync_partitions(spark, name, root, kind="dns", lookback_hours=72, now=NOW)
        spark.sql(f"DROP TABLE {name}")

    from pyspark.sql.functions import udf

    @udf("string")
    def py_render_map(m):  # the row-at-a-time form, for the comparison only
        return None if m is None else "{" + ", ".join(f"{k}={v}" for k, v in m.items()) + "}"

    queries = {
        "flagship_export": lambda: noop(export_feed(log, FLAGSHIP, NOW)),
        "export_overlap_prefilter": lambda: noop(export_feed(log, wide, NOW, mode="overlap")),
        "export_filter_after_explode": lambda: noop(export_feed(log, wide, NOW, mode="after")),
        "export_filter_in_generator": lambda: noop(export_feed(log, wide, NOW, mode="inside")),
        "multi_feed_one_pass": lambda: noop(export_multi(log, FEEDS, NOW)),
        "multi_feed_pass_per_feed": lambda: [noop(export_feed(log, f.spec, NOW)) for f in FEEDS],
        "multi_feed_same_window_one_pass": lambda: noop(export_multi(log, SAME_WINDOW, NOW)),
        "multi_feed_same_window_per_feed": lambda: [noop(export_feed(log, f.spec, NOW)) for f in SAME_WINDOW],
        "feed_full_recompute_csv": lambda: write_csv(export_feed(log, wide, NOW), scratch_path(spark, "b"),
                                                     order_by="start_time"),
        "feed_refresh_csv": lambda: refresh_feed(spark, log, wide, NOW, scratch_path(spark, "b"), previous=prev,
                                                 hourly=True),
        "hour_table_full_build": lambda: refresh_hour_table(spark, log, spec_hours, NOW,
                                                            scratch_path(spark, "b")),
        "hour_table_refresh_hourly": lambda: refresh_hour_table(spark, log, spec_hours, NOW, hour_table,
                                                                hourly=True),
        "hour_feed_refresh_hourly": lambda: refresh_hours_feed(spark, log, wide, NOW, *hour_feed, hourly=True),
        "flagship_export_partitioned": lambda: noop(export_feed(stored, FLAGSHIP, NOW)),
        "multi_feed_partitioned_one_pass": lambda: noop(export_multi(stored, FEEDS, NOW)),
        "partition_sync": sync,
        "write_range_ordered": lambda: write_csv(export_feed(log, wide, NOW), scratch_path(spark, "b"),
                                                 order_by="start_time"),
        "write_single_task": lambda: write_csv(export_feed(log, wide, NOW), scratch_path(spark, "b"),
                                               order_by="start_time", single_file=True),
        "render_native": lambda: noop(csv_safe(explode_policies(log, "parent_policies"))),
        "render_python_udf": lambda: noop(csv_safe(explode_policies(log, "parent_policies").withColumn(
            "annotations", py_render_map("annotations")))),
    }
    headline = ["flagship_export", "multi_feed_one_pass", "feed_refresh_csv", "write_range_ordered",
                "render_native", "hour_table_full_build", "partition_sync"]
    first_round = headline[:5]  # the total of the first round's list, for comparison
    times = {}
    for name, fn in queries.items():
        fn()  # warm-up
        runs = []
        for _ in range(REPS):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(times[q] for q in headline), 3)
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "headline": headline,
        "first_round_total": round(sum(times[q] for q in first_round), 3),
        "sf": SF.rsplit("sf", 1)[-1],
        "cpus": CPUS,
        "rows": {"policy_log": log.count()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
