"""Incremental refresh: equals a full export, idempotent, catch-up fills gaps, late events."""

import pytest
from pyspark.sql import functions as F

from hitfeed.fixtures import NOW
from hitfeed.functions.render import csv_safe
from hitfeed.plans.export import export_feed
from hitfeed.plans.feed import FeedSpec
from hitfeed.plans.refresh import refresh_feed
from hitfeed.session import scratch_path
from hitfeed.sinks.csv import write_csv
from hitfeed.sources.snapshots import read_snapshot

SPEC = FeedSpec(parent_policies="error,p3,view", hours_ago=48)
COLS = ["event_id", "start_time", "user_id", "event_type", "policy", "annotations",
        "subscriber", "year", "month", "day", "hour"]


def as_of(logs, t):
    return logs.filter(F.col("start_time") < t * 1_000_000)


def snapshot(spark, logs, t, spec=SPEC):
    return write_csv(export_feed(as_of(logs, t), spec, t), scratch_path(spark, "snap"), order_by="start_time")


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def full(spark, logs, spec=SPEC):
    return csv_safe(export_feed(logs, spec, NOW)).select(*COLS)


def test_refresh_equals_export(spark, small_log):
    prev = snapshot(spark, small_log, NOW - 3600)
    for hourly in (True, False):
        res = refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "out"), previous=prev, hourly=hourly)
        assert same(read_snapshot(spark, res.path, COLS), full(spark, small_log))
        m = res.metrics
        assert m["kept"] + m["new"] == full(spark, small_log).count()
        assert m["input"] >= m["in_window"] >= m["kept"]


def test_refresh_twice_is_once(spark, small_log):
    prev = snapshot(spark, small_log, NOW - 3600)
    r1 = refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "out"), previous=prev, hourly=True)
    r2 = refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "out"), previous=r1.path, hourly=True)
    assert same(read_snapshot(spark, r1.path, COLS), read_snapshot(spark, r2.path, COLS))


def test_catch_up_fills_gap(spark, small_log):
    prev = snapshot(spark, small_log, NOW - 10 * 3600 - 600)
    strict = refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "out"), previous=prev, hourly=True)
    catch = refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "out"), previous=prev, hourly=True,
                         catch_up=True)
    want = full(spark, small_log)
    assert same(read_snapshot(spark, catch.path, COLS), want)
    assert read_snapshot(spark, strict.path, COLS).count() < want.count()  # strict misses the gap
    assert catch.seam < strict.seam


def test_late_event_at_seam(spark, small_log):
    # filed under 22:00 although it happened at 23:05; arrived before the 23:30 run
    late_start = (NOW - 3600 + 300) * 1_000_000
    late = (small_log.filter("parent_policies IS NOT NULL AND size(parent_policies) > 0").limit(1)
            .withColumn("event_id", F.lit(-1).cast("long"))
            .withColumn("parent_policies", F.array(F.lit("error")))
            .withColumn("start_time", F.lit(late_start))
            .withColumn("hour", F.lit(NOW - 7200).cast("int")))
    logs = small_log.unionByName(late)
    prev = snapshot(spark, logs, NOW - 1800)
    res = refresh_feed(spark, logs, SPEC, NOW, scratch_path(spark, "out"), previous=prev, hourly=True)
    got = read_snapshot(spark, res.path, COLS)
    assert got.filter("event_id = '-1'").count() == 1
    assert same(got, full(spark, logs))


def test_output_is_ordered(spark, small_log):
    prev = snapshot(spark, small_log, NOW - 3600)
    res = refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "out"), previous=prev, hourly=True,
                       num_partitions=4)
    df = read_snapshot(spark, res.path, COLS)
    files = (df.select(F.input_file_name().alias("f"), F.col("start_time").cast("long").alias("t"))
             .groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("f").collect())
    assert len(files) > 1
    for a, b in zip(files, files[1:]):
        assert a["hi"] <= b["lo"]


def test_single_file_with_name(spark, small_log):
    prev = snapshot(spark, small_log, NOW - 3600)
    res = refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "out"), previous=prev, hourly=True,
                       single_file=True, filename="LatestTriggers.csv")
    assert res.path.endswith("/LatestTriggers.csv")
    got = read_snapshot(spark, res.path, COLS)
    assert same(got, full(spark, small_log))
    ts = [int(r[0]) for r in got.select("start_time").collect()]
    assert ts == sorted(ts)


def test_refresh_rejects_day_range(spark, small_log):
    with pytest.raises(ValueError):
        refresh_feed(spark, small_log, FeedSpec(parent_policies="x", day_range="20240101-20240102"), NOW,
                     scratch_path(spark, "out"), previous="/nonexistent")


def test_hour_table_refresh(spark, small_log):
    from hitfeed.plans.hour_table import read_hour_table, refresh_hour_table
    path = scratch_path(spark, "hours")
    spec = FeedSpec(parent_policies="error,p3,view", hours_ago=24)
    first = refresh_hour_table(spark, as_of(small_log, NOW - 6 * 3600), spec, NOW - 6 * 3600, path)
    assert first.seam == first.floor  # first run builds the window
    r = refresh_hour_table(spark, small_log, spec, NOW, path, hourly=True, catch_up=True)
    assert r.dropped_hours and max(r.dropped_hours) < r.floor  # retention drops whole hours
    want = render_cols(export_feed(small_log, spec, NOW).select(*COLS))
    assert same(render_cols(read_hour_table(spark, path, COLS)), want)
    again = refresh_hour_table(spark, small_log, spec, NOW, path, hourly=True)
    assert again.dropped_hours == []
    # (a frame read before the rewrite would hold a stale file listing: read again)
    assert same(render_cols(read_hour_table(spark, path, COLS)), want)


def render_cols(df):
    return csv_safe(df)


def test_hour_table_to_csv(spark, small_log):
    from hitfeed.plans.hour_table import hour_table_to_csv, refresh_hour_table
    spec = FeedSpec(parent_policies="error,p3,view", hours_ago=24)
    path = scratch_path(spark, "hours")
    refresh_hour_table(spark, small_log, spec, NOW, path)
    out = hour_table_to_csv(spark, path, scratch_path(spark, "csv"), COLS, single_file=True, filename="Feed.csv")
    got = read_snapshot(spark, out, COLS)
    assert same(got, full(spark, small_log, spec))
    ts = [int(r[0]) for r in got.select("start_time").collect()]
    assert ts == sorted(ts)


def test_hour_table_missed_runs(spark, small_log):
    from hitfeed.plans.hour_table import read_hour_table, refresh_hour_table
    spec = FeedSpec(parent_policies="error,p3,view", hours_ago=24)
    want = render_cols(export_feed(small_log, spec, NOW).select(*COLS))
    t_prev = NOW - 12 * 3600  # runs missed for 12 hours
    strict, safe = scratch_path(spark, "hours"), scratch_path(spark, "hours")
    for path in (strict, safe):
        refresh_hour_table(spark, as_of(small_log, t_prev), spec, t_prev, path)
    refresh_hour_table(spark, small_log, spec, NOW, strict, hourly=True, catch_up=False)
    refresh_hour_table(spark, small_log, spec, NOW, safe, hourly=True)  # default: catch up
    assert read_hour_table(spark, strict, COLS).count() < want.count()
    assert same(render_cols(read_hour_table(spark, safe, COLS)), want)


def test_refresh_modes_agree(spark, small_log):
    prev = snapshot(spark, small_log, NOW - 3600)
    outs = [read_snapshot(spark, refresh_feed(spark, small_log, SPEC, NOW, scratch_path(spark, "o"), previous=prev,
                                              hourly=True, mode=m).path, COLS) for m in ("overlap", "after")]
    assert same(outs[0], outs[1])


def test_hour_table_follows_the_source(spark, small_log):
    """Hours that lost their hits go, late hits of the re-read hours come, and an interrupted run is made up for."""
    from hitfeed.plans.hour_table import _mark, refresh_hour_table
    spec = FeedSpec(parent_policies="error,p3", hours_ago=72)
    path = scratch_path(spark, "follow")
    late = small_log.filter(f"event_id % 7 <> 0 OR hour < {NOW - 24 * 3600}")
    refresh_hour_table(spark, late, spec, NOW, path)
    gone = NOW - 5 * 3600
    now_log = small_log.filter(f"hour <> {gone}")
    refresh_hour_table(spark, now_log, spec, NOW, path)
    want = export_feed(now_log, spec, NOW)
    got = spark.read.parquet(path)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0
    # a run that died before it dropped an older hour has left its marker
    older = NOW - 50 * 3600
    _mark(spark, path, older - 3600)
    shrunk = now_log.filter(f"hour <> {older}")
    res = refresh_hour_table(spark, shrunk, spec, NOW, path, hourly=True)
    assert res.rewritten_from == older - 3600
    assert spark.read.parquet(path).count() == export_feed(shrunk, spec, NOW).count()
    assert refresh_hour_table(spark, shrunk, spec, NOW, path, hourly=True).rewritten_from > older
