"""The job-level entry points."""

from hitfeed.fixtures import NOW
from hitfeed.functions.location import location_hash
from hitfeed.plans.export import export_feed
from hitfeed.plans.feed import FeedSpec
from hitfeed.plans.jobs import FeedTarget, export_job, refresh_job
from hitfeed.session import scratch_path
from hitfeed.sources.snapshots import read_snapshot
from hitfeed.functions.render import csv_safe

SPEC = FeedSpec(parent_policies="error,p3", hours_ago=48, full_days=True)
COLS = ["event_id", "start_time", "user_id", "event_type", "policy", "annotations",
        "subscriber", "year", "month", "day", "hour"]


def test_export_then_refresh_jobs(spark, small_log):
    base = scratch_path(spark, "jobs")
    tgt = FeedTarget(base, "s3cret", "7", "sub.x", "ops@x.org", output_dir="csv", output_filename="Latest.csv")
    assert "s3cret" not in repr(tgt)
    loc = location_hash("s3cret", "7", "sub.x", "ops@x.org")
    p = export_job(spark, small_log.filter(f"start_time < {(NOW - 3600) * 1_000_000}"), SPEC, tgt, now=NOW - 3600,
                   order_by="start_time")
    assert p.endswith(f"/csv/{loc}/Latest.csv")
    res = refresh_job(spark, small_log, SPEC, FeedTarget(base, "s3cret", "7", "sub.x", "ops@x.org",
                                                         output_dir="csv-next"),
                      input_root=base, input_prefix="csv/", hourly=True, now=NOW)
    assert res.snapshot.endswith("Latest.csv") and f"/csv-next/{loc}" in res.path
    got = read_snapshot(spark, res.path, COLS)
    want = csv_safe(export_feed(small_log, SPEC, NOW)).select(*COLS)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_default_output_dir(spark, small_log):
    tgt = FeedTarget(scratch_path(spark, "jobs"), "s", "1", "a", "b")
    p = export_job(spark, small_log, SPEC, tgt, now=NOW)
    assert f"/PolicyTriggerCSV-{NOW}-" in p and p.endswith(location_hash("s", "1", "a", "b"))
