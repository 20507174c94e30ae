"""Feed writers: per-feed directories in order, output naming, stable names elsewhere."""

import random
import re

import pytest

from pyspark.sql import functions as F

from hitfeed.fixtures import NOW
from hitfeed.functions.location import location_hash
from hitfeed.operators.multifeed import Feed, multi_feed_hits
from hitfeed.plans.feed import FeedSpec
from hitfeed.session import scratch_path
from hitfeed.sinks.csv import default_output_dir, feed_output_path, write_csv, write_feeds
from hitfeed.sources.snapshots import read_snapshot


def test_write_feeds_ordered_per_feed(spark, small_log):
    feeds = [Feed("x", FeedSpec(parent_policies="view,error", hours_ago=720)),
             Feed("y", FeedSpec(parent_policies="p1", hours_ago=720))]
    extra = spark.createDataFrame([("x", "LX"), ("y", "LY")], "feed string, feed_location string")
    hits = multi_feed_hits(small_log, feeds, NOW, extra=extra)
    path = write_feeds(hits, scratch_path(spark, "feeds"), num_partitions=4)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == hits.count()
    assert {r[0] for r in back.select("feed_location").distinct().collect()} == {"LX", "LY"}
    per_file = (back.select("feed_location", F.input_file_name().alias("f"), F.col("start_time").cast("long").alias("t"))
                .groupBy("feed_location", "f").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
                .orderBy("feed_location", "f").collect())
    for a, b in zip(per_file, per_file[1:]):
        if a["feed_location"] == b["feed_location"]:
            assert a["hi"] <= b["lo"]
    # inside each file the rows are in start_time order
    for r in per_file[:3]:
        ts = [int(x[0]) for x in spark.read.option("header", True).csv(r["f"]).select("start_time").collect()]
        assert ts == sorted(ts)


def test_naming():
    d = default_output_dir(1612873200, random.Random(1))
    assert re.fullmatch(r"PolicyTriggerCSV-1612873200-[a-z0-9]{8}", d)
    p = feed_output_path("s3a://bucket/", "csv", "s", "1", "sub.x", "r@x")
    assert p == "s3a://bucket/csv/" + location_hash("s", "1", "sub.x", "r@x")


def test_stable_name_in_other_dir(spark):
    src = scratch_path(spark, "run")
    other = scratch_path(spark, "published")
    p = write_csv(spark.range(3).selectExpr("CAST(id AS STRING) AS v"), src, single_file=True,
                  filename="Latest.csv", target_dir=other)
    assert p.endswith(other.split("/")[-1] + "/Latest.csv")
    assert read_snapshot(spark, p).count() == 3


def test_refresh_counts_rejects(spark, small_log):
    from hitfeed.plans.refresh import refresh_feed
    spec = FeedSpec(parent_policies="error", hours_ago=48)
    cols = ["event_id", "start_time", "user_id", "event_type", "policy", "annotations",
            "subscriber", "year", "month", "day", "hour"]
    bad = spark.createDataFrame([tuple(["x"] * 10 + ["not-an-hour"])], ", ".join(f"{c} string" for c in cols))
    prev = write_csv(bad, scratch_path(spark, "bad"))
    res = refresh_feed(spark, small_log, spec, NOW, scratch_path(spark, "out"), previous=prev, hourly=True)
    assert res.metrics["rejected"] == 1 and res.metrics["kept"] == 0 and res.metrics["input"] == 1


def test_write_feeds_file_count(spark, small_log):
    feeds = [Feed(f"f{i}", FeedSpec(parent_policies=p, hours_ago=720))
             for i, p in enumerate(["view", "error", "click", "p1", "p2", "p3"])]
    extra = spark.createDataFrame([(f.name, f"L{f.name}") for f in feeds], "feed string, feed_location string")
    hits = multi_feed_hits(small_log, feeds, NOW, extra=extra)
    path = write_feeds(hits, scratch_path(spark, "feeds"), num_partitions=8)
    files = spark.read.option("header", True).csv(path).select(F.input_file_name()).distinct().count()
    assert files <= 8 + len(feeds)  # contiguous feed ranges, not one file per feed per task


def test_write_feeds_overwrite_replaces_all(spark, small_log):
    path = scratch_path(spark, "feeds")
    extra = spark.createDataFrame([("x", "LX"), ("y", "LY")], "feed string, feed_location string")
    two = [Feed("x", FeedSpec(parent_policies="view", hours_ago=720)),
           Feed("y", FeedSpec(parent_policies="p1", hours_ago=720))]
    write_feeds(multi_feed_hits(small_log, two, NOW, extra=extra), path)
    write_feeds(multi_feed_hits(small_log, two[:1], NOW, extra=extra), path)
    locs = {r[0] for r in spark.read.option("header", True).csv(path).select("feed_location").distinct().collect()}
    assert locs == {"LX"}  # a plain overwrite replaces the whole output


def _names(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


@pytest.mark.parametrize("single", [True, False])
def test_failed_run_keeps_the_published_feed(spark, single):
    root = scratch_path(spark, "safe")
    good = spark.range(5).selectExpr("CAST(id AS STRING) AS v")
    bad = spark.range(5).selectExpr("CAST(raise_error('boom') AS STRING) AS v")
    for path, name in ((f"{root}/named", "Latest.csv"), (f"{root}/plain", None)):
        out = write_csv(good, path, filename=name, single_file=single)
        with pytest.raises(Exception, match="boom"):
            write_csv(bad, path, filename=name, single_file=single)
        assert read_snapshot(spark, out).count() == 5
    assert _names(spark, root) == ["named", "plain"]  # no run directory is left


def test_republish_replaces(spark):
    root = scratch_path(spark, "again")
    for n in (5, 3):
        out = write_csv(spark.range(n).selectExpr("CAST(id AS STRING) AS v"), root, filename="Latest.csv")
        assert read_snapshot(spark, out).count() == n
    assert _names(spark, root) == ["Latest.csv"]
    # a feed may replace the directory that it reads
    out = write_csv(read_snapshot(spark, out).filter("v > 0"), root, filename="Latest.csv")
    assert read_snapshot(spark, out).count() == 2


def test_arguments_are_checked_before_writing(spark):
    df = spark.range(1).selectExpr("CAST(id AS STRING) AS v")
    path = scratch_path(spark, "args")
    for kw in ({"mode": "append"}, {"filename": "x.csv", "partition_by": ["v"]}, {"keep_original": True}):
        with pytest.raises(ValueError):
            write_csv(df, path, **kw)
    write_csv(df, path)
    with pytest.raises(FileExistsError):
        write_csv(df, path, mode="errorifexists")


def test_feeds_under_their_own_names(spark, small_log):
    from hitfeed.operators.multifeed import feed_locations_frame
    spec = FeedSpec(parent_policies="view,error", hours_ago=720)
    feeds = [Feed("x", spec, subscriber="sub.0", receiver="r", ordinal="1", output_filename="X.csv"),
             Feed("y", spec, subscriber="sub.1", receiver="r", ordinal="1", output_filename="Latest Y.csv")]
    hits = multi_feed_hits(small_log, feeds, NOW, extra=feed_locations_frame(spark, feeds, "s"))
    path = scratch_path(spark, "named-feeds")
    for _ in range(2):
        write_feeds(hits, path, names="output_filename", num_partitions=3)
    for f in feeds:
        place = f"{path}/{location_hash('s', '1', f.subscriber, 'r')}/{f.output_filename}"
        assert read_snapshot(spark, place).count() == hits.filter(F.col("feed") == f.name).count() > 0
    assert len(_names(spark, path)) == 2
