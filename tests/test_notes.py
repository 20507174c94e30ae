"""Notes beside written feeds: statistics without a pass, files that can be split."""

import pytest
from pyspark.sql import functions as F

from hitfeed.fixtures import NOW
from hitfeed.plans import refresh
from hitfeed.plans.export import export_feed
from hitfeed.plans.feed import FeedSpec
from hitfeed.session import scratch_path
from hitfeed.sinks.csv import write_csv
from hitfeed.sources import notes
from hitfeed.sources.snapshots import read_snapshot

SPEC = FeedSpec(parent_policies="error,p3,view", hours_ago=48)
VALUES = ["plain", "two\nlines", "cr\rhere", "\r\n", "back\\slash", "\\n", "\\\\n", "\\", "\\\\", "a\\\nb", 'quote " and, comma', "é\x85", "\\0", " x "]


def test_escaped_lines_round_trip(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in VALUES for b in VALUES)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    path = write_csv(df, scratch_path(spark, "escaped"), line_ends="escape")
    got = sorted(((int(r["i"]), r["a"], r["b"]) for r in read_snapshot(spark, path, ["i", "a", "b"]).collect()))
    assert got == rows
    assert notes.read_statistics(spark, path).line_ends == notes.ESCAPED
    for r in spark.read.text(path).collect():
        assert r[0].count('"') % 2 == 0  # every line is whole


def test_line_ends_are_seen(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None)], "x string, y string")
    for rows, form in ((df, notes.NO_LINE_ENDS), (df.union(df.select("x", F.lit("a\rb"))), notes.QUOTED), (df.limit(0), notes.NO_LINE_ENDS)):
        path = write_csv(rows, scratch_path(spark, "seen"))
        assert notes.read_statistics(spark, path).line_ends == form
        assert read_snapshot(spark, path, ["x", "y"]).exceptAll(rows).count() == 0


def test_own_files_are_split_and_foreign_ones_are_not(spark):
    df = spark.range(40_000).selectExpr("id", "concat('value \"', id, '\", more') AS text")
    own = write_csv(df.coalesce(1), scratch_path(spark, "split"))
    foreign = scratch_path(spark, "foreign")
    df.coalesce(1).write.options(header=True, quoteAll=True, escape='"').csv(foreign)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        a, b = (read_snapshot(spark, p, ["id", "text"]) for p in (own, foreign))
        assert a.rdd.getNumPartitions() >= 5 and b.rdd.getNumPartitions() == 1
        assert a.count() == b.count() == 40_000 and a.exceptAll(b).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("single", [False, True])
def test_statistics_of_a_feed(spark, small_log, single):
    feed = export_feed(small_log, SPEC, NOW)
    path = write_csv(feed, scratch_path(spark, "feed"), order_by="start_time", num_partitions=3, single_file=single, filename="Feed.csv" if single else None)
    found = notes.read_statistics(spark, path)
    want = feed.agg(F.count("*"), F.max("start_time"), F.min("hour"), F.max("hour")).first()
    assert (found.rows, found.max_start_time, found.min_hour, found.max_hour) == tuple(want)
    assert found.files == (1 if single else 3) and found.bytes > 0
    assert read_snapshot(spark, path, feed.columns).count() == found.rows
    # a feed that someone has changed since is a foreign one
    extra = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if single else f"{path}/part-99999-added.csv")
    fs = extra.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(extra, True)
    out.write(b'"x"\n')
    out.close()
    assert notes.read_statistics(spark, path) is None


def test_catch_up_reads_the_note(spark, small_log, monkeypatch):
    past = small_log.filter(F.col("start_time") < (NOW - 9 * 3600) * 1_000_000)
    spec = FeedSpec(parent_policies="error,p3,view", hours_ago=48)
    prev = write_csv(export_feed(past, spec, NOW - 9 * 3600), scratch_path(spark, "prev"), order_by="start_time")
    want = refresh.last_seen_hour(read_snapshot(spark, prev))
    assert refresh.noted_hour(spark, prev) == (True, want)
    monkeypatch.setattr(refresh, "last_seen_hour", lambda *a: pytest.fail("the snapshot was scanned"))
    res = refresh.refresh_feed(spark, small_log, spec, NOW, scratch_path(spark, "out"), previous=prev, hourly=True, catch_up=True)
    assert res.seam == want and notes.read_statistics(spark, res.path).rows == res.metrics["kept"] + res.metrics["new"]
    monkeypatch.undo()
    foreign = scratch_path(spark, "foreign")
    read_snapshot(spark, prev).write.options(header=True, quoteAll=True, escape='"').csv(foreign)
    assert refresh.noted_hour(spark, foreign) == (False, None)
    again = refresh.refresh_feed(spark, small_log, spec, NOW, scratch_path(spark, "out"), previous=foreign, hourly=True, catch_up=True)
    assert again.seam == want and again.metrics == res.metrics


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="line_ends"):
        write_csv(spark.range(1), scratch_path(spark, "bad"), line_ends="drop")
