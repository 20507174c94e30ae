"""Snapshot discovery and CSV fidelity."""

import time

import pytest
from pyspark.sql import functions as F

from hitfeed.session import scratch_path
from hitfeed.sinks.csv import write_csv
from hitfeed.sources.snapshots import latest_snapshot, list_csv, read_snapshot
from conftest import SF_SMALL


def test_latest_by_prefix(spark):
    root = scratch_path(spark, "snaps")
    df = spark.range(5).select(F.col("id").cast("string").alias("v"))
    write_csv(df, f"{root}/feed-a/run-1")
    time.sleep(0.05)
    write_csv(df.limit(2), f"{root}/feed-a/run-2")
    time.sleep(0.05)
    write_csv(df.limit(1), f"{root}/other/run-3")
    assert latest_snapshot(spark, root, "feed-a").endswith("/feed-a/run-2")
    assert latest_snapshot(spark, root, "feed-a/run-1").endswith("/feed-a/run-1")
    assert latest_snapshot(spark, root).endswith("/other/run-3")
    assert read_snapshot(spark, latest_snapshot(spark, root, "feed")).count() == 2
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, root, "nothing-here")
    # one row per csv part, each mapped to its snapshot directory
    assert list_csv(spark, root).select("snapshot").distinct().count() == 3


def test_single_loose_file(spark):
    root = scratch_path(spark, "loose")
    p = write_csv(spark.range(3).selectExpr("CAST(id AS STRING) AS v"), f"{root}/d", single_file=True,
                  filename="Latest.csv")
    assert latest_snapshot(spark, root).endswith("/d/Latest.csv")
    assert read_snapshot(spark, p).count() == 3
    p2 = write_csv(spark.range(4).selectExpr("CAST(id AS STRING) AS v"), f"{root}/e", single_file=True,
                   filename="Latest.csv", keep_original=True)
    assert latest_snapshot(spark, root, "e").endswith("/e/Latest.csv")
    assert read_snapshot(spark, p2).count() == 4


def test_csv_roundtrip_hard_text(spark):
    rows = [("1", 'say "hi", then\nleave'), ("2", "  padded  "), ("3", "back\\slash"), ("4", ""), ("5", None),
            ("6", "crlf\r\nline")]
    df = spark.createDataFrame(rows, "k string, t string")
    path = write_csv(df, scratch_path(spark, "rt"))
    got = {r["k"]: r["t"] for r in read_snapshot(spark, path, ["k", "t"]).collect()}
    assert got["1"] == 'say "hi", then\nleave'
    assert got["2"] == "  padded  "
    assert got["3"] == "back\\slash"
    assert got["4"] is None and got["5"] is None  # empty and null both read back null
    assert got["6"] == "crlf\r\nline"


def test_documents_roundtrip(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    path = write_csv(docs, scratch_path(spark, "docs"))
    back = read_snapshot(spark, path, docs.columns)
    want = docs.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in docs.columns])
    assert back.count() == docs.count() and back.exceptAll(want).count() == 0


def test_quoting(spark):
    path = write_csv(spark.createDataFrame([("a", 1)], "s string, n int"), scratch_path(spark, "q"), single_file=True)
    text = spark.read.text(path).collect()
    assert [r[0] for r in text] == ['"s","n"', '"a","1"']


def test_prefix_directory_listing(spark):
    root = scratch_path(spark, "deep")
    df = spark.range(2).selectExpr("CAST(id AS STRING) AS v")
    write_csv(df, f"{root}/csv/feed-a/run-1")
    time.sleep(0.05)
    write_csv(df, f"{root}/csv/feed-b/run-1")
    assert latest_snapshot(spark, root, "csv/feed-a").endswith("/csv/feed-a/run-1")
    assert latest_snapshot(spark, root, "csv/feed").endswith("/csv/feed-b/run-1")
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, root, "missing/dir/x")


def test_partial_output_is_skipped(spark):
    import shutil
    root = scratch_path(spark, "partial")
    df = spark.range(3).selectExpr("CAST(id AS STRING) AS v")
    write_csv(df, f"{root}/feed/run-1")
    time.sleep(0.05)
    done = write_csv(df.limit(1), f"{root}/feed/run-2")
    # a later output whose commit did not finish: part files, no _SUCCESS marker
    partial = f"{root}/feed/run-3"
    time.sleep(0.05)
    shutil.copytree(done.replace("file:", ""), partial.replace("file:", ""), copy_function=shutil.copy,
                    ignore=shutil.ignore_patterns("_SUCCESS", "._SUCCESS.crc"))
    assert latest_snapshot(spark, root, "feed").endswith("/feed/run-2")


def test_many_incomplete_runs_are_no_limit(spark):
    import shutil
    root = scratch_path(spark, "many")
    df = spark.range(3).selectExpr("CAST(id AS STRING) AS v")
    done = write_csv(df, f"{root}/feed/run-00")
    for i in range(1, 13):
        shutil.copytree(done.replace("file:", ""), f"{root}/feed/run-{i:02d}".replace("file:", ""), copy_function=shutil.copy,
                        ignore=shutil.ignore_patterns("_SUCCESS", "._SUCCESS.crc"))
    assert latest_snapshot(spark, root, "feed").endswith("/run-00")
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, root, "feed/run-1")
