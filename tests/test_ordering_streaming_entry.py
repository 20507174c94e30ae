"""Global ordinal, the streaming job, and the driver contract."""

import os

import pytest

from pyspark.sql import Window, functions as F

from hitfeed.fixtures import NOW, POLICY_LOG_DDL, write_partitioned
from hitfeed.operators.ordering import with_global_ordinal
from hitfeed.plans.export import export_feed
from hitfeed.plans.feed import FeedSpec
from hitfeed.schemas import struct_from_ddl
from hitfeed.session import scratch_path
from hitfeed.streaming.hits_stream import stream_hits


def test_global_ordinal(spark, small_log):
    hits = export_feed(small_log, FeedSpec(parent_policies="view,p1,error", hours_ago=720), NOW)
    keys = ["start_time"] + [c for c in hits.columns if c != "start_time"]
    got = with_global_ordinal(hits, 5, tiebreak=keys)
    want = hits.select("*", F.row_number().over(Window.orderBy(*keys)).alias("ordinal"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_global_ordinal_of_many_rows(spark, reuse):
    """Distinct, gapless and in order, whatever exchanges Spark reuses; few distinct sort keys."""
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(400_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("start_time"), (F.col("id") % 1000).alias("k"),
                                         F.col("id").cast("string").alias("payload"))
        for tiebreak in (["k"], None):
            got = with_global_ordinal(df, 8, tiebreak=tiebreak)
            r = got.agg(F.count_distinct("ordinal").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi")).first()
            assert tuple(r) == (400_000, 1, 400_000)
            firsts = got.groupBy("start_time").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi")).orderBy("start_time").collect()
            assert all(a["hi"] + 1 == b["lo"] for a, b in zip(firsts, firsts[1:]))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_range_key_is_narrow(spark, small_log):
    from hitfeed.operators.ordering import sort_by_start_time
    plan = sort_by_start_time(small_log, 4)._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.split("\n") if "rangepartitioning" in line)
    assert exchange.count("ASC NULLS LAST") == 2 and "xxhash64" in plan


def test_stream_only_new_files(spark, small_log):
    schema = struct_from_ddl(POLICY_LOG_DDL)
    root, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    write_partitioned(small_log.filter("day = 29"), root)
    stream_hits(spark, root, schema, "dns", "error,p3", out, ckpt).awaitTermination()
    n1 = spark.read.parquet(out).count()
    stream_hits(spark, root, schema, "dns", "error,p3", out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == n1  # re-run without new files adds nothing
    write_partitioned(small_log.filter("day = 30"), root, mode="append")
    stream_hits(spark, root, schema, "dns", "error,p3", out, ckpt).awaitTermination()
    dns = ~F.col("subscriber").endswith(".proxy")
    want = export_feed(small_log.filter("day IN (29, 30)").filter(dns), FeedSpec(parent_policies="error,p3", hours_ago=720), NOW)
    got = spark.read.parquet(out)
    assert got.count() == want.count() > n1
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "policy" in df.columns
    from hitfeed.registry import QUERIES
    q, o = e.queries(), e.oracle_sql()
    assert set(QUERIES) <= set(q) and set(QUERIES) <= set(o) <= set(q)
    assert os.path.exists(os.path.join(os.path.dirname(e.__file__), "bench.py"))


def test_repeated_batch_replaces_itself(spark, small_log):
    """A micro-batch that is run again after a failure (its commit lost) doubles nothing."""
    schema = struct_from_ddl(POLICY_LOG_DDL)
    root, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    write_partitioned(small_log.filter("day = 29"), root)
    stream_hits(spark, root, schema, "proxy", ["error", "p3"], out, ckpt).awaitTermination()
    n = spark.read.parquet(out).count()
    commit = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ckpt, "commits/0")
    fs = commit.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.delete(commit, False)
    stream_hits(spark, root, schema, "proxy", ["error", "p3"], out, ckpt).awaitTermination()
    assert n > 0 and spark.read.parquet(out).count() == n


def test_stream_retention(spark, small_log):
    from hitfeed.plans.hour_table import drop_hours_below
    from hitfeed.streaming.hits_stream import hits_schema, read_hits
    schema = struct_from_ddl(POLICY_LOG_DDL)
    root, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    write_partitioned(small_log.filter("day IN (28, 29)"), root)
    stream_hits(spark, root, schema, "dns", "error,p3", out, ckpt).awaitTermination()
    floor = 1706486400  # 2024-01-29 00:00: drop day 28
    dropped = drop_hours_below(spark, out, floor)
    assert dropped and max(dropped) < floor
    out_schema = hits_schema(spark, schema, "parent_policies")
    got = read_hits(spark, out, out_schema)  # no floor needed: nothing lists the deleted files
    dns = ~F.col("subscriber").endswith(".proxy")
    want = export_feed(small_log.filter("day = 29").filter(dns), FeedSpec(parent_policies="error,p3", hours_ago=720), NOW)
    assert got.count() == want.count()
    # the stream keeps going after retention
    write_partitioned(small_log.filter("day = 30"), root, mode="append")
    stream_hits(spark, root, schema, "dns", "error,p3", out, ckpt).awaitTermination()
    assert read_hits(spark, out, out_schema, floor).count() == want.count() + export_feed(
        small_log.filter("day = 30").filter(dns), FeedSpec(parent_policies="error,p3", hours_ago=720), NOW).count()
