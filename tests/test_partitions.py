"""Partition listing, registration and sync (idempotent)."""

import pytest
from pyspark.sql import Row, functions as F

from hitfeed.fixtures import policy_log, write_partitioned
from hitfeed.plans.sync import sync_partitions
from hitfeed.session import scratch_path
from hitfeed.sources.partitions import (
    add_partitions, create_log_table, partition_spec_sql, registered_partitions, repair_partitions,
    stored_partitions,
)
from conftest import SF_SMALL

KEYS = ["subscriber", "year", "month", "day", "hour"]


@pytest.fixture(scope="module")
def few_days(spark):
    log = policy_log(spark, SF_SMALL).filter(F.col("day").isin(28, 29))
    root = scratch_path(spark, "parts")
    write_partitioned(log, root)
    return log, root


def _new_table(spark, log, root):
    name = "hitfeed_t_" + scratch_path(spark, "x").rsplit("-", 1)[1]
    create_log_table(spark, name, log.schema, root)
    return name


def test_stored_matches_data(spark, few_days):
    log, root = few_days
    stored = stored_partitions(spark, root)
    want = log.select(*KEYS).distinct()
    assert stored.count() == want.count() and stored.exceptAll(want).count() == 0
    assert stored_partitions(spark, root, "proxy").filter(~F.col("subscriber").endswith(".proxy")).count() == 0
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string" in plan and "content" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_sync_then_nothing_missing(spark, few_days):
    log, root = few_days
    name = _new_table(spark, log, root)
    first = sync_partitions(spark, name, root, kind="dns")
    n_dns = log.filter(~F.col("subscriber").endswith(".proxy")).select(*KEYS).distinct().count()
    assert first.count == n_dns and first.added.count() == n_dns
    assert sync_partitions(spark, name, root, kind="dns").count == 0
    assert registered_partitions(spark, name).count() == n_dns
    # the table now reads exactly the dns rows
    assert spark.table(name).count() == log.filter(~F.col("subscriber").endswith(".proxy")).count()


def test_add_with_location_and_repair(spark, few_days):
    log, root = few_days
    name = _new_table(spark, log, root)
    one = stored_partitions(spark, root).orderBy(*KEYS).limit(1)
    assert add_partitions(spark, name, one, root=root) == 1
    assert add_partitions(spark, name, one, root=root) == 1  # IF NOT EXISTS: no error
    assert registered_partitions(spark, name).count() == 1
    assert add_partitions(spark, name, []) == 0
    repair_partitions(spark, name)
    assert registered_partitions(spark, name).count() == log.select(*KEYS).distinct().count()


def test_spec_literals():
    row = Row(subscriber="it's", year=2021, month=1, day=19, hour=1611082800)
    assert partition_spec_sql(row) == ("PARTITION (subscriber='it\\'s', year=2021, month=1, day=19, "
                                       "hour=1611082800)")
    assert partition_spec_sql(row, "/r/").endswith(
        "LOCATION '/r/subscriber=it\\'s/year=2021/month=1/day=19/hour=1611082800'")


def test_incremental_listing(spark, few_days):
    from hitfeed.fixtures import NOW
    log, root = few_days
    since = NOW - 30 * 3600  # 2024-01-29 18:00
    recent = stored_partitions(spark, root, since_hour=since, until=NOW)
    want = log.filter(F.col("hour") >= since).select(*KEYS).distinct()
    assert recent.count() == want.count() and recent.exceptAll(want).count() == 0
    assert stored_partitions(spark, root, since_hour=NOW + 10 * 86400, until=NOW + 11 * 86400).count() == 0
    name = _new_table(spark, log, root)
    res = sync_partitions(spark, name, root, lookback_hours=30, now=NOW)
    assert res.count == want.count()


def test_escaped_partition_values(spark):
    from pyspark.sql import types as T
    schema = T.StructType.fromDDL("v int, subscriber string, year int, month int, day int, hour int")
    df = spark.createDataFrame([(1, "sub:a=b+c%", 2024, 1, 2, 1704160800), (2, "plain", 2024, 1, 2, 1704160800)],
                               schema)
    root = scratch_path(spark, "esc")
    write_partitioned(df, root)
    got = {r["subscriber"] for r in stored_partitions(spark, root).collect()}
    assert got == {"sub:a=b+c%", "plain"}
    name = "hitfeed_esc_" + root.rsplit("-", 1)[1]
    create_log_table(spark, name, schema, root)
    assert sync_partitions(spark, name, root).count == 2
    assert {r["subscriber"] for r in registered_partitions(spark, name).collect()} == got
    assert sorted(r["v"] for r in spark.table(name).collect()) == [1, 2]
    assert sync_partitions(spark, name, root).count == 0


def test_repair_registers_both_kinds_reader_splits(spark, few_days):
    from hitfeed.sources.logs import read_table
    log, root = few_days
    name = _new_table(spark, log, root)
    repair_partitions(spark, name)  # registers every directory, proxy ones too
    registered = registered_partitions(spark, name)
    assert registered.filter(F.col("subscriber").endswith(".proxy")).count() > 0
    dns = read_table(spark, name, "dns")
    assert dns.filter(F.col("subscriber").endswith(".proxy")).count() == 0
    assert dns.count() == log.filter(~F.col("subscriber").endswith(".proxy")).count()
    plan = dns._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EndsWith(subscriber" in plan


def test_padded_and_escaped_directories(spark):
    """The directory found in storage is the location, however its values are spelled."""
    from pyspark.sql import types as T
    schema = T.StructType.fromDDL("v int, subscriber string, year int, month int, day int, hour int")
    root = scratch_path(spark, "padded")
    text = spark.createDataFrame([(1, "a:b", "2024", "01", "02", "1704160800"), (2, "p", "2024", "01", "02", "1704160800")],
                                 "v int, subscriber string, year string, month string, day string, hour string")
    write_partitioned(text, root)
    for lookback in (None, 24):
        name = "hitfeed_pad_" + scratch_path(spark, "x").rsplit("-", 1)[1]
        create_log_table(spark, name, schema, root)
        assert sync_partitions(spark, name, root, lookback_hours=lookback, now=1704164400).count == 2
        assert sorted(map(tuple, spark.table(name).select("v", "subscriber", "month", "day").collect())) == [(1, "a:b", 1, 2), (2, "p", 1, 2)]
        assert sync_partitions(spark, name, root).count == 0
