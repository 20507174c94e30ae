"""Packing the stream's hits."""

import uuid

from pyspark.sql import functions as F

from hitfeed.fixtures import NOW
from hitfeed.functions.render import render_nested
from hitfeed.operators.hits import explode_policies
from hitfeed.plans.hour_versions import HourOutput
from hitfeed.session import scratch_path
from hitfeed.streaming.compaction import compact_hits, read_packed
from hitfeed.streaming.hits_stream import hits_schema

H = 3600


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_closed_hours_are_packed(spark, small_log):
    schema = hits_schema(spark, small_log.schema, "parent_policies")
    hits = render_nested(explode_policies(small_log.filter(f"hour >= {NOW - 12 * H}"), "parent_policies")).select(*schema.fieldNames())
    out, table = scratch_path(spark, "stream"), HourOutput(f"packed_{uuid.uuid4().hex[:8]}", scratch_path(spark, "packed"))

    def batch(rows, number):  # as the stream writes one
        (rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("hour", "batch").parquet(out))

    late = hits.filter("event_id % 6 = 5")
    for i in range(5):
        batch(hits.filter(f"event_id % 6 = {i}"), i)
    closed = NOW - 4 * H
    files = lambda hour=None: [f for f in spark.table(table.table).inputFiles() if hour is None or f"hour={hour}/" in f]
    first = compact_hits(spark, out, schema, closed, table)
    hours = {r[0] for r in hits.filter("event_id % 6 <> 5").filter(F.col("hour") < closed).select("hour").distinct().collect()}
    assert set(first.changed) == hours and all(len(files(h)) == 1 for h in hours)
    assert same(read_packed(spark, out, schema, table), hits.filter("event_id % 6 <> 5"))
    before = sorted(files())
    assert compact_hits(spark, out, schema, closed, table).changed == [] and sorted(files()) == before  # a re-run changes nothing
    batch(late, 5)  # late hits of closed hours, too
    again = compact_hits(spark, out, schema, closed, table)
    assert set(again.changed) == {r[0] for r in late.filter(F.col("hour") < closed).select("hour").distinct().collect()}
    assert same(read_packed(spark, out, schema, table), hits)
    split = compact_hits(spark, out, schema, NOW + H, HourOutput(table.table + "_s", table.root + "-s"), target_bytes=1500)
    per_hour = {}
    for f in spark.table(table.table + "_s").inputFiles():
        h = int(f.split("hour=")[1].split("/")[0])
        per_hour[h] = per_hour.get(h, 0) + 1
    assert set(per_hour) == set(split.changed) and max(per_hour.values()) > 1
    gone = compact_hits(spark, out, schema, closed, table, floor=NOW - 8 * H)
    assert gone.dropped and max(gone.dropped) < NOW - 8 * H


def test_nothing_to_pack(spark, small_log):
    schema = hits_schema(spark, small_log.schema, "parent_policies")
    hits = render_nested(explode_policies(small_log.filter(f"hour >= {NOW - 3 * H}"), "parent_policies"))
    out, table = scratch_path(spark, "stream"), HourOutput(f"packed_{uuid.uuid4().hex[:8]}", scratch_path(spark, "packed"))
    hits.withColumn("batch", F.lit(0)).write.partitionBy("hour", "batch").parquet(out)
    assert compact_hits(spark, out, schema, 0, table).changed == []
    assert same(read_packed(spark, out, schema, table), hits.select(*schema.fieldNames()))
