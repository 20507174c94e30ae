"""Packing the stream's hits: few files for every closed hour.

The stream writes a directory for each hour and micro-batch, so an hour collects as many small files as
batches touched it.  :func:`compact_hits` copies the closed hours into an hour table in the catalog
(:mod:`hitfeed.plans.hour_versions`), each as files of about ``target_bytes``, and publishes them hour by hour: a
reader of the table sees an hour packed as it was or as it is now, and nothing that the stream writes is touched.

An hour is packed again only when its files changed: a late batch for a closed hour brings that hour back, a run
without new batches writes nothing, and a run that died is made up for.  :func:`read_packed` reads the packed hours
from the table and all others from the stream's own directories.  Once an hour is packed, its stream directories are
only needed for late batches; ``drop_hours_below`` removes them with the hour's retention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hitfeed.plans.hour_versions import (
    KEEP_SECONDS, HourOutput, HourRun, Note, create_output, hours_in, read_note, replace_hours,
)
from hitfeed.sources.partitions import hour_versions
from hitfeed.streaming.hits_stream import read_hits

TARGET_BYTES = 128 << 20


def compact_hits(spark: SparkSession, output: str, schema: T.StructType, closed_before: int, table: HourOutput, *,
                 floor: int | None = None, target_bytes: int = TARGET_BYTES, keep_seconds: int = KEEP_SECONDS) -> HourRun:
    """Pack the hours of the stream's ``output`` below ``closed_before`` (and at or above ``floor``)."""
    found = hour_versions(spark, output).filter(F.col("hour") < F.lit(int(closed_before)))
    if floor is not None:
        found = found.filter(F.col("hour") >= F.lit(int(floor)))
    stored = {int(r["hour"]): r for r in found.collect()}  # a row per closed hour
    note = read_note(spark, table)
    versions = {h: r["version"] for h, r in stored.items()}
    changed = {h for h, v in versions.items() if note.hours.get(h, ("",))[0] != v or h in note.pending}
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    create_output(spark, table, [(c, t) for c, t in kinds.items() if c != "hour"], kinds["hour"])
    rows = None
    if changed:
        files = [(h, max(1, -(-stored[h]["bytes"] // target_bytes))) for h in sorted(changed)]
        hits = read_hits(spark, output, schema).filter(hours_in(changed))
        scalar = [f.name for f in schema.fields if isinstance(f.dataType, T.AtomicType)]
        part = F.pmod(F.xxhash64(*scalar), F.col("_files"))
        many = spark.createDataFrame(files, "hour long, _files long")
        rows = hits.join(many.withColumn("hour", F.col("hour").cast(schema["hour"].dataType)), "hour").select(*schema.fieldNames(), "_files")
        n = max(1, min(sum(f for _, f in files), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = rows.repartition(n, "hour", part).drop("_files")
    run, dropped = replace_hours(spark, table, rows, Note(note.spec, note.hours, note.pending), versions, changed, keep_seconds)
    return HourRun(table.table, run, floor or 0, sorted(changed), dropped)


def read_packed(spark: SparkSession, output: str, schema: T.StructType, table: HourOutput) -> DataFrame:
    """Every hit once: packed hours from the table, the others from the stream's directories."""
    packed = set(read_note(spark, table).hours)
    open_ = read_hits(spark, output, schema).filter(~hours_in(packed))
    if not packed:
        return open_
    return spark.table(table.table).filter(hours_in(packed)).select(*schema.fieldNames()).unionByName(open_)
