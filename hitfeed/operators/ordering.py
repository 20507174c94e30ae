"""Ordering of a feed by ``start_time``.

Sorting happens on the numeric value (``try_cast`` when the column is text, as in a
snapshot), with a 64-bit hash of the row as tie-break.  The range key is therefore 16 bytes
however wide a row is: that is all that the range sampler brings to the driver.  The order is
deterministic, and one ``start_time`` value that holds a large share of the rows is spread over
several partitions by the hash.  The ordered output is range-partitioned: part files are in
global order and no single task sees all rows.

``with_global_ordinal`` numbers the ordered rows 1..n without a single-partition window.  The ranged
rows are written once below the shared scratch folder, each with its range and its place
there; the counts per range (one row per range) and the numbering read the same stored rows,
so both see the same ranges whatever Spark reuses or recomputes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from hitfeed.session import scratch_path


def sort_keys(df: DataFrame, key: str = "start_time", tiebreak: Sequence[str] | None = None) -> list[Column]:
    if key not in df.columns:
        raise ValueError(f"no column {key!r}")
    k = F.col(key)
    if not isinstance(df.schema[key].dataType, T.NumericType):
        k = F.expr(f"try_cast(`{key}` AS BIGINT)")
    if tiebreak is None:
        rest = [row_hash(df, key)]
    else:
        rest = [F.col(c) for c in tiebreak if c != key]
    return [k.asc_nulls_last()] + [c.asc_nulls_last() for c in rest]


def row_hash(df: DataFrame, key: str) -> Column:
    """64-bit hash of all columns but ``key`` (maps, which cannot be hashed, as JSON text)."""
    cols = [F.to_json(F.struct(f.name)) if _has_map(f.dataType) else F.col(f.name) for f in df.schema.fields if f.name != key]
    return F.xxhash64(*cols) if cols else F.lit(0)


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, T.MapType)


def sort_by_start_time(df: DataFrame, num_partitions: int | None = None, *,
                       key: str = "start_time", tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Globally ordered, range-partitioned (``num_partitions`` ranges; default: the
    session's shuffle partition count)."""
    keys = sort_keys(df, key, tiebreak)
    if num_partitions is None:
        return df.orderBy(*keys)
    return df.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)


def with_global_ordinal(df: DataFrame, num_partitions: int | None = None, *, key: str = "start_time",
                        tiebreak: Sequence[str] | None = None, name: str = "ordinal") -> DataFrame:
    """``df`` ordered as :func:`sort_by_start_time`, plus a 1-based global position."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sort_by_start_time(df, n, key=key, tiebreak=tiebreak)
    path = scratch_path(df.sparkSession, "ordinal")
    ranged.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")).write.parquet(path)
    local = df.sparkSession.read.parquet(path)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: a size fixed by n
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    )
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (local.join(F.broadcast(offsets), "_pid")
            .select(*[F.col(c) for c in df.columns],
                    (F.coalesce(F.col("_off"), F.lit(0)) + pos + F.lit(1)).alias(name)))
