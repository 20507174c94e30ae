"""Log readers, kind split, union view and source naming.

DNS and proxy logs share one root; they are told apart only by the subscriber directory:
a subscriber ending in ``.proxy`` holds proxy logs.  The kind test is on the ``subscriber``
partition column, so it prunes directories.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hitfeed.schemas import PROXY_SUFFIX, normalize_kind, schema_for


def kind_predicate(kind: str, column: str = "subscriber") -> Column:
    is_proxy = F.col(column).endswith(PROXY_SUFFIX)
    return is_proxy if normalize_kind(kind) == "proxy" else ~is_proxy


def split_kind(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind: ``proxy`` keeps ``.proxy`` subscribers, ``dns`` the others."""
    return df.filter(kind_predicate(kind))


def read_logs(spark: SparkSession, root: str, schema: T.StructType, kind: str | None = None) -> DataFrame:
    """Partitioned Parquet scan with an explicit schema (never inferred)."""
    df = spark.read.schema(schema).option("basePath", root).parquet(root)
    return split_kind(df, kind) if kind else df


def read_dns(spark: SparkSession, root: str) -> DataFrame:
    return read_logs(spark, root, schema_for("dns"), "dns")


def read_proxy(spark: SparkSession, root: str) -> DataFrame:
    return read_logs(spark, root, schema_for("proxy"), "proxy")


def read_table(spark: SparkSession, table: str, kind: str | None = None) -> DataFrame:
    """A catalog table over the log root.  Only registered partitions are visible and the
    window and kind predicates prune them in the catalog (no storage listing).  The kind
    split is applied whatever is registered: a repair of the shared root also registers
    the other kind's directories."""
    df = spark.table(table)
    return split_kind(df, kind) if kind else df


def union_view(frames: Sequence[DataFrame], name: str | None = None) -> DataFrame:
    """UNION ALL over per-subscriber tables, by column name (not position).  All inputs must
    have the same columns and types; a mismatch is an error, not a silent shift."""
    if not frames:
        raise ValueError("no tables to union")
    first = {f.name: f.dataType for f in frames[0].schema.fields}
    for i, df in enumerate(frames[1:], 1):
        other = {f.name: f.dataType for f in df.schema.fields}
        if other != first:
            raise ValueError(f"table {i} does not match table 0: {sorted(set(other.items()) ^ set(first.items()), key=str)}")
    out = reduce(lambda a, b: a.unionByName(b), frames)
    if name:
        out.createOrReplaceTempView(name)
    return out


def source_names(df: DataFrame, bucket: str = "bucket", prefix: str | None = None) -> DataFrame:
    """Adds ``database_name`` (``prefix_bucket`` with ``-`` and ``.`` replaced by ``_``) and
    ``subscriber_name`` (bucket text before the first ``-``)."""
    b = F.col(bucket)
    full = F.concat(F.lit(f"{prefix}-"), b) if prefix else b
    return df.select(
        "*",
        F.translate(full, "-.", "__").alias("database_name"),
        F.split(b, "-", 2)[0].alias("subscriber_name"),
    )
