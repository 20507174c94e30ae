"""Hourly "what is new since the last run" as a Structured Streaming job.

New log files under the root -> kind split -> explode + policy filter (stateless) -> appended to
an ``hour``-partitioned Parquet table.  The checkpoint remembers which files were processed, so a
re-run with no new files adds nothing; ``availableNow`` processes everything new and stops,
which suits a scheduled run.  Nothing is stateful, so no watermark is needed.

Each micro-batch is an ordinary write to ``hour=/batch=`` directories with dynamic partition overwrite:
a batch that is repeated after a failure replaces its own files and doubles nothing.  The result is
a plain Parquet table without a sink log, so retention (whole ``hour`` directories,
:func:`hitfeed.plans.hour_table.drop_hours_below`) needs nothing from its readers.

Late files: the file source forgets files older than ``max_file_age`` (against the newest file
seen), and ignores such files when they arrive late.  The default here keeps ten years; lower it
only where files never arrive later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hitfeed.functions.policies import parse_policy_list
from hitfeed.functions.render import render_nested
from hitfeed.operators.hits import explode_policies
from hitfeed.sources.logs import split_kind

MAX_FILE_AGE = "3650d"


def stream_hits(spark: SparkSession, root: str, schema: T.StructType, kind: str, policies: str | Sequence[str],
                output: str, checkpoint: str, *, policy_column: str = "parent_policies", delimiter: str = ",",
                max_file_age: str = MAX_FILE_AGE, max_files_per_trigger: int | None = None,
                available_now: bool = True, processing_time: str | None = None,
                mode: str = "overlap") -> StreamingQuery:
    """Start the stream of one kind's hits on ``policies`` (all hours: windows belong to readers)."""
    wanted = parse_policy_list(policies, delimiter)
    reader = spark.readStream.schema(schema).option("basePath", root).option("maxFileAge", max_file_age)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    logs = split_kind(reader.parquet(root), kind)
    hits = render_nested(explode_policies(logs, policy_column, wanted, mode=mode))

    def append(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("hour", "batch").parquet(output))

    writer = hits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def hits_schema(spark: SparkSession, source_schema: T.StructType, policy_column: str) -> T.StructType:
    """Schema of the stream's output, ``hour`` last (it is the directory column): the
    stream's own transformation applied to an empty frame."""
    empty = spark.createDataFrame([], source_schema)
    s = render_nested(explode_policies(empty, policy_column)).schema
    return T.StructType([f for f in s.fields if f.name != "hour"] + [s["hour"]])


def read_hits(spark: SparkSession, output: str, schema: T.StructType, floor: int | None = None) -> DataFrame:
    """The stream's hit table; with ``floor``, only hours at or above it (pruned).  The schema is
    given, so no file is opened to infer it."""
    df = spark.read.schema(schema).parquet(output).select(*schema.fieldNames())  # without the batch number
    return df if floor is None else df.filter(F.col("hour") >= F.lit(int(floor)))
