"""The check inputs: a policy-log view derived by Spark from the driver's ``events`` table.

Columns: ``event_id, start_time, user_id, event_type, parent_policies, annotations`` plus
the five partition columns.  It has null arrays, empty arrays, duplicate elements, both
kinds (``.proxy`` subscribers) and three subscribers.  ``start_time`` is computed without
any time zone (``events.ts`` is a ``timestamp_ntz``).

``partitioned_copy`` writes the view once per session and source directory as
``subscriber=/year=/month=/day=/hour=`` Parquet below the shared scratch folder, for the
checks that need real directories (listing, pruning, registration, streaming).
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from hitfeed.schemas import PARTITION_NAMES
from hitfeed.session import scratch_path

# Fixed values of the checks: "now" for all windows (2024-01-31 00:00 UTC)
NOW = 1706659200

POLICY_LOG_DDL = (
    "event_id bigint, start_time bigint, user_id bigint, event_type string, "
    "parent_policies array<string>, annotations map<string,string>, "
    "subscriber string, year int, month int, day int, hour int"
)

_POLICY_LOG_SQL = """
WITH e AS (
  -- epoch microseconds from the wall-clock parts: no time zone is involved
  SELECT *, unix_date(CAST(ts AS DATE)) * 86400000000L + hour(ts) * 3600000000L
            + minute(ts) * 60000000L + CAST(date_part('SECOND', ts) * 1000000 AS BIGINT) AS start_time
  FROM {events}
)
SELECT event_id, start_time, user_id, event_type,
  CASE WHEN user_id % 11 = 0 THEN CAST(NULL AS ARRAY<STRING>)
       WHEN user_id % 13 = 0 THEN CAST(array() AS ARRAY<STRING>)
       WHEN user_id % 5 = 0 THEN array(event_type, concat('p', CAST(user_id % 5 AS STRING)), event_type)
       ELSE array(event_type, concat('p', CAST(user_id % 5 AS STRING))) END AS parent_policies,
  map('k', get_json_object(props, '$.k'), 't', event_type) AS annotations,
  concat('sub.', CAST(user_id % 3 AS STRING),
         CASE WHEN user_id % 2 = 0 THEN '.proxy' ELSE '' END) AS subscriber,
  year(ts) AS year, month(ts) AS month, day(ts) AS day,
  CAST((start_time div 3600000000) * 3600 AS INT) AS hour
FROM e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.sparkSession.sql(_POLICY_LOG_SQL, events=events)


_copies: dict[tuple, str] = {}
_lock = threading.Lock()


def partitioned_copy(spark: SparkSession, sf_dir: str) -> str:
    """Root of a ``subscriber=/year=/month=/day=/hour=`` Parquet copy of ``policy_log``."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _lock:
        if key not in _copies:
            path = scratch_path(spark, "policy-log")
            write_partitioned(policy_log(spark, sf_dir), path)
            _copies[key] = path
        return _copies[key]


def in_hour_order(df: DataFrame, columns: Sequence[Column] | None = None) -> DataFrame:
    """The rows of each hour directory in one task.  The partition count is explicit: with
    ``repartition(*cols)`` alone AQE coalesces a small shuffle into very few tasks, and one
    task would then create thousands of directories serially (75 s instead of 20 s for the
    3,887 partitions of sf0.01 here).

    ``columns`` (the partition columns among them, unchanged) are computed from ``df`` above
    the exchange and the sort, so that only the columns of ``df`` are shuffled and sorted.
    The sort is the order in which the partitioned writer wants its rows: it adds no other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *PARTITION_NAMES)
    return dealt.sortWithinPartitions(*PARTITION_NAMES).select(*columns) if columns else dealt


def write_partitioned(df: DataFrame, path: str, mode: str = "errorifexists", columns: Sequence[Column] | None = None) -> None:
    """Each hour directory gets one file, of ``df`` or of ``columns`` computed from it."""
    in_hour_order(df, columns).write.mode(mode).partitionBy(*PARTITION_NAMES).parquet(path)
