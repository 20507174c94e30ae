"""Partition sync (job C): register partitions that arrived in storage since the last run.

stored (parallel listing) -> kind split -> anti join with the catalog's list -> chunked
``ALTER TABLE ADD IF NOT EXISTS PARTITION``.  The missing list is checkpointed before the
catalog changes, so the returned frame still shows what was added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hitfeed.session import scratch_root
from hitfeed.sources.partitions import (
    add_partitions, missing_partitions, registered_partitions, stored_locations, window_days,
)


@dataclass
class SyncResult:
    added: DataFrame
    count: int


def sync_partitions(spark: SparkSession, table: str, root: str, kind: str | None = None, *,
                    chunk: int = 500, lookback_hours: int | None = None, now: int | None = None) -> SyncResult:
    """Register what is in storage but not in the catalog.  By default all of storage is
    listed; with ``lookback_hours`` only partitions from ``now - lookback_hours`` on (an
    hourly run lists a few day directories instead of the whole history).  Partitions that land
    later than the lookback are found by a run without it: schedule one, e.g. daily, beside the
    hourly runs.  Every partition is registered with the directory found in storage."""
    scratch_root(spark)  # makes sure a checkpoint folder is set
    since = None
    if lookback_hours is not None:
        import time
        t = int(now if now is not None else time.time())
        since = t - 3600 * int(lookback_hours)
    stored = stored_locations(spark, root, kind, since_hour=since, until=now)
    registered = registered_partitions(spark, table, None if since is None else window_days(since, now))
    missing = missing_partitions(stored, registered).checkpoint()
    n = add_partitions(spark, table, missing, chunk=chunk)
    return SyncResult(missing, n)
