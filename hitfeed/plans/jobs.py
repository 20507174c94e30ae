"""The two feed jobs with their full parameter sets, composed from the library pieces.

``export_job``  -- full export of one feed to ``<base>/<output_dir>/<location hash>/``.
``refresh_job`` -- incremental refresh of the newest snapshot under ``input_root/prefix``.
(Partition sync is :func:`hitfeed.plans.sync.sync_partitions`.)

Both take ``now`` explicitly (default: the current time) so that runs are reproducible.
The salt is only used to compute the location and is never logged.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hitfeed.plans.export import export_feed
from hitfeed.plans.feed import FeedSpec
from hitfeed.plans.refresh import RefreshResult, refresh_feed
from hitfeed.sinks.csv import default_output_dir, feed_output_path, write_csv


@dataclass
class FeedTarget:
    """Where a feed goes: ``<base>/<output_dir>/<hash(salt, ordinal, subscriber, receiver)>``."""

    base: str
    salt: str
    ordinal: str
    subscriber: str
    receiver: str
    output_dir: str | None = None
    output_filename: str | None = None
    keep_original: bool = False
    target_dir: str | None = None  # put the stable name here instead of below the location
    single_file: bool = False  # one file (one task) instead of a directory of part files

    def __repr__(self) -> str:  # never show the salt
        return (f"FeedTarget(base={self.base!r}, ordinal={self.ordinal!r}, subscriber={self.subscriber!r}, "
                f"receiver={self.receiver!r}, output_dir={self.output_dir!r}, "
                f"output_filename={self.output_filename!r})")

    def location(self, now: int) -> str:
        out_dir = self.output_dir or default_output_dir(now)
        return feed_output_path(self.base, out_dir, self.salt, self.ordinal, self.subscriber, self.receiver)


def export_job(spark: SparkSession, logs: DataFrame, spec: FeedSpec, target: FeedTarget, *,
               now: int | None = None, order_by: str | None = None, mode: str = "overlap") -> str:
    """Write one feed.  With ``target.output_filename`` the feed is a directory of part files with that
    name, or one file with ``target.single_file`` (the original part file kept only with
    ``keep_original``).  Returns the written path."""
    now = int(now if now is not None else time.time())
    return write_csv(export_feed(logs, spec, now, mode=mode), target.location(now), order_by=order_by,
                     single_file=target.single_file, filename=target.output_filename,
                     keep_original=target.keep_original, target_dir=target.target_dir)


def refresh_job(spark: SparkSession, logs: DataFrame, spec: FeedSpec, target: FeedTarget, *, input_root: str,
                input_prefix: str = "", hourly: bool = False, catch_up: bool = False, now: int | None = None,
                refilter: bool = False, mode: str = "overlap") -> RefreshResult:
    """Refresh the newest snapshot under ``input_root/input_prefix`` into the target."""
    now = int(now if now is not None else time.time())
    return refresh_feed(spark, logs, spec, now, target.location(now), snapshot_root=input_root,
                        prefix=input_prefix, hourly=hourly, catch_up=catch_up, refilter=refilter, mode=mode,
                        single_file=target.single_file, filename=target.output_filename,
                        keep_original=target.keep_original, target_dir=target.target_dir)
