"""Incremental refresh of a feed (job B) instead of recomputing the whole window.

    kept = previous snapshot rows with  floor <= hour < seam
    new  = fresh hits with              hour >= max(seam, floor)
    out  = kept UNION ALL new, ordered by start_time

* ``floor`` -- retention bound of the feed (hours ago, optionally whole days).
* ``seam``  -- strict: start of the current hour minus 1 h (hourly runs) or 24 h (daily
  runs); catch-up: the later of ``floor`` and the last hour seen in the snapshot, which
  fills the gap left by missed runs.

Both parts are cut on ``hour`` (a column of the snapshot), so an event filed under a
different hour than its ``start_time`` is neither lost nor doubled at the seam, and the
result equals a full export at ``now`` whenever the previous snapshot covered everything
below the seam.  The four run counts are collected with ``observe`` in the write itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from hitfeed.functions.render import csv_safe
from hitfeed.functions.timebounds import (
    DAY, HOUR, MICROS, catchup_seam, floor_to, hours_ago_bound, strict_seam,
)
from hitfeed.operators.hits import explode_policies
from hitfeed.operators.ordering import sort_by_start_time
from hitfeed.plans.feed import FeedSpec
from hitfeed.schemas import target_columns
from hitfeed.sinks.csv import write_csv
from hitfeed.sources.notes import read_statistics
from hitfeed.sources.snapshots import latest_snapshot, read_snapshot


@dataclass
class RefreshResult:
    path: str
    snapshot: str
    floor: int
    seam: int
    metrics: dict = field(default_factory=dict)


def _num(col: str):
    return F.expr(f"try_cast(`{col}` AS BIGINT)")


def last_seen_hour(snapshot: DataFrame, aligner: int = HOUR) -> int | None:
    """Hour (or day) of the newest ``start_time`` in a snapshot; None when it has no rows."""
    v = snapshot.agg(F.max(_num("start_time")).alias("m")).first()["m"]
    return None if v is None else floor_to(int(v) // MICROS, aligner)


def noted_hour(spark: SparkSession, path: str, aligner: int = HOUR) -> tuple[bool, int | None]:
    """(whether the snapshot at ``path`` has a note of its own, :func:`last_seen_hour` from it): no job."""
    note = read_statistics(spark, path)
    newest = note.max_start_time if note else None
    return note is not None, None if newest is None else floor_to(int(newest) // MICROS, aligner)


def retained(floor: int):
    """Whether a snapshot row is at or above the retention floor."""
    return F.coalesce(_num("hour") >= F.lit(floor), F.lit(False))


def before_seam(seam: int):
    """Whether a snapshot row lies strictly before the re-query point."""
    return F.coalesce(_num("hour") < F.lit(seam), F.lit(False))


def refresh_plan(spark: SparkSession, logs: DataFrame, spec: FeedSpec, now: int, previous: DataFrame, *,
                 hourly: bool = False, catch_up: bool = False, refilter: bool = False,
                 mode: str = "overlap", path: str | None = None) -> tuple[DataFrame, list[str], int, int]:
    """The refresh as one tagged, all-text frame (unordered) plus ``(columns, floor, seam)``.

    With catch-up the newest event of the snapshot comes from its note, if it was written by this library and is
    at ``path``; any other snapshot is scanned for it.

    Tags: ``_new`` (fresh hit), ``_in_window`` (old row at or above the floor) and ``_keep``
    (row belongs to the output).  Old rows are filtered *after* the ordering step, so the
    run counts can be observed above the range sort: observers below it would also count
    the rows seen by the sort's sampling pass.  Old rows that are dropped carry only their
    ``start_time`` through the shuffle.
    """
    if spec.day_range is not None or spec.hours_ago is None:
        raise ValueError("a refresh needs an hours_ago window (day ranges are not refreshed)")
    columns = target_columns(logs.schema, spec.policy_column)
    floor = hours_ago_bound(now, spec.hours_ago, spec.full_days)
    in_window = retained(floor)
    if catch_up:
        unit = DAY if spec.full_days else HOUR
        noted, newest = noted_hour(spark, path, unit) if path else (False, None)
        seam = catchup_seam(floor, newest if noted else last_seen_hour(previous, unit))
    else:
        seam = strict_seam(now, hourly)
    keep = in_window & before_seam(seam)
    if refilter:
        keep = keep & F.coalesce(F.col("policy").isin(spec.values), F.lit(False))
    bad = _num("hour").isNull() | _num("start_time").isNull()
    # rows that only need counting keep just their sort key: they cross the range
    # shuffle at a few bytes each instead of with the whole row
    slim = [F.col(c) if c == "start_time" else F.when(keep, F.col(c)).alias(c) for c in columns]
    old = previous.select(*slim, F.lit(False).alias("_new"), in_window.alias("_in_window"), keep.alias("_keep"),
                          bad.alias("_rejected"))
    lo = max(seam, floor)
    fresh = explode_policies(logs.filter(F.col("hour") >= F.lit(lo)), spec.policy_column, spec.values, mode=mode)
    fresh = csv_safe(fresh).select(*columns, F.lit(True).alias("_new"), F.lit(True).alias("_in_window"),
                                   F.lit(True).alias("_keep"), F.lit(False).alias("_rejected"))
    return fresh.unionByName(old), columns, floor, seam


def _count_if(cond):
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def refresh_feed(spark: SparkSession, logs: DataFrame, spec: FeedSpec, now: int, output: str, *,
                 snapshot_root: str | None = None, prefix: str = "", previous: str | None = None,
                 hourly: bool = False, catch_up: bool = False, refilter: bool = False,
                 num_partitions: int | None = None, single_file: bool = False,
                 filename: str | None = None, max_records_per_file: int | None = None,
                 target_dir: str | None = None, keep_original: bool = False,
                 mode: str = "overlap") -> RefreshResult:
    """Find the newest snapshot (or use ``previous``), refresh it and write the new one,
    ordered by ``start_time``.  Run counts come from the write itself: ``input``,
    ``in_window``, ``kept``, ``new`` and ``rejected`` (old rows whose ``hour`` or
    ``start_time`` is not a number; they are dropped)."""
    if spec.day_range is not None or spec.hours_ago is None:
        raise ValueError("a refresh needs an hours_ago window (day ranges are not refreshed)")
    if previous is None:
        if snapshot_root is None:
            raise ValueError("give previous or snapshot_root")
        previous = latest_snapshot(spark, snapshot_root, prefix)
    columns = target_columns(logs.schema, spec.policy_column)
    prev = read_snapshot(spark, previous, columns)
    tagged, columns, floor, seam = refresh_plan(spark, logs, spec, now, prev, hourly=hourly,
                                                catch_up=catch_up, refilter=refilter, mode=mode, path=previous)
    ordered = sort_by_start_time(tagged, num_partitions)
    obs = Observation("refresh")
    old = ~F.col("_new")
    ordered = ordered.observe(
        obs,
        _count_if(old).alias("input"),
        _count_if(old & F.col("_in_window")).alias("in_window"),
        _count_if(old & F.col("_keep")).alias("kept"),
        _count_if(F.col("_new")).alias("new"),
        _count_if(F.col("_rejected")).alias("rejected"),
    )
    out = ordered.filter(F.col("_keep")).select(*columns)
    path = write_csv(out, output, single_file=single_file, filename=filename,
                     max_records_per_file=max_records_per_file, target_dir=target_dir,
                     keep_original=keep_original)
    metrics = {k: int(v or 0) for k, v in obs.get.items()}
    return RefreshResult(path, previous, floor, seam, metrics)
