"""A feed kept as Parquet partitioned by ``hour``: each refresh costs O(new data).

The CSV refresh rewrites the whole retained window on every run.  Here the feed lives in
an ``hour=``-partitioned table and a refresh

* rewrites only the hours at or above ``max(seam, floor)`` (written aside, then moved in place of
  the old ones; older hours are left as they are), and
* drops whole ``hour=`` directories below the retention floor (metadata operations).

Hours that the new result lacks (their hits are gone from the source) are dropped as well,
so the table always equals a full export at ``now`` over the hours from the seam on.  A marker
kept during the run makes the next run redo the hours of a run that died in between.

Exporting the CSV form is then a plain read of the table.  Hours at or above the seam are
recomputed from the source, so late events in those hours are picked up; hours below the
seam are never re-read from the source.  :mod:`hitfeed.plans.hour_versions` keeps the same table through the
catalog: late events of any age, hours that readers never miss, and the CSV form.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitfeed.functions.timebounds import DAY, HOUR, floor_to, hours_ago_bound, strict_seam
from hitfeed.functions.render import render_nested
from hitfeed.operators.hits import explode_policies
from hitfeed.plans.feed import FeedSpec

_HOUR_DIR = re.compile(r"/hour=(-?\d+)(?=[;,/}]|$)")


@dataclass
class HourTableResult:
    path: str
    floor: int
    seam: int
    rewritten_from: int
    dropped_hours: list


def _hours(spark: SparkSession, path: str) -> set[int]:
    """The hours of the table's partition directories (one listing)."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return set()
    found = fs.globStatus(_fs(spark, f"{path.rstrip('/')}/hour=*")[1])
    names = (st.toString() for st in found)  # one call each: the text holds the path
    return {int(m[1]) for m in map(_HOUR_DIR.search, names) if m}


def _hour_path(spark: SparkSession, path: str, hour: int):
    return _fs(spark, f"{path.rstrip('/')}/hour={hour}")[1]


def refresh_hour_table(spark: SparkSession, logs: DataFrame, spec: FeedSpec, now: int, path: str, *,
                       hourly: bool = False, catch_up: bool = True, mode: str = "overlap",
                       buckets: int = 1) -> HourTableResult:
    """Bring the hour table at ``path`` up to ``now`` (creates it on the first run).

    The strict seam re-reads the last 1 or 24 hours.  With catch-up (the default) the seam also
    reaches back to the newest hour of the table, so missed runs leave no gap.  Rows are clustered by
    hour before the write: a task opens few files and an hour has at most ``buckets`` of them
    (raise it where one hour is too much for one task)."""
    if spec.day_range is not None or spec.hours_ago is None:
        raise ValueError("an hour table needs an hours_ago window")
    floor = hours_ago_bound(now, spec.hours_ago, spec.full_days)
    hours = _hours(spark, path)
    seam = strict_seam(now, hourly)
    if not hours:
        seam = floor                      # first run: build the whole window
    elif catch_up:
        seam = min(seam, floor_to(max(hours), DAY if spec.full_days else HOUR))
    lo = max(min([seam, *_pending(spark, path)]), floor)
    fresh = render_nested(explode_policies(logs.filter(F.col("hour") >= F.lit(lo)),
                                           spec.policy_column, spec.values, mode=mode))
    scalar = [f.name for f in fresh.schema.fields if f.name != "hour"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    clustered = fresh.repartition(n, "hour", F.pmod(F.xxhash64(*scalar), F.lit(int(buckets))))
    dropped = replace_hours(spark, path, lo, floor, lambda stage: clustered.write.partitionBy("hour").parquet(stage))
    return HourTableResult(path, floor, seam, lo, dropped)


def replace_hours(spark: SparkSession, path: str, lo: int, floor: int, write) -> list[int]:
    """Replace all hours from ``lo`` on of an ``hour=`` partitioned output by what ``write(stage)`` makes,
    and drop the hours below ``floor``; returns the hours that are gone.

    The stage is written completely before anything moves; a marker covers the moves (metadata operations)."""
    fs, root = _fs(spark, path)
    fs.mkdirs(root)
    stage = f"{path.rstrip('/')}/_stage-{uuid.uuid4().hex[:12]}"
    try:
        write(stage)
        _mark(spark, path, lo)
        dropped = drop_hours_below(spark, path, floor)
        new, old = _hours(spark, stage), {h for h in _hours(spark, path) if h >= lo}
        for h in sorted(old):
            fs.delete(_hour_path(spark, path, h), True)
        for h in sorted(new):
            if not fs.rename(_hour_path(spark, stage, h), _hour_path(spark, path, h)):
                raise RuntimeError(f"cannot publish hour {h} of {path}")
    finally:
        fs.delete(_fs(spark, stage)[1], True)
    _unmark(spark, path)
    return sorted({*dropped, *(old - new)})


_PENDING = "_rewriting-"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _mark(spark: SparkSession, path: str, lo: int) -> None:
    """A hidden file that names the hours being rewritten; gone once they are consistent."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{_PENDING}{lo}")
    marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(marker, True).close()


def _markers(spark: SparkSession, path: str) -> tuple[object, list]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [st.getPath() for st in fs.listStatus(root)] if fs.exists(root) else []
    return fs, [p for p in found if p.getName().startswith(_PENDING)]


def _pending(spark: SparkSession, path: str) -> list[int]:
    return [int(p.getName()[len(_PENDING):]) for p in _markers(spark, path)[1]]


def _unmark(spark: SparkSession, path: str) -> None:
    fs, markers = _markers(spark, path)
    for p in markers:
        fs.delete(p, False)


def drop_hours_below(spark: SparkSession, path: str, floor: int) -> list[int]:
    """Retention: delete whole ``hour=`` directories below ``floor`` (metadata operations,
    one listing of the table root).  Returns the dropped hours."""
    dropped = sorted(h for h in _hours(spark, path) if h < floor)
    for h in dropped:
        _fs(spark, path)[0].delete(_hour_path(spark, path, h), True)
    return dropped


def read_hour_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The feed rows, columns in feed order (``hour`` is read back from the directories)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def hour_table_to_csv(spark: SparkSession, path: str, output: str, columns: list[str] | None = None, *,
                      floor: int | None = None, num_partitions: int | None = None, single_file: bool = False,
                      filename: str | None = None, max_records_per_file: int | None = None) -> str:
    """The feed's CSV form, ordered by ``start_time``, read from the hour table only (the
    source logs are not touched).  ``floor`` restricts to hours at or above it (pruned)."""
    from hitfeed.sinks.csv import write_csv

    df = read_hour_table(spark, path, columns)
    if floor is not None:
        df = df.filter(F.col("hour") >= F.lit(int(floor)))
    return write_csv(df, output, order_by="start_time", num_partitions=num_partitions, single_file=single_file,
                     filename=filename, max_records_per_file=max_records_per_file)
