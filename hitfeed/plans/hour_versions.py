"""Hour outputs published through the catalog: each hour is old or new, never missing.

An output (:class:`HourOutput`) is a catalog table partitioned by ``hour``.  A run writes the hours that it
changes into a directory of its own and then points the table's partitions there (``ALTER TABLE ... ADD
PARTITION / PARTITION ... SET LOCATION / DROP PARTITION``).  No file that a reader may hold is moved; directories
that no partition points to any more are removed by later runs, once they are ``keep_seconds`` old.

Which hours change is decided by *versions*: for each hour a text that tells what the hour is made of.

* Over stored logs (``source_root``) it comes from the names, times and sizes of the hour's files
  (:func:`hitfeed.sources.partitions.hour_versions`; a listing, no file is opened).  Exactly the hours whose
  files changed since the last run are rewritten, however old they are: late events need no seam.
* Over any other frame the hours from the seam on are rewritten, as in :mod:`hitfeed.plans.hour_table`.

The versions of an output are a small JSON note (an entry per retained hour) that the table's properties name.  Before
a run publishes, it notes the hours that it is about to; naming the new versions is its last step.  So the run
after one that died writes those hours again.  The CSV form (:func:`refresh_hours_csv`) compares its own note with the note of the
table it is made of.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitfeed.functions.render import csv_safe, render_nested
from hitfeed.functions.timebounds import DAY, HOUR, floor_to, hours_ago_bound, strict_seam
from hitfeed.operators.hits import explode_policies
from hitfeed.operators.ordering import sort_keys
from hitfeed.plans.feed import FeedSpec
from hitfeed.sinks.csv import CSV_WRITE_OPTIONS
from hitfeed.sources.partitions import hour_versions
from hitfeed.sources.snapshots import CSV_READ_OPTIONS

_NOTE = "hitfeed.note"
#: Age at which a directory that no partition points to is removed: longer than any reader takes.
KEEP_SECONDS = 24 * HOUR


@dataclass(frozen=True)
class HourOutput:
    """A catalog table over runs below ``root``."""

    table: str
    root: str
    format: str = "parquet"

    def run_dir(self, run: str) -> str:
        return f"{self.root.rstrip('/')}/run-{run}"


@dataclass
class Note:
    """What an output was made of: its spec, the version and run of each hour, and the hours that a run was about
    to publish (it died if they are still there)."""

    spec: str = ""
    hours: dict[int, tuple[str, str]] = field(default_factory=dict)
    pending: list[int] = field(default_factory=list)


@dataclass
class HourRun:
    table: str
    run: str
    floor: int
    changed: list[int]
    dropped: list[int]


def _sql(spark: SparkSession, statement: str) -> DataFrame:
    """Every catalog statement of a run goes through here, one step each."""
    return spark.sql(statement)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_output(spark: SparkSession, out: HourOutput, columns: list[tuple[str, str]], hour_type: str) -> None:
    """The table, empty, if there is none; ``columns`` without ``hour``."""
    given = CSV_WRITE_OPTIONS | CSV_READ_OPTIONS if out.format == "csv" else {}
    options = ", ".join(f"{_text(k)} {_text(v)}" for k, v in given.items())
    _sql(spark, f"CREATE TABLE IF NOT EXISTS {out.table} ({', '.join(f'`{c}` {t}' for c, t in columns)}, hour {hour_type}) "
                f"USING {out.format} {f'OPTIONS ({options}) ' if options else ''}PARTITIONED BY (hour) LOCATION {_text(out.root)}")


def read_note(spark: SparkSession, out: HourOutput) -> Note:
    """The note that the table's properties name; an empty one for a new table."""
    if not spark.catalog.tableExists(out.table):
        return Note()
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {out.table}").collect()}.get(_NOTE)
    if not found:
        return Note()
    fs, p = _fs(spark, found)
    stream = fs.open(p)
    try:
        raw = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Note(raw["spec"], {int(h): tuple(v) for h, v in raw["hours"].items()}, raw["pending"])


def write_note(spark: SparkSession, out: HourOutput, note: Note, run: str) -> None:
    """Store the note and name it."""
    path = f"{out.root.rstrip('/')}/_note-{run}{'-pending' if note.pending else ''}.json"
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(json.dumps({"spec": note.spec, "hours": note.hours, "pending": note.pending}).encode())
    finally:
        stream.close()
    _sql(spark, f"ALTER TABLE {out.table} SET TBLPROPERTIES ({_text(_NOTE)} = {_text(path)})")


def hours_in(hours: Iterable[int], column: str = "hour") -> Column:
    """``column`` is one of ``hours``: ranges of adjacent hours, as literals for partition pruning."""
    out, first, last = None, None, None
    for h in [*sorted(set(hours)), None]:
        if first is not None and (h is None or h - last > HOUR):
            part = F.col(column).between(first, last)
            out = part if out is None else out | part
            first = None
        if first is None:
            first = h
        last = h
    return F.lit(False) if out is None else out


def _written(spark: SparkSession, directory: str) -> set[int]:
    """Hours that a run wrote (one listing of its directory)."""
    fs, p = _fs(spark, directory)
    if not fs.exists(p):
        return set()
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return {int(m[1]) for m in (re.match(r"hour=(-?\d+)$", n) for n in names) if m}


def registered_hours(spark: SparkSession, out: HourOutput) -> set[int]:
    return {int(r["partition"].split("=", 1)[1]) for r in spark.sql(f"SHOW PARTITIONS {out.table}").collect()}


def publish_hours(spark: SparkSession, out: HourOutput, run: str, written: set[int], gone: set[int], chunk: int = 500) -> None:
    """Point the partitions of ``written`` to the run's directories, and drop those of ``gone``.

    Each hour changes in one catalog statement; statements for hours that are new, or that go, are batched."""
    there = registered_hours(spark, out)
    at = lambda h: _text(f"{out.run_dir(run)}/hour={h}")
    new = sorted(written - there)
    for i in range(0, len(new), chunk):
        _sql(spark, f"ALTER TABLE {out.table} ADD IF NOT EXISTS " + " ".join(
            f"PARTITION (hour={h}) LOCATION {at(h)}" for h in new[i:i + chunk]))
    for h in sorted(written & there):
        _sql(spark, f"ALTER TABLE {out.table} PARTITION (hour={h}) SET LOCATION {at(h)}")
    old = sorted(gone & there)
    for i in range(0, len(old), chunk):
        _sql(spark, f"ALTER TABLE {out.table} DROP IF EXISTS " + ", ".join(f"PARTITION (hour={h})" for h in old[i:i + chunk]))
    spark.catalog.refreshTable(out.table)


def write_hours(spark: SparkSession, out: HourOutput, rows: DataFrame) -> tuple[str, set[int]]:
    """Write the rows of some hours into a new run; returns it and the hours that have rows."""
    run = uuid.uuid4().hex[:12]
    w = rows.write.partitionBy("hour").format(out.format)
    (w.options(**CSV_WRITE_OPTIONS) if out.format == "csv" else w).save(out.run_dir(run))
    return run, _written(spark, out.run_dir(run))


def commit_hours(spark: SparkSession, out: HourOutput, run: str, written: set[int], gone: set[int], old: Note, new: Note,
                 keep_seconds: int) -> None:
    """Publish a written run: note what is about to change, change it, note what the output is made of now."""
    write_note(spark, out, Note(old.spec, old.hours, sorted(written | gone)), run)
    publish_hours(spark, out, run, written, gone)
    write_note(spark, out, new, run)
    remove_unused(spark, out, {r for _, r in new.hours.values()} | {run}, new.hours, keep_seconds)


def replace_hours(spark: SparkSession, out: HourOutput, rows: DataFrame | None, note: Note, versions: dict[int, str],
                  changed: set[int], keep_seconds: int = KEEP_SECONDS) -> tuple[str, list[int]]:
    """One run: ``rows`` (of the ``changed`` hours, None if there are none) replace those hours, and hours that ``versions``
    lacks are dropped.  Returns the run and the dropped hours."""
    run, written = write_hours(spark, out, rows) if rows is not None else (uuid.uuid4().hex[:12], set())
    left = (registered_hours(spark, out) | set(note.hours)) - set(versions)
    if not changed and not left and not note.pending:
        return run, []
    hours = {h: (of, run if h in changed else note.hours[h][1]) for h, of in versions.items()}
    commit_hours(spark, out, run, written, (changed - written) | left, note, Note(note.spec, hours), keep_seconds)
    return run, sorted(set(note.hours) - set(versions))


def remove_unused(spark: SparkSession, out: HourOutput, runs: set[str], hours: dict[int, tuple[str, str]], keep_seconds: int) -> int:
    """Remove hour directories, empty runs and notes that nothing points to and that are old enough.

    Only called after a run's commit, when the note and the partitions agree.  One listing of the root, and one
    of each run that still has a directory."""
    fs, root = _fs(spark, out.root)
    before, removed = (time.time() - keep_seconds) * 1000, 0
    for st in fs.listStatus(root):
        name, path = st.getPath().getName(), st.getPath()
        if name.startswith("_note-") and name[6:18] not in runs and st.getModificationTime() < before:
            fs.delete(path, False)
        if not name.startswith("run-"):
            continue
        run, left = name[4:], 0
        for sub in fs.listStatus(path):
            m = re.match(r"hour=(-?\d+)$", sub.getPath().getName())
            if m and hours.get(int(m[1]), ("", ""))[1] != run and sub.getModificationTime() < before:
                fs.delete(sub.getPath(), True)
                removed += 1
            elif m:
                left += 1
        if not left and run not in runs and st.getModificationTime() < before:
            fs.delete(path, True)
    return removed


def spec_text(spec: FeedSpec) -> str:
    """Changes when the feed's policies or policy column do (the window is no part of an hour's version)."""
    return hashlib.sha1(json.dumps([spec.policy_column, sorted(set(spec.values))]).encode()).hexdigest()[:16]


def refresh_hours(spark: SparkSession, logs: DataFrame, spec: FeedSpec, now: int, out: HourOutput, *,
                  source_root: str | None = None, kind: str | None = None, hourly: bool = False, catch_up: bool = True,
                  mode: str = "overlap", buckets: int = 1, keep_seconds: int = KEEP_SECONDS) -> HourRun:
    """Bring the hour table ``out`` up to ``now`` (creates it on the first run).

    With ``source_root``, the root that ``logs`` reads, the table always equals the full export at ``now``: the
    hours whose files changed are rewritten.  Without, the hours from the seam on are.  An hour is written by
    up to ``buckets`` tasks."""
    if spec.day_range is not None or spec.hours_ago is None:
        raise ValueError("an hour table needs an hours_ago window")
    floor = hours_ago_bound(now, spec.hours_ago, spec.full_days)
    note, made_by = read_note(spark, out), spec_text(spec)
    if note.spec != made_by:
        note = Note(made_by)  # another feed: everything anew
    if source_root is not None:
        rows = hour_versions(spark, source_root, kind, since_hour=floor, until=now).collect()  # a row per retained hour
        versions = {int(r["hour"]): r["version"] for r in rows}
        changed = {h for h, v in versions.items() if note.hours.get(h, ("",))[0] != v or h in note.pending}
        chosen = hours_in(changed)
    else:
        seam = strict_seam(now, hourly)
        if not note.hours:
            seam = floor
        elif catch_up:
            seam = min(seam, floor_to(max(note.hours), DAY if spec.full_days else HOUR))
        lo = max(min([seam, *note.pending]), floor)
        chosen = F.col("hour") >= F.lit(lo)
    hits = render_nested(explode_policies(logs.filter(chosen), spec.policy_column, spec.values, mode=mode))
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    create_output(spark, out, [(c, t) for c, t in kinds.items() if c != "hour"], kinds["hour"])
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scalar = [c for c in kinds if c != "hour"]
    clustered = hits.repartition(n, "hour", F.pmod(F.xxhash64(*scalar), F.lit(int(buckets))))
    if source_root is not None:
        run, dropped = replace_hours(spark, out, clustered if changed else None, note, versions, changed, keep_seconds)
        return HourRun(out.table, run, floor, sorted(changed), dropped)
    run, written = write_hours(spark, out, clustered)
    hours = {h: v for h, v in note.hours.items() if floor <= h < lo} | {h: (run, run) for h in written}
    gone = (set(note.hours) | registered_hours(spark, out)) - set(hours)
    commit_hours(spark, out, run, written, gone, note, Note(made_by, hours), keep_seconds)
    return HourRun(out.table, run, floor, sorted(written), sorted(gone))


def refresh_hours_csv(spark: SparkSession, source: HourOutput, out: HourOutput, floor: int | None = None, *,
                      num_partitions: int | None = None, keep_seconds: int = KEEP_SECONDS) -> HourRun:
    """The CSV form of the hour table ``source``: the hours whose versions differ are written anew.

    Rows are range-partitioned by (hour, start_time, row hash): the files of an hour are in the feed's order by
    name, and an hour that holds most of the hits is cut into many files."""
    want, note = read_note(spark, source), read_note(spark, out)
    if note.spec != want.spec:
        note = Note(want.spec)
    versions = {h: f"{of} {run}" for h, (of, run) in want.hours.items() if floor is None or h >= floor}
    changed = {h for h, v in versions.items() if note.hours.get(h, ("",))[0] != v or h in note.pending}
    table = spark.table(source.table)
    create_output(spark, out, [(c, "string") for c in table.columns if c != "hour"], table.schema["hour"].dataType.simpleString())
    rows = None
    if changed:
        text = csv_safe(table.filter(hours_in(changed)))
        n = num_partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        keys = [F.col("hour").cast("long"), *sort_keys(text)]
        rows = text.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    run, dropped = replace_hours(spark, out, rows, note, versions, changed, keep_seconds)
    return HourRun(out.table, run, floor or 0, sorted(changed), dropped)


def refresh_hours_feed(spark: SparkSession, logs: DataFrame, spec: FeedSpec, now: int, table: HourOutput, csv: HourOutput,
                       **options) -> tuple[HourRun, HourRun]:
    """The hour table and its CSV form.  A run costs what changed since the last one; a CSV that an earlier run
    did not reach is made up for."""
    first = refresh_hours(spark, logs, spec, now, table, **options)
    return first, refresh_hours_csv(spark, table, csv, first.floor, keep_seconds=options.get("keep_seconds", KEEP_SECONDS))


def read_hours(spark: SparkSession, out: HourOutput, columns: list[str] | None = None, floor: int | None = None) -> DataFrame:
    """The published rows; with ``floor`` only hours at or above it (pruned in the catalog)."""
    df = spark.table(out.table)
    df = df if floor is None else df.filter(F.col("hour") >= F.lit(int(floor)))
    return df.select(*columns) if columns else df
