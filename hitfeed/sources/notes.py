"""Statistics of a written feed, kept beside it.

:func:`hitfeed.sinks.csv.write_csv` observes its rows while it writes them (no pass of its own) and leaves a small JSON note:
how many rows there are, the newest ``start_time``, the first and last ``hour``, how line ends within values are
written, and the number and bytes of the data files.  A directory has the note inside, a named file beside it; its leading
underscore hides it from readers and listings.  A note counts only while the files and bytes are still those it was
written for, so a feed that someone has changed is read as a foreign one.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: How values hold line ends: there are none, as they are within quotes, or escaped (``\\n``, ``\\r``, ``\\\\``).
NO_LINE_ENDS, QUOTED, ESCAPED = "none", "quoted", "escaped"


@dataclass(frozen=True)
class Statistics:
    rows: int
    max_start_time: int | None
    min_hour: int | None
    max_hour: int | None
    line_ends: str
    files: int = 0
    bytes: int = 0


def statistics_columns(text: DataFrame, escaped: bool) -> list[Column]:
    """What the write observes of all-text rows."""
    number = lambda c: F.expr(f"try_cast(`{c}` AS BIGINT)") if c in text.columns else F.lit(None).cast("long")
    broken = F.lit(False)
    if not escaped:
        for c in text.columns:
            broken = broken | F.coalesce(F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r")), F.lit(False))
    return [F.count(F.lit(1)).alias("rows"), F.max(number("start_time")).alias("max_start_time"), F.min(number("hour")).alias("min_hour"),
            F.max(number("hour")).alias("max_hour"), F.max(broken).alias("broken")]


def statistics_of(observed: dict, escaped: bool) -> Statistics:
    form = ESCAPED if escaped else QUOTED if observed["broken"] else NO_LINE_ENDS
    return Statistics(int(observed["rows"] or 0), observed["max_start_time"], observed["min_hour"], observed["max_hour"], form)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _note_path(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        return path.rstrip("/") + "/_statistics.json"
    parent, _, name = path.rpartition("/")
    return f"{parent}/_{name}.statistics.json"


def _data_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) of the data: one listing of the directory, or the file's own status."""
    fs, p = _fs(spark, path)
    found = [s.getLen() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "_."]
    return len(found), sum(found)


def write_statistics(spark: SparkSession, path: str, found: Statistics) -> None:
    """Leave the note of a finished output."""
    files, size = _data_files(spark, path)
    fs, p = _fs(spark, _note_path(spark, path))
    stream = fs.create(p, True)
    try:
        stream.write(json.dumps(asdict(found) | {"files": files, "bytes": size}).encode())
    finally:
        stream.close()


def read_statistics(spark: SparkSession, path: str) -> Statistics | None:
    """The note of an output; None where there is none, or where the files are not those it was written for."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    fs, note = _fs(spark, _note_path(spark, path))
    if not fs.exists(note):
        return None
    stream = fs.open(note)
    try:
        found = Statistics(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()
    return found if (found.files, found.bytes) == _data_files(spark, path) else None


def escape_lines(c: Column) -> Column:
    """A value without line ends, from which :func:`unescape_lines` makes it again."""
    for plain, sign in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(sign))
    return c


def unescape_lines(c: Column) -> Column:
    """The parts between escaped backslashes get their line ends back, then the backslashes."""
    parts = F.split(c, r"\\\\", -1)
    ends = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(ends, "\\")).otherwise(c)
