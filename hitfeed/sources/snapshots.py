"""Feed snapshots: find the newest CSV under a prefix, read it back as text columns.

Listing is a ``binaryFile`` scan selecting path and modification time only (no content is
read); the newest entry is picked by an aggregate (``max_by``), so only one row reaches the
driver.  A snapshot written by Spark is a directory of part files with a ``_SUCCESS``
marker: such a directory counts as one snapshot, identified by its newest part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hitfeed.sources.notes import ESCAPED, QUOTED, read_statistics, unescape_lines

#: Part files of a Spark output directory.
PART_FILE = r"/part-[0-9]+[^/]*\.csv$"

CSV_READ_OPTIONS = {
    "header": "true",
    "escape": '"',
    "multiLine": "true",
    "mode": "FAILFAST",
}


def list_csv(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``(path, modificationTime, snapshot, named)`` of every ``.csv`` below ``root`` whose path
    relative to ``root`` starts with ``prefix`` (a directory, a partial name, or both)."""
    root = root.rstrip("/")
    # list only below the prefix's directory part, not the whole root
    base = root + "/" + prefix.rsplit("/", 1)[0] if "/" in prefix else root
    listing = (spark.read.format("binaryFile")
               .option("recursiveFileLookup", "true")
               .load(base)
               .select("path", "modificationTime"))
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _re_path(root) + "/", "")
    parent = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)
    is_part = F.col("path").rlike(PART_FILE)
    return (listing.filter(F.col("path").endswith(".csv") & rel.startswith(prefix))
            .select("path", "modificationTime",
                    F.when(is_part, parent).otherwise(F.col("path")).alias("snapshot"), (~is_part).alias("named")))


def _re_path(p: str) -> str:
    import re
    return re.escape(p.split(":", 1)[-1] if p.startswith("file:") else p)


def latest_snapshot(spark: SparkSession, root: str, prefix: str = "") -> str:
    """Path of the newest *complete* snapshot (a file, or a Spark output directory).

    A directory counts only once its ``_SUCCESS`` marker exists: a job that died while
    committing can leave part files without it, and refreshing from such a partial
    snapshot would lose rows.  Spark's listing hides markers, so the candidates are streamed
    newest first and checked one by one (a metadata call each) until one is complete, however
    many incomplete runs are newer."""
    missing = FileNotFoundError(f"no complete .csv snapshot under {root!r} with prefix {prefix!r}")
    try:
        listing = list_csv(spark, root, prefix)
    except Exception as e:  # the prefix's directory does not exist
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise missing from None
        raise
    newest = (listing.groupBy("snapshot", "named").agg(F.max(F.struct("modificationTime", "path")).alias("newest"))
              .orderBy(F.col("newest").desc()))
    for row in newest.toLocalIterator():
        if row["named"] or _exists(spark, row["snapshot"].rstrip("/") + "/_SUCCESS"):
            return row["snapshot"]
    raise missing


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_snapshot(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A snapshot as all-string columns.  With ``columns`` the schema is given (header names
    must then match); without, names come from the header.

    A snapshot whose own note says that no value is broken over lines is read without ``multiLine``: its files are split over
    many tasks, however large they are.  Any other CSV is read with it, a task a file."""
    note = read_statistics(spark, path)
    split = note is not None and note.line_ends != QUOTED
    reader = spark.read.options(**CSV_READ_OPTIONS | ({"multiLine": "false"} if split else {}))
    if columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", "false")
    else:
        reader = reader.option("inferSchema", "false")
    df = reader.csv(path)
    return df.select(*[unescape_lines(F.col(c)).alias(c) for c in df.columns]) if note and note.line_ends == ESCAPED else df
