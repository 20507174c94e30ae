"""CSV feed writer.

Header, every field quoted, quotes escaped by doubling (``""``), UTF-8, no whitespace
trimming -- so quotes, commas and newlines in values round-trip.  Null and empty text both
read back as null.

Ordering: with ``order_by`` the output is range-partitioned on it, so part files are in
global order without funnelling the feed through one task.  ``single_file=True`` keeps the
one-file form for small feeds (optionally renamed to a stable name).

Publishing: every write goes to a fresh run directory beside the target and is moved over it
(metadata operations) only after it has succeeded.  A failing run leaves the published feed
as it was, and a feed may be refreshed from the directory that it replaces.
"""

from __future__ import annotations

import random
import string
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from hitfeed.functions.location import location_hash
from hitfeed.functions.render import csv_safe
from hitfeed.operators.ordering import sort_keys, sort_by_start_time
from hitfeed.sources.notes import escape_lines, statistics_columns, statistics_of, write_statistics

# Default output directory name, ``<prefix>-<epoch>-<8 chars of [a-z0-9]>``
DEFAULT_DIR_PREFIX = "PolicyTriggerCSV"
DEFAULT_DIR_SUFFIX_LEN = 8

CSV_WRITE_OPTIONS = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite", order_by: str | None = None,
              num_partitions: int | None = None, single_file: bool = False,
              max_records_per_file: int | None = None, partition_by: list[str] | None = None,
              filename: str | None = None, keep_original: bool = False,
              target_dir: str | None = None, line_ends: str = "keep") -> str:
    """Write ``df`` (rendered to text first) and return the output path.

    The write observes its rows and leaves their statistics beside the output (:mod:`hitfeed.sources.notes`; not with
    ``partition_by``).  ``line_ends="escape"`` writes line ends within values as ``\\n`` and ``\\r`` (and a backslash
    doubled), so that :func:`hitfeed.sources.read_snapshot` can split the files; with ``"keep"`` it can where no
    value holds one.

    With ``filename`` the feed gets a stable name: ``path/filename`` (or ``target_dir/filename``).
    It is a directory of part files, or one file with ``single_file``."""
    if mode not in ("overwrite", "errorifexists"):
        raise ValueError(f"mode must be overwrite or errorifexists, got {mode!r}")
    if filename and partition_by:
        raise ValueError("a stable name and partition_by exclude each other")
    if keep_original and not (filename and single_file):
        raise ValueError("keep_original needs a filename and single_file=True")
    if line_ends not in ("keep", "escape"):
        raise ValueError(f"line_ends must be keep or escape, got {line_ends!r}")
    spark = df.sparkSession
    target = path if filename is None or single_file else f"{(target_dir or path).rstrip('/')}/{filename}"
    out = csv_safe(df)
    if order_by is not None:
        out = sort_by_start_time(out, num_partitions, key=order_by)
    if single_file:
        out = out.coalesce(1)
    seen = Observation("feed")  # above the sort, whose sampling would count rows twice
    out = out.observe(seen, *statistics_columns(out, line_ends == "escape"))
    if line_ends == "escape":
        out = out.select(*[escape_lines(F.col(c)).alias(c) for c in out.columns])
    run = run_directory(target)
    w = out.write.mode("errorifexists").options(**CSV_WRITE_OPTIONS)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        if mode == "errorifexists" and _fs(spark, target)[0].exists(_fs(spark, target)[1]):
            raise FileExistsError(target)
        w.csv(run)
        found = statistics_of(seen.get, line_ends == "escape")
        if filename and single_file:
            named = rename_single_output(spark, run, filename, keep_original=keep_original,
                                         target_dir=target_dir or path, original_dir=path)
            write_statistics(spark, named, found)
            return named
        if not partition_by:
            write_statistics(spark, run, found)
        return publish(spark, run, target)
    finally:
        fs, p = _fs(spark, run)
        if fs.exists(p):
            fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def run_directory(target: str) -> str:
    """A fresh directory beside ``target``; its leading underscore hides it from listings."""
    parent, _, name = target.rstrip("/").rpartition("/")
    return f"{parent}/_run-{name}-{uuid.uuid4().hex[:12]}"


def publish(spark: SparkSession, run: str, target: str) -> str:
    """Move a finished run directory over ``target``; what stood there goes only afterwards."""
    fs, src = _fs(spark, run)
    _, dst = _fs(spark, target)
    fs.mkdirs(dst.getParent())
    old = None
    if fs.exists(dst):
        _, old = _fs(spark, run_directory(target))
        if not fs.rename(dst, old):
            raise RuntimeError(f"cannot replace {target}")
    if not fs.rename(src, dst):
        if old is not None:
            fs.rename(old, dst)
        raise RuntimeError(f"cannot publish {run} as {target}")
    if old is not None:
        fs.delete(old, True)
    return target


def rename_single_output(spark: SparkSession, directory: str, filename: str, *,
                         keep_original: bool = False, target_dir: str | None = None,
                         original_dir: str | None = None) -> str:
    """Give the single part file of a finished run ``directory`` a stable name below ``target_dir``
    (default: the directory itself); metadata operations on the driver.  With ``keep_original``
    the part file stays as well, in ``original_dir``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs, d = _fs(spark, directory)
    parts = [s.getPath() for s in fs.listStatus(d) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"expected one part file in {directory}, found {len(parts)}")
    _, home = _fs(spark, target_dir or directory)
    target = jvm.org.apache.hadoop.fs.Path(home, filename)
    fs.mkdirs(home)
    if keep_original:
        _, kept = _fs(spark, original_dir or directory)
        fs.mkdirs(kept)
        jvm.org.apache.hadoop.fs.FileUtil.copy(
            fs, parts[0], fs, jvm.org.apache.hadoop.fs.Path(kept, parts[0].getName()), False, True, conf)
    publish(spark, parts[0].toString(), target.toString())
    # a directory of named files, not a multi-part dataset: no marker, so snapshot discovery
    # treats each .csv in it on its own
    marker = jvm.org.apache.hadoop.fs.Path(home, "_SUCCESS")
    if fs.exists(marker):
        fs.delete(marker, False)
    return target.toString()


def default_output_dir(now: int, rng: random.Random | None = None) -> str:
    """``PolicyTriggerCSV-<now>-<8 random [a-z0-9]>``."""
    r = rng or random.SystemRandom()
    tail = "".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(DEFAULT_DIR_SUFFIX_LEN))
    return f"{DEFAULT_DIR_PREFIX}-{int(now)}-{tail}"


def feed_output_path(base: str, output_dir: str, salt: str, ordinal: str, subscriber: str, receiver: str) -> str:
    """``<base>/<output_dir>/<location hash>`` of one feed (one hash, on the driver)."""
    return "/".join([base.rstrip("/"), output_dir.strip("/"), location_hash(salt, ordinal, subscriber, receiver)])


def write_feeds(df: DataFrame, path: str, *, by: str = "feed_location", key: str = "start_time",
                num_partitions: int | None = None, names: str | None = None,
                max_records_per_file: int | None = None) -> str:
    """All feeds of a multi-feed result in one write, one directory per feed
    (``<path>/<by>=<value>/``), each feed's part files in ``start_time`` order.

    With ``names``, a column that holds the stable name of each feed, the layout is
    ``<path>/<value of by>/<name>/part-*`` instead; feeds of other names stay as they are.

    Rows are range-partitioned on ``(by, key, row hash)``: each task holds a contiguous run of
    one feed (or the end of one and the start of the next), so the write makes about
    ``n + feeds`` files instead of ``n * feeds``, while a feed holding most of the hits is
    still split over many tasks by the range sampler.  Sorting within partitions on the
    same keys satisfies the writer's partition-column ordering, so it adds no sort."""
    spark = df.sparkSession
    text = csv_safe(df)
    places = [by, names] if names else [by]
    cols = [c for c in text.columns if c not in places]
    keys = sort_keys(text.select(*cols), key, None)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [*[F.col(c).asc_nulls_last() for c in places], *keys]
    out = text.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered)
    run = run_directory(path)
    w = out.write.mode("errorifexists").options(**CSV_WRITE_OPTIONS).partitionBy(*places)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    try:
        w.csv(run)
        return publish_feeds(spark, run, path) if names else publish(spark, run, path)
    finally:
        fs, p = _fs(spark, run)
        if fs.exists(p):
            fs.delete(p, True)


def publish_feeds(spark: SparkSession, run: str, path: str) -> str:
    """Move ``run/<by>=<value>/<names>=<name>`` to ``path/<value>/<name>``, feed by feed."""
    from urllib.parse import unquote
    fs, root = _fs(spark, run)
    value = lambda p: unquote(p.getName().split("=", 1)[1])
    directories = lambda p: [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    for location in directories(root):
        for feed in directories(location):
            _, marker = _fs(spark, feed.toString() + "/_SUCCESS")
            fs.create(marker, True).close()
            publish(spark, feed.toString(), f"{path.rstrip('/')}/{value(location)}/{value(feed)}")
    return path
