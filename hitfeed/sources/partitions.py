"""Partition discovery and registration.

* ``stored_partitions``     -- what is in storage: a ``binaryFile`` listing that selects only
                               the path (no file content is read), keys parsed from the path,
                               one row per partition.  Spark lists directories in parallel.
                               ``stored_locations`` also carries the real directory, which
                               may escape or pad the values.
* ``registered_partitions`` -- what the catalog has (``SHOW PARTITIONS``), parsed to columns.
* ``missing_partitions``    -- stored minus registered (left anti join on the five keys).
* ``add_partitions``        -- ``ALTER TABLE ... ADD IF NOT EXISTS PARTITION (...)`` in chunks,
                               typed literals, the directories found as locations.  Only the
                               missing list reaches the driver, streamed chunk by chunk.
* ``repair_partitions``     -- register everything found under the table root.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitfeed.schemas import PARTITION_COLUMNS, PARTITION_NAMES
from hitfeed.sources.logs import split_kind

_INT_KEYS = [n for n, t in PARTITION_COLUMNS if t == "int"]
_PATH_PATTERN = r"subscriber=([^/]+)/year=(-?\d+)/month=(-?\d+)/day=(-?\d+)/hour=(-?\d+)(/|$)"
_SPEC_PATTERN = r"^subscriber=([^/]+)/year=(-?\d+)/month=(-?\d+)/day=(-?\d+)/hour=(-?\d+)$"


def _unescape(c):
    """Partition directory names percent-escape special characters (``:`` -> ``%3A``,
    ``%`` -> ``%25``) but leave ``+`` as is: protect ``+`` before decoding."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _parse(col, pattern: str) -> list:
    out = []
    for i, (name, typ) in enumerate(PARTITION_COLUMNS, 1):
        v = F.regexp_extract(col, pattern, i)
        out.append((v.cast(typ) if typ != "string" else _unescape(v)).alias(name))
    return out


def stored_partitions(spark: SparkSession, root: str, kind: str | None = None, *,
                      since_hour: int | None = None, until: int | None = None) -> DataFrame:
    """Distinct ``(subscriber, year, month, day, hour)`` that hold at least one file.

    With ``since_hour`` only the day directories from one day before ``since_hour`` to one
    day after ``until`` (default: now) are listed, and partitions below ``since_hour`` are
    dropped: an hourly sync then lists O(new days), not the whole history.  This relies on
    ``year/month/day`` agreeing with ``hour`` to within a day."""
    return stored_locations(spark, root, kind, since_hour=since_hour, until=until).drop("location")


def stored_locations(spark: SparkSession, root: str, kind: str | None = None, *,
                     since_hour: int | None = None, until: int | None = None) -> DataFrame:
    """:func:`stored_partitions` with ``location``, the partition's directory as it is named in
    storage (the first by name, where two directories spell the same values)."""
    paths = [root] if since_hour is None else _day_dirs(spark, root, since_hour, until)
    schema = ", ".join(f"{n} {t}" for n, t in [*PARTITION_COLUMNS, ("location", "string")])
    if not paths:
        return spark.createDataFrame([], schema)
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .load(paths)
             .select("path"))
    keyed = files.filter(F.col("path").rlike(_PATH_PATTERN)).select(
        *_parse(F.col("path"), _PATH_PATTERN), F.regexp_extract("path", f"^(.*{_PATH_PATTERN.removesuffix('(/|$)')})(/|$)", 1).alias("location"))
    if since_hour is not None:
        keyed = keyed.filter(F.col("hour") >= F.lit(int(since_hour)))
    parts = keyed.groupBy(*PARTITION_NAMES).agg(F.min("location").alias("location"))
    return split_kind(parts, kind) if kind else parts


def hour_versions(spark: SparkSession, root: str, kind: str | None = None, *,
                  since_hour: int | None = None, until: int | None = None) -> DataFrame:
    """``(hour, version, bytes)`` of every ``hour=`` directory level below ``root`` that holds files.

    The version is a digest of the paths, modification times and sizes of the hour's files (of one kind, if
    given): it changes whenever a file comes, goes or is replaced, however old the hour is.  A listing only, no file
    is opened.  With ``since_hour`` the directories of the days from then on are listed (see
    :func:`stored_partitions`), and top-level ``hour=`` directories from then on."""
    paths = [root] if since_hour is None else [*_day_dirs(spark, root, since_hour, until), *_hour_dirs(spark, root, since_hour)]
    if not paths:
        return spark.createDataFrame([], "hour long, version string, bytes long")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select("path", "modificationTime", "length"))
    keyed = files.withColumn("hour", F.regexp_extract("path", r"/hour=(-?\d+)/", 1)).filter("hour <> ''").select(
        F.col("hour").cast("long").alias("hour"), "path", "modificationTime", "length",
        _unescape(F.regexp_extract("path", r"/subscriber=([^/]+)/", 1)).alias("subscriber"))
    if since_hour is not None:
        keyed = keyed.filter(F.col("hour") >= F.lit(int(since_hour)))
    if kind:
        keyed = split_kind(keyed, kind)
    digest = F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))
    return keyed.groupBy("hour").agg(F.concat_ws(":", F.count("*"), digest.cast("string")).alias("version"), F.sum("length").alias("bytes"))


def _hour_dirs(spark: SparkSession, root: str, since_hour: int) -> list[str]:
    """Top-level ``hour=`` directories from ``since_hour`` on (one listing of the root)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/hour=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = [st.getPath().toString() for st in found if st.isDirectory()]
    return [p for p in paths if int(p.rsplit("=", 1)[1]) >= int(since_hour)]


def _day_dirs(spark: SparkSession, root: str, since_hour: int, until: int | None) -> list[str]:
    """Existing ``subscriber=*/year=/month=/day=`` directories of the listed days (one glob
    call per day, on the driver: a handful of metadata requests)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    out = []
    for y, m, d in window_days(since_hour, until):
        # with and without zero padding
        pattern = f"{root.rstrip('/')}/subscriber=*/year={y}/month={{{m},{m:02d}}}/day={{{d},{d:02d}}}"
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern))
        out += [st.getPath().toString() for st in (found or []) if st.isDirectory()]
    return out


def registered_partitions(spark: SparkSession, table: str, days=None) -> DataFrame:
    """The catalog's partitions of ``table`` as typed columns; with ``days`` (an iterable of
    ``(year, month, day)``) only those days are asked for, one partial-spec
    ``SHOW PARTITIONS`` each, so an incremental sync does not pull the whole list."""
    if days is None:
        shown = spark.sql(f"SHOW PARTITIONS {table}")
    else:
        specs = [f"SHOW PARTITIONS {table} PARTITION (year={int(y)}, month={int(m)}, day={int(d)})"
                 for y, m, d in sorted(set(days))]
        if not specs:
            return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in PARTITION_COLUMNS))
        frames = [spark.sql(s) for s in specs]
        shown = frames[0]
        for f in frames[1:]:
            shown = shown.unionByName(f)
    return shown.select(*_parse(F.col("partition"), _SPEC_PATTERN))


def window_days(since_hour: int, until: int | None = None) -> list[tuple[int, int, int]]:
    """``(year, month, day)`` from one day before ``since_hour`` to one day after ``until``
    (default: now), UTC."""
    import time
    from datetime import datetime, timedelta, timezone

    end = int(until if until is not None else time.time())
    day = datetime.fromtimestamp(int(since_hour), timezone.utc).date() - timedelta(days=1)
    last = datetime.fromtimestamp(end, timezone.utc).date() + timedelta(days=1)
    out = []
    while day <= last:
        out.append((day.year, day.month, day.day))
        day += timedelta(days=1)
    return out


def missing_partitions(stored: DataFrame, registered: DataFrame) -> DataFrame:
    """Set difference stored - registered (both keyed by the five partition columns)."""
    return stored.join(registered, PARTITION_NAMES, "left_anti")


def _literal(value, typ: str) -> str:
    if typ == "string":
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(int(value))


def partition_spec_sql(row, root: str | None = None) -> str:
    """``PARTITION (subscriber='s', year=2024, ...) [LOCATION '...']`` with typed literals.

    The location is the row's own, where it has one, or else the plain path below ``root``."""
    vals = [row[n] for n in PARTITION_NAMES]
    spec = ", ".join(f"{n}={_literal(v, t)}" for (n, t), v in zip(PARTITION_COLUMNS, vals))
    text = f"PARTITION ({spec})"
    loc = row["location"] if "location" in row else None
    if loc is None and root is not None:
        loc = root.rstrip("/") + "/" + "/".join(f"{n}={v}" for n, v in zip(PARTITION_NAMES, vals))
    if loc is not None:
        text += f" LOCATION {_literal(loc, 'string')}"
    return text


def add_partitions(spark: SparkSession, table: str, partitions: DataFrame | Iterable,
                   root: str | None = None, chunk: int = 500) -> int:
    """Register ``partitions``; returns how many specs were submitted.  No-op when empty."""
    rows = partitions.toLocalIterator() if isinstance(partitions, DataFrame) else iter(partitions)
    batch, total = [], 0
    for row in rows:
        batch.append(partition_spec_sql(row, root))
        if len(batch) >= chunk:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(batch))
            total += len(batch)
            batch = []
    if batch:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(batch))
        total += len(batch)
    return total


def repair_partitions(spark: SparkSession, table: str) -> None:
    """Register every partition directory under the table's root."""
    spark.catalog.recoverPartitions(table)


def create_log_table(spark: SparkSession, table: str, schema, root: str) -> None:
    """External partitioned Parquet table over ``root`` (no partitions registered yet)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {table} ({cols}) USING parquet "
        f"PARTITIONED BY ({', '.join(PARTITION_NAMES)}) LOCATION {_literal(root, 'string')}"
    )
