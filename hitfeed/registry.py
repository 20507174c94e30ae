"""Registered checks: one Spark query per inventory item, each with its DuckDB twin.

Every query reads the driver's tables (``events``, ``documents``) -- ``policy_log`` is
derived from ``events`` by Spark -- and runs over them whole.  Queries that need real
directories write below the shared scratch folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hitfeed import fixtures
from hitfeed.fixtures import NOW, policy_log, partitioned_copy, table, write_partitioned
from hitfeed.functions.location import location_column
from hitfeed.functions.render import render_column, render_nested
from hitfeed.functions.timebounds import DAY, HOUR, MICROS, hours_ago_bound, strict_seam
from hitfeed.operators.hits import explode_policies
from hitfeed.operators.multifeed import Feed
from hitfeed.operators.ordering import with_global_ordinal
from hitfeed.plans.export import export_feed, export_multi
from hitfeed.plans.feed import FeedSpec
from hitfeed.plans.hour_table import read_hour_table, refresh_hour_table
from hitfeed.plans.hour_versions import HourOutput, read_hours, refresh_hours, refresh_hours_feed
from hitfeed.plans.refresh import before_seam, last_seen_hour, refresh_feed, retained
from hitfeed.plans.sync import sync_partitions
from hitfeed.schemas import PARTITION_COLUMNS, schema_for, struct_from_ddl
from hitfeed.session import scratch_path
from hitfeed.sinks.csv import write_csv
from hitfeed.sources.logs import read_dns, read_logs, read_proxy, read_table, source_names, union_view
from hitfeed.sources.partitions import (
    add_partitions, create_log_table, missing_partitions, registered_partitions, repair_partitions, stored_partitions,
)
from hitfeed.sources.snapshots import CSV_READ_OPTIONS, latest_snapshot, read_snapshot
from hitfeed.streaming.hits_stream import hits_schema, read_hits, stream_hits

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = FeedSpec(parent_policies="error,p3", hours_ago=72)
HIT_COLUMNS = ["event_id", "start_time", "user_id", "event_type", "policy", "annotations",
               "subscriber", "year", "month", "day", "hour"]


EMPTIED_HOUR = NOW - 5 * HOUR
SEED_BOUND = 1706400000  # partitions below this hour count as already registered


def _log_schema() -> T.StructType:
    return struct_from_ddl(fixtures.POLICY_LOG_DDL)


def _as_of(logs: DataFrame, t: int) -> DataFrame:
    """The source as it stood at ``t``: only events that had arrived by then."""
    return logs.filter(F.col("start_time") < F.lit(int(t) * MICROS))


def _snapshot(spark: SparkSession, logs: DataFrame, spec: FeedSpec, t: int, path: str) -> str:
    """Write the feed as exported at time ``t`` (from the source as of ``t``) as a CSV snapshot."""
    return write_csv(export_feed(_as_of(logs, t), spec, t), path, order_by="start_time")


# --- queries -----------------------------------------------------------------------------

def q_policy_hits_hours_ago(spark, sf):
    return export_feed(policy_log(spark, sf), FLAGSHIP, NOW)


def q_policy_hits_full_days(spark, sf):
    return export_feed(policy_log(spark, sf), FeedSpec(parent_policies="purchase,p1", hours_ago=30, full_days=True), NOW)


def q_policy_hits_day_range(spark, sf):
    return export_feed(policy_log(spark, sf), FeedSpec(parent_policies="signup,p2,p4", day_range="20240110-20240112"), NOW)


def q_explode_duplicates_and_nulls(spark, sf):
    return explode_policies(policy_log(spark, sf), "parent_policies").select("event_id", "user_id", "policy")


WEEK_SPEC = FeedSpec(parent_policies="view,p0,p4", hours_ago=168)


def q_policy_hits_prefiltered(spark, sf):
    return export_feed(policy_log(spark, sf), WEEK_SPEC, NOW, mode="overlap")


def q_policy_hits_unnest_then_filter(spark, sf):
    return export_feed(policy_log(spark, sf), WEEK_SPEC, NOW, mode="after")


def q_policy_hits_filter_in_generator(spark, sf):
    return export_feed(policy_log(spark, sf), WEEK_SPEC, NOW, mode="inside")


def q_policy_list_filter(spark, sf):
    spec = FeedSpec(parent_policies="view|| p3|p1||click |purchase|view", delimiter="|", hours_ago=720)
    return export_feed(policy_log(spark, sf), spec, NOW)


def _kind(kind):
    def q(spark, sf):
        logs = read_logs(spark, partitioned_copy(spark, sf), _log_schema(), kind)
        return export_feed(logs, FLAGSHIP, NOW)
    return q


def q_union_all_subscribers(spark, sf):
    logs = policy_log(spark, sf)
    frames = [logs.filter(F.col("subscriber").startswith(f"sub.{i}")) for i in range(3)]
    frames[1] = frames[1].select(*reversed(frames[1].columns))  # by name, not position
    return render_nested(union_view(frames))


def q_source_names(spark, sf):
    buckets = policy_log(spark, sf).select(F.concat("subscriber", F.lit("-"), "event_type").alias("bucket")).distinct()
    return source_names(buckets, prefix="hitfeed-logs")


def q_stored_partitions(spark, sf):
    return stored_partitions(spark, partitioned_copy(spark, sf))


def _table_name(spark) -> str:
    """A catalog name of this query; tables of earlier queries of the session go."""
    for t in spark.catalog.listTables():
        if t.name.startswith("hitfeedq_") and not t.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    return "hitfeedq_" + scratch_path(spark, "t").rsplit("-", 1)[1]


def _seeded_table(spark, sf, kind=None) -> tuple[str, str]:
    """A catalog table over the partitioned copy with the partitions below SEED_BOUND
    registered (of ``kind`` only, when given)."""
    root = partitioned_copy(spark, sf)
    name = _table_name(spark)
    create_log_table(spark, name, _log_schema(), root)
    stored = stored_partitions(spark, root, kind)
    add_partitions(spark, name, stored.filter(F.col("hour") < F.lit(SEED_BOUND)))
    return name, root


def q_missing_partitions(spark, sf):
    name, root = _seeded_table(spark, sf)
    return missing_partitions(stored_partitions(spark, root), registered_partitions(spark, name)).checkpoint()


def q_sync_partitions(spark, sf):
    name, root = _seeded_table(spark, sf, kind="dns")
    sync_partitions(spark, name, root, kind="dns")
    return registered_partitions(spark, name)


def q_sync_with_locations(spark, sf):
    """Directories whose names escape and zero-pad the values: what the synced table reads."""
    logs = policy_log(spark, sf).withColumn("subscriber", F.concat(F.col("subscriber"), F.lit(":x")))
    root = scratch_path(spark, "padded")
    padded = logs.withColumns({"month": F.lpad(F.col("month").cast("string"), 2, "0"),
                               "day": F.lpad(F.col("day").cast("string"), 2, "0")})
    write_partitioned(padded.filter(F.col("hour") >= F.lit(SEED_BOUND)), root)
    name = _table_name(spark)
    create_log_table(spark, name, _log_schema(), root)
    sync_partitions(spark, name, root)
    return export_feed(read_table(spark, name), FLAGSHIP, NOW)


def q_repair_then_read(spark, sf):
    """Everything below the shared root registered at once; the reader splits the kinds."""
    name = _table_name(spark)
    create_log_table(spark, name, _log_schema(), partitioned_copy(spark, sf))
    repair_partitions(spark, name)
    return export_feed(read_table(spark, name, "dns"), FLAGSHIP, NOW)


def q_catalog_table_export(spark, sf):
    """Flagship export read through a catalog table whose partitions were registered in two
    steps (seeded, then synced): partition pruning happens in the catalog."""
    name, root = _seeded_table(spark, sf)
    sync_partitions(spark, name, root)
    return export_feed(read_table(spark, name), FLAGSHIP, NOW)


def q_latest_snapshot_rows(spark, sf):
    logs = policy_log(spark, sf)
    root = scratch_path(spark, "snapshots")
    _snapshot(spark, logs, FLAGSHIP, NOW - 7200, f"{root}/feed-a/run-1")
    _snapshot(spark, logs, FLAGSHIP, NOW, f"{root}/feed-a/run-2")
    _snapshot(spark, logs, FeedSpec(parent_policies="view", hours_ago=1), NOW - 3600, f"{root}/other/run-3")
    return read_snapshot(spark, latest_snapshot(spark, root, "feed-a"), HIT_COLUMNS)


def q_latest_snapshot_many_incomplete(spark, sf):
    """One complete run, then twelve newer ones that died before their commit."""
    logs = policy_log(spark, sf)
    root = scratch_path(spark, "snapshots")
    _snapshot(spark, logs, FLAGSHIP, NOW, f"{root}/feed-a/run-00")
    late = FeedSpec(parent_policies="view", hours_ago=1)
    for i in range(1, 13):
        path = _snapshot(spark, logs, late, NOW, f"{root}/feed-a/run-{i:02d}")
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(marker, False)
    return read_snapshot(spark, latest_snapshot(spark, root, "feed-a"), HIT_COLUMNS)


def _previous(spark, sf, t):
    logs = policy_log(spark, sf)
    path = _snapshot(spark, logs, FLAGSHIP, t, scratch_path(spark, "prev"))
    return logs, read_snapshot(spark, path, HIT_COLUMNS)


def q_retained_snapshot(spark, sf):
    _, snap = _previous(spark, sf, NOW - HOUR)
    return snap.filter(retained(hours_ago_bound(NOW, 48)))


def q_seam_snapshot(spark, sf):
    _, snap = _previous(spark, sf, NOW - HOUR)
    return snap.filter(before_seam(strict_seam(NOW, hourly=False)))


def q_last_seen_hour(spark, sf):
    logs, snap = _previous(spark, sf, NOW - 5 * HOUR - 1234)
    h = last_seen_hour(snap, HOUR)
    d = last_seen_hour(snap, DAY)
    return snap.agg(F.max(F.expr("try_cast(start_time AS BIGINT)")).alias("last_start_time")).select(
        "last_start_time", F.lit(h).cast("long").alias("last_seen_hour"), F.lit(d).cast("long").alias("last_seen_day"))


def _refresh(spark, sf, t_prev, **kw):
    logs = policy_log(spark, sf)
    prev = _snapshot(spark, logs, FLAGSHIP, t_prev, scratch_path(spark, "prev"))
    res = refresh_feed(spark, logs, FLAGSHIP, NOW, scratch_path(spark, "refreshed"), previous=prev, **kw)
    return res


def q_refresh_feed_strict(spark, sf):
    res = _refresh(spark, sf, NOW - HOUR, hourly=True)
    return read_snapshot(spark, res.path, HIT_COLUMNS)


def q_refresh_feed_catchup(spark, sf):
    res = _refresh(spark, sf, NOW - 10 * HOUR - 1000, hourly=True, catch_up=True)
    return read_snapshot(spark, res.path, HIT_COLUMNS)


def q_refresh_hour_table(spark, sf):
    """Hour table built at now-10h from the source as it stood then, refreshed hourly up to
    now with one catch-up run and one strict run."""
    logs = policy_log(spark, sf)
    path = scratch_path(spark, "hour-table")
    refresh_hour_table(spark, _as_of(logs, NOW - 10 * HOUR), FLAGSHIP, NOW - 10 * HOUR, path)
    refresh_hour_table(spark, _as_of(logs, NOW - HOUR), FLAGSHIP, NOW - HOUR, path, hourly=True, catch_up=True)
    refresh_hour_table(spark, logs, FLAGSHIP, NOW, path, hourly=True)
    return read_hour_table(spark, path, HIT_COLUMNS)


def _hour_output(spark, what: str, format: str = "parquet") -> HourOutput:
    root = scratch_path(spark, what)
    return HourOutput("hitfeedq_" + root.rsplit("-", 1)[1], root, format)


def q_refresh_hour_table_corrected(spark, sf):
    """The hour table equals the full export after the stored logs changed: every seventh event, of any age, came
    in late, and the files of one hour are gone."""
    root, out = scratch_path(spark, "late-logs"), _hour_output(spark, "hours")
    logs = policy_log(spark, sf)
    late = F.pmod("event_id", F.lit(7)) == 0
    arrive = lambda rows: rows.repartition(8, "hour").write.mode("append").partitionBy("hour").parquet(root)
    refresh = lambda: refresh_hours(spark, read_logs(spark, root, _log_schema()), FLAGSHIP, NOW, out, source_root=root)
    arrive(logs.filter(~late))
    refresh()
    arrive(logs.filter(late))
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/hour={EMPTIED_HOUR}")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    refresh()
    return read_hours(spark, out, HIT_COLUMNS)


def q_refresh_hour_feed(spark, sf):
    """The per-hour CSV feed after hourly refreshes over the hour table, read back whole."""
    logs = policy_log(spark, sf)
    table, csv = _hour_output(spark, "hours"), _hour_output(spark, "hour-feed", "csv")
    for t in (NOW - 30 * HOUR, NOW - HOUR, NOW):
        refresh_hours_feed(spark, _as_of(logs, t), FLAGSHIP, t, table, csv, hourly=t != NOW)
    return read_hours(spark, csv, HIT_COLUMNS).withColumn("hour", F.col("hour").cast("string"))


def q_run_metrics(spark, sf):
    res = _refresh(spark, sf, NOW - HOUR, hourly=True)
    m = res.metrics
    return spark.createDataFrame(
        [(m["input"], m["in_window"], m["kept"], m["new"])],
        "input_rows long, in_window_rows long, kept_rows long, new_rows long")


def q_csv_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    path = write_csv(docs, scratch_path(spark, "docs-csv"))
    return read_snapshot(spark, path, docs.columns)


def q_render_array(spark, sf):
    logs = policy_log(spark, sf)
    return logs.select("event_id", render_column(logs, "parent_policies"))


def _map_frame(spark, sf):
    ev = table(spark, sf, "events")
    return ev.selectExpr("event_id", """
      CASE WHEN user_id % 11 = 0 THEN CAST(NULL AS MAP<STRING,STRING>)
           WHEN user_id % 13 = 0 THEN CAST(map() AS MAP<STRING,STRING>)
           ELSE map('k', get_json_object(props, '$.k'),
                    'n', CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_type END) END AS attrs""")


def q_render_map(spark, sf):
    df = _map_frame(spark, sf)
    return df.select("event_id", render_column(df, "attrs"))


def _nested_frame(spark, sf):
    ev = table(spark, sf, "events")
    return ev.selectExpr("event_id", """
      CASE WHEN user_id % 11 = 0 THEN NULL
           WHEN user_id % 13 = 0 THEN CAST(array() AS ARRAY<MAP<STRING,STRING>>)
           ELSE array(map('name', concat(event_type, '.example'), 'ttl', CAST(user_id AS STRING)),
                      map('k', get_json_object(props, '$.k'))) END AS dns_answer""", """
      CASE WHEN user_id % 11 = 0 THEN NULL
           ELSE array(named_struct('ip', concat('10.0.0.', CAST(user_id % 256 AS STRING)),
                                   'cc', CASE WHEN user_id % 2 = 0 THEN 'US' ELSE NULL END,
                                   'asnum', CAST(user_id AS STRING)),
                      named_struct('ip', concat('10.1.0.', CAST(event_id % 256 AS STRING)),
                                   'cc', 'DE', 'asnum', NULL)) END AS dns_answer_ips""")


def q_render_nested(spark, sf):
    return render_nested(_nested_frame(spark, sf))


def q_hits_ordered(spark, sf):
    hits = export_feed(policy_log(spark, sf), FLAGSHIP, NOW)
    return with_global_ordinal(hits, tiebreak=["event_id", "policy"]).select("ordinal", "event_id", "start_time", "policy", "subscriber")


FEEDS = [
    Feed("a", FeedSpec(parent_policies="error,p3", hours_ago=72, full_days=True)),
    Feed("b", FeedSpec(parent_policies="p3", hours_ago=1, full_days=True)),
    Feed("c", FeedSpec(parent_policies="view,view,,click", hours_ago=720, full_days=True)),
]


def q_multi_feed_hits(spark, sf):
    return export_multi(policy_log(spark, sf), FEEDS, NOW)


def q_multi_feed_by_source(spark, sf):
    """A feeds table: two feeds on one policy for different subscribers, one of them a day range, one
    for every subscriber, and one kind only."""
    feeds = spark.createDataFrame(
        [("s0", "error,p3", "sub.0", None, "20240127-20240128", None, None), ("s1", "error", "sub.1", 72, None, True, None),
         ("all", "p3|p3||error", None, 10, None, None, "proxy")],
        "feed string, parent_policies string, subscriber string, hours_ago int, day_range string, full_days boolean, kind string")
    feeds = feeds.withColumn("delimiter", F.when(F.col("feed") == "all", "|"))
    return export_multi(policy_log(spark, sf), feeds, NOW)


def q_multi_feed_by_day(spark, sf):
    """A feeds table that Spark derives from the log: a feed for every policy and day on which it was hit."""
    logs = policy_log(spark, sf)
    day = F.format_string("%04d%02d%02d", "year", "month", "day")
    hit = logs.select(F.explode("parent_policies").alias("policy"), day.alias("day")).distinct()
    feeds = hit.select(F.concat_ws("-", "policy", "day").alias("feed"), F.col("policy").alias("parent_policies"),
                       F.concat_ws("-", "day", "day").alias("day_range"))
    return export_multi(logs, feeds, NOW)


FEED_SALT = "example-salt"


def _feed_table(spark, names):
    """Location inputs of the check feeds (a small config table)."""
    rows = [(n, f"sub.{i}", f"soc{i}@example.org", str(i + 1)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feed string, subscriber string, receiver string, ordinal string")


def q_multi_feed_csv(spark, sf):
    from hitfeed.operators.multifeed import multi_feed_hits
    from hitfeed.sinks.csv import write_feeds
    table = _feed_table(spark, [f.name for f in FEEDS])
    extra = table.select("feed", location_column(FEED_SALT, "ordinal", "subscriber", "receiver").alias("feed_location"))
    hits = multi_feed_hits(policy_log(spark, sf), FEEDS, NOW, extra=extra)
    path = write_feeds(hits, scratch_path(spark, "feeds"))
    cols = ["feed"] + HIT_COLUMNS + ["feed_location"]
    return read_snapshot(spark, path, cols)


def q_saved_view_sql(spark, sf):
    """The saved-query route: one view per subscriber, a union view over them, and the
    export written as SQL against the view."""
    logs = policy_log(spark, sf)
    tag = scratch_path(spark, "v").rsplit("-", 1)[1]
    names = []
    for i in range(3):
        names.append(f"hitfeed_{tag}_sub{i}")
        logs.filter(F.col("subscriber").startswith(f"sub.{i}")).createOrReplaceTempView(names[-1])
    union_view([spark.table(n) for n in names], f"hitfeed_{tag}_all")
    return spark.sql(f"""
        SELECT event_id, start_time, user_id, event_type, policy,
               concat('{{', array_join(transform(map_entries(annotations),
                      e -> concat(e.key, '=', coalesce(e.value, 'None'))), ', '), '}}') AS annotations,
               subscriber, year, month, day, hour
        FROM hitfeed_{tag}_all LATERAL VIEW explode(parent_policies) t AS policy
        WHERE hour >= {NOW - 72 * HOUR} AND policy IN ('error', 'p3')""")


def q_feed_export_job(spark, sf):
    """Job A end to end: one feed written as a single file with a stable name below its
    hashed location, read back."""
    from hitfeed.plans.jobs import FeedTarget, export_job
    target = FeedTarget(scratch_path(spark, "job"), FEED_SALT, "1", "sub.0", "soc0@example.org",
                        output_dir="csv", output_filename="LatestTriggers.csv")
    path = export_job(spark, policy_log(spark, sf), FLAGSHIP, target, now=NOW, order_by="start_time")
    return read_snapshot(spark, path, HIT_COLUMNS)


def q_feed_export_republish(spark, sf):
    """A published feed after a second run over the same name."""
    from hitfeed.plans.jobs import FeedTarget, export_job
    target = FeedTarget(scratch_path(spark, "job"), FEED_SALT, "1", "sub.0", "soc0@example.org",
                        output_dir="csv", output_filename="LatestTriggers.csv")
    logs = policy_log(spark, sf)
    export_job(spark, logs, FeedSpec(parent_policies="view", hours_ago=24), target, now=NOW)
    path = export_job(spark, logs, FLAGSHIP, target, now=NOW, order_by="start_time")
    return read_snapshot(spark, path, HIT_COLUMNS)


def q_feed_locations(spark, sf):
    subs = policy_log(spark, sf).select("subscriber").distinct()
    feeds = subs.select("subscriber", F.concat(F.lit("soc@"), "subscriber").alias("receiver"),
                        F.lit("1").alias("ordinal"))
    return feeds.withColumn("feed_location", location_column(FEED_SALT, "ordinal", "subscriber", "receiver"))


def _stream(spark, sf, kind, runs=1):
    root = partitioned_copy(spark, sf)  # both kinds share it
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    for _ in range(runs):
        stream_hits(spark, root, _log_schema(), kind, "error,p3", out, ckpt).awaitTermination()
    return out


def _read_stream(spark, out):
    return read_hits(spark, out, hits_schema(spark, _log_schema(), "parent_policies"))


def q_stream_hits_available_now(spark, sf):
    """The streams of both kinds; a second run finds no new files and adds nothing."""
    return _read_stream(spark, _stream(spark, sf, "dns", 2)).unionByName(_read_stream(spark, _stream(spark, sf, "proxy", 2)))


def _stream_hits(kind):
    return lambda spark, sf: _read_stream(spark, _stream(spark, sf, kind))


def q_stream_hits_retained(spark, sf):
    """Both kinds' hit tables after retention: whole hours below the 72-hour floor are gone for
    every reader."""
    from hitfeed.plans.hour_table import drop_hours_below
    outs = [_stream(spark, sf, kind) for kind in ("dns", "proxy")]
    for out in outs:
        drop_hours_below(spark, out, hours_ago_bound(NOW, 72))
    return _read_stream(spark, outs[0]).unionByName(_read_stream(spark, outs[1]))


def q_stream_hits_compacted(spark, sf):
    """The proxy stream's hits after two packing runs: closed hours from the packed table, the last day from the stream."""
    from hitfeed.streaming.compaction import compact_hits, read_packed
    out, schema = _stream(spark, sf, "proxy"), hits_schema(spark, _log_schema(), "parent_policies")
    table = _hour_output(spark, "packed")
    for closed_before in (NOW - 2 * DAY, NOW - DAY):
        compact_hits(spark, out, schema, closed_before, table)
    return read_packed(spark, out, schema, table)


def q_csv_roundtrip_escaped(spark, sf):
    """Texts with line ends in files that can be split: escaped by the writer, restored by the reader."""
    docs = table(spark, sf, "documents")
    return read_snapshot(spark, write_csv(docs, scratch_path(spark, "docs-csv"), line_ends="escape"), docs.columns)


def q_feed_statistics(spark, sf):
    """What the write of a feed notes beside it, without a pass over the feed."""
    from hitfeed.sources.notes import read_statistics
    path = write_csv(export_feed(policy_log(spark, sf), FLAGSHIP, NOW), scratch_path(spark, "feed"), order_by="start_time")
    n = read_statistics(spark, path)
    return spark.createDataFrame([(n.rows, n.max_start_time, n.min_hour, n.max_hour)],
                                 "n_rows long, max_start_time long, min_hour long, max_hour long")


#: A value of each type of the log tables, by the column's name {c} and place {i}.
_VALUES = {
    "string": "concat('{c}/', event_id % 97)", "int": "CAST((event_id + {i}) % 1000 AS INT)", "bigint": "event_id * 1000 + {i}",
    "float": "CAST(event_id % 100 + 0.5 AS FLOAT)", "array<string>": "array('{c}', event_type)", "array<int>": "array(CAST(event_id % 7 AS INT), {i})",
    "map<string,string>": "map('k', event_type, 'n', CAST(event_id % 5 AS STRING))",
    "array<map<string,string>>": "array(map('name', concat(event_type, '.example')), map('ttl', CAST(event_id % 11 AS STRING)))",
    "array<struct<ip:string,cc:string,region:string,city:string,asnum:string,asname:string>>":
        "array(named_struct('ip', concat('10.0.0.', event_id % 256), 'cc', 'US', 'region', CAST(NULL AS STRING), 'city', event_type, "
        "'asnum', CAST(event_id % 9 AS STRING), 'asname', '{c}'))",
}


def _log_rows(spark, sf, kind):
    """The rows of a kind with only the columns that the others are computed from."""
    log = policy_log(spark, sf).filter(F.col("subscriber").endswith(".proxy") == F.lit(kind == "proxy"))
    return log.select("event_id", "event_type", "start_time", "parent_policies", *dict(PARTITION_COLUMNS))


def _log_columns(kind):
    """The 44 or 50 data columns and 5 partition columns of a kind over ``_log_rows``, all with values."""
    given = {"start_time": "start_time", "parent_policies": "parent_policies", "policies": "array(event_type, 'any')"}
    value = lambda f, i: F.expr(given.get(f.name) or _VALUES[f.dataType.simpleString()].format(c=f.name, i=i))
    own = dict(PARTITION_COLUMNS)
    return [F.col(f.name) if f.name in own else value(f, i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema_for(kind).fields)]


def _log_frame(spark, sf, kind):
    """The full schema of a kind, derived from ``events``."""
    return _log_rows(spark, sf, kind).select(*_log_columns(kind))


_full_copies: dict[tuple, str] = {}


def _full_copy(spark, sf) -> str:
    """Both kinds with their full schemas below one root, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _full_copies:
        root = scratch_path(spark, "logs")
        for k in ("dns", "proxy"):
            write_partitioned(_log_rows(spark, sf, k), root, mode="append", columns=_log_columns(k))
        _full_copies[key] = root
    return _full_copies[key]


def _reader(kind):
    def q(spark, sf):
        """Every column of the kind's own full schema, nested ones rendered."""
        root = _full_copy(spark, sf)
        return render_nested((read_dns if kind == "dns" else read_proxy)(spark, root))
    return q


def q_add_partition_at(spark, sf):
    """One partition registered at an explicit location outside the table's root."""
    logs = policy_log(spark, sf)
    away = scratch_path(spark, "away")
    logs.select(*[c for c in logs.columns if c not in dict(PARTITION_COLUMNS)]).write.parquet(away)
    name = _table_name(spark)
    create_log_table(spark, name, _log_schema(), scratch_path(spark, "empty-root"))
    row = {"subscriber": "it's:here", "year": 2024, "month": 1, "day": 31, "hour": NOW, "location": away}
    add_partitions(spark, name, [row])
    return spark.table(name).select("event_id", "start_time", *dict(PARTITION_COLUMNS))


def q_window_choice(spark, sf):
    """Each form of the window, and its bounds on ``hour``."""
    logs = policy_log(spark, sf)
    specs = {"hours": FeedSpec(parent_policies="view", hours_ago=5), "current": FeedSpec(parent_policies="view", hours_ago=0),
             "days": FeedSpec(parent_policies="view", hours_ago=30, full_days=True),
             "range": FeedSpec(parent_policies="view", day_range="20240120-20240121")}
    out = None
    for name, spec in specs.items():
        one = logs.filter(spec.hour_predicate(NOW)).agg(F.count("*").alias("n"), F.min("hour").alias("first"), F.max("hour").alias("last"))
        one = one.select(F.lit(name).alias("form"), "n", "first", "last")
        out = one if out is None else out.unionByName(one)
    return out


def q_policy_column_choice(spark, sf):
    """The export over ``policies`` instead of ``parent_policies`` (the latter stays as a column)."""
    logs = _log_frame(spark, sf, "dns")
    spec = FeedSpec(policies="error,any", hours_ago=72)
    return export_feed(logs, spec, NOW).select("start_time", "policy", "parent_policies", *[n for n, _ in PARTITION_COLUMNS])


QUERIES: dict[str, Query] = {
    "policy_hits_hours_ago": q_policy_hits_hours_ago,
    "policy_hits_full_days": q_policy_hits_full_days,
    "policy_hits_day_range": q_policy_hits_day_range,
    "explode_duplicates_and_nulls": q_explode_duplicates_and_nulls,
    "policy_hits_prefiltered": q_policy_hits_prefiltered,
    "policy_hits_unnest_then_filter": q_policy_hits_unnest_then_filter,
    "policy_hits_filter_in_generator": q_policy_hits_filter_in_generator,
    "policy_list_filter": q_policy_list_filter,
    "kind_dns": _kind("dns"),
    "kind_proxy": _kind("proxy"),
    "union_all_subscribers": q_union_all_subscribers,
    "source_names": q_source_names,
    "stored_partitions": q_stored_partitions,
    "missing_partitions": q_missing_partitions,
    "sync_partitions": q_sync_partitions,
    "catalog_table_export": q_catalog_table_export,
    "latest_snapshot_rows": q_latest_snapshot_rows,
    "retained_snapshot": q_retained_snapshot,
    "seam_snapshot": q_seam_snapshot,
    "last_seen_hour": q_last_seen_hour,
    "refresh_feed_strict": q_refresh_feed_strict,
    "refresh_feed_catchup": q_refresh_feed_catchup,
    "refresh_hour_table": q_refresh_hour_table,
    "run_metrics": q_run_metrics,
    "csv_roundtrip": q_csv_roundtrip,
    "render_array": q_render_array,
    "render_map": q_render_map,
    "render_nested": q_render_nested,
    "hits_ordered": q_hits_ordered,
    "multi_feed_hits": q_multi_feed_hits,
    "feed_locations": q_feed_locations,
    "feed_export_job": q_feed_export_job,
    "multi_feed_csv": q_multi_feed_csv,
    "saved_view_sql": q_saved_view_sql,
    "stream_hits_available_now": q_stream_hits_available_now,
    "stream_hits_dns": _stream_hits("dns"),
    "stream_hits_proxy": _stream_hits("proxy"),
    "read_dns_full_schema": _reader("dns"),
    "read_proxy_full_schema": _reader("proxy"),
    "add_partition_at_location": q_add_partition_at,
    "window_choice": q_window_choice,
    "policy_column_choice": q_policy_column_choice,
    "sync_with_locations": q_sync_with_locations,
    "repair_then_read": q_repair_then_read,
    "latest_snapshot_many_incomplete": q_latest_snapshot_many_incomplete,
    "refresh_hour_feed_csv": q_refresh_hour_feed,
    "refresh_hour_table_corrected": q_refresh_hour_table_corrected,
    "multi_feed_by_source": q_multi_feed_by_source,
    "multi_feed_by_day": q_multi_feed_by_day,
    "feed_export_republish": q_feed_export_republish,
    "stream_hits_retained": q_stream_hits_retained,
    "stream_hits_compacted": q_stream_hits_compacted,
    "csv_roundtrip_escaped": q_csv_roundtrip_escaped,
    "feed_statistics": q_feed_statistics,
}
