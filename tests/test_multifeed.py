"""Many feeds in one scan equal the union of single-feed exports."""

import hashlib

import pytest

from pyspark.sql import functions as F

from hitfeed.fixtures import NOW
from hitfeed.functions.render import render_nested
from hitfeed.functions.location import location_column, location_hash
from hitfeed.operators.multifeed import Feed, merged_windows, multi_feed_hits
from hitfeed.plans.export import export_feed, export_multi
from hitfeed.plans.feed import FeedSpec

FEEDS = [
    Feed("a", FeedSpec(parent_policies="error,p3", hours_ago=72, full_days=True)),
    Feed("b", FeedSpec(parent_policies="p3", hours_ago=1, full_days=True)),
    Feed("c", FeedSpec(parent_policies="view,view,,click", hours_ago=720, full_days=True)),
    Feed("d", FeedSpec(parent_policies="p1", day_range="20240105-20240106"), kind="proxy"),
]


def union_of_singles(log):
    out = None
    for f in FEEDS:
        src = log
        if f.kind == "proxy":
            src = log.filter(F.col("subscriber").endswith(".proxy"))
        one = export_feed(src, f.spec, NOW).select(F.lit(f.name).alias("feed"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_equals_union(spark, small_log):
    got = export_multi(small_log, FEEDS, NOW)
    assert got.columns[0] == "feed"
    assert same(got, union_of_singles(small_log))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_shuffle_path_same(spark, small_log):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = export_multi(small_log, FEEDS, NOW)
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert same(got, union_of_singles(small_log))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_subscriber_sees_its_own_rows_only(spark, small_log):
    feeds = [Feed("s0", FeedSpec(parent_policies="error", hours_ago=720), subscriber="sub.0"),
             Feed("s1", FeedSpec(parent_policies="error", hours_ago=720), subscriber="sub.1", kind="dns"),
             Feed("all", FeedSpec(parent_policies="error", hours_ago=720))]
    got = {(r["feed"], r["subscriber"]) for r in export_multi(small_log, feeds, NOW).select("feed", "subscriber").distinct().collect()}
    every = {(f"sub.{i}{k}") for i in range(3) for k in ("", ".proxy")}
    assert got == {("s0", "sub.0"), ("s0", "sub.0.proxy"), ("s1", "sub.1")} | {("all", s) for s in every}
    only = export_multi(small_log, feeds[:2], NOW)
    assert same(only, export_multi(small_log, feeds, NOW).filter("feed <> 'all'"))


def test_both_bounds_and_kind_reach_the_scan(spark, small_log):
    from hitfeed.fixtures import write_partitioned
    from hitfeed.session import scratch_path
    root = scratch_path(spark, "bounds")
    write_partitioned(small_log.filter("day IN (26, 27, 28)"), root)
    logs = spark.read.schema(small_log.schema).option("basePath", root).parquet(root)
    feeds = [Feed("d", FeedSpec(parent_policies="error", day_range="20240127-20240127"), kind="dns")]
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = multi_feed_hits(logs, feeds, NOW)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    filters = plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "1706313600" in filters and "1706400000" in filters and "EndsWith" in filters


def test_merged_windows():
    assert merged_windows([(5, 9), (1, 3), (3, 6), (20, None), (25, 30)]) == [(1, 9), (20, None)]
    assert merged_windows([(1, None), (0, 5)]) == [(0, None)]


@pytest.mark.parametrize("row, fault", [
    (("x", "a", None, None, None), "exactly one"), (("x", "a", "-1", None, None), "hours_ago"), (("x", "a", "1.5", None, None), "hours_ago"),
    (("x", "a", "1", "20240101-20240102", None), "exactly one"), (("x", "a", None, "20240103-20240102", None), "day range"),
    (("x", "a", None, "20240199-20240202", None), "day range"), (("x", "a", None, "2024-01-01", None), "day range"),
    (("x", "a", "1", None, "web"), "kind"), (("x", ",,", "1", None, None), "empty"), (("x", None, "1", None, None), "no policies"),
    ((None, "a", "1", None, None), "name")])
def test_invalid_feeds_raise(spark, small_log, row, fault):
    table = spark.createDataFrame([("ok", "a", "1", None, "DNS"), row],
                                  "feed string, parent_policies string, hours_ago string, day_range string, kind string")
    with pytest.raises(ValueError, match=fault):
        multi_feed_hits(small_log, table, NOW)


def test_many_feeds_plan_quickly(spark, small_log):
    import time
    feeds = [Feed(f"f{i}", FeedSpec(parent_policies=f"p{i % 7},x{i}", hours_ago=720), subscriber=f"sub.{i % 3}") for i in range(5000)]
    started = time.time()
    multi_feed_hits(small_log, feeds, NOW)._jdf.queryExecution().executedPlan()
    assert time.time() - started < 20  # a few seconds here; one literal per feed took minutes


def test_feeds_table(spark, small_log):
    table = spark.createDataFrame(
        [("a", "error,p3", 72, True, None), ("b", "p3", 1, True, None), ("c", "view,view,,click", 720, True, None)],
        "feed string, policies string, hours_ago int, full_days boolean, kind string")
    got = render_nested(multi_feed_hits(small_log, table, NOW))
    want = union_of_singles(small_log).filter("feed != 'd'")
    assert got.columns == want.columns and same(got, want)


def test_location_hash(spark):
    want = hashlib.pbkdf2_hmac("sha512", b"sub.xops@x.org", b"salt7", 100000).hex()
    assert location_hash("salt", "7", "sub.x", "ops@x.org") == want and len(want) == 128
    df = spark.createDataFrame([("7", "sub.x", "ops@x.org"), ("7", None, "r")], "o string, s string, r string")
    rows = df.select(location_column("salt", "o", "s", "r").alias("loc")).collect()
    assert rows[0]["loc"] == want and rows[1]["loc"] is None


def test_location_carried_into_hits(spark, small_log):
    feeds = spark.createDataFrame([(f.name, "sub.x", "ops@x.org", "1") for f in FEEDS[:2]],
                                  "feed string, subscriber string, receiver string, ordinal string")
    extra = feeds.select("feed", location_column("s3cret", "ordinal", "subscriber", "receiver").alias("feed_location"))
    got = multi_feed_hits(small_log, FEEDS[:2], NOW, extra=extra)
    locs = {r[0] for r in got.select("feed_location").distinct().collect()}
    assert locs == {location_hash("s3cret", "1", "sub.x", "ops@x.org")}


def test_feed_locations_frame(spark, small_log):
    from hitfeed.operators.multifeed import feed_locations_frame
    feeds = [Feed("a", FeedSpec(parent_policies="error", hours_ago=72), subscriber="s1", receiver="r1", ordinal="1"),
             Feed("b", FeedSpec(parent_policies="p3", hours_ago=72), subscriber="s2", receiver="r2", ordinal="2")]
    locs = {r["feed"]: r["feed_location"] for r in feed_locations_frame(spark, feeds, "salt").collect()}
    assert locs == {"a": location_hash("salt", "1", "s1", "r1"), "b": location_hash("salt", "2", "s2", "r2")}
    feeds = [Feed(f.name, f.spec, subscriber=f"sub.{i}", receiver="r", ordinal="1") for i, f in enumerate(feeds)]
    hits = multi_feed_hits(small_log, feeds, NOW, extra=feed_locations_frame(spark, feeds, "salt"))
    assert hits.filter("feed_location IS NULL").count() == 0
    with pytest.raises(ValueError):
        feed_locations_frame(spark, [Feed("c", FeedSpec(parent_policies="x", hours_ago=1))], "salt")


def test_salted_shuffle_path_same(spark, small_log):
    got = export_multi(small_log, FEEDS, NOW, salt_buckets=4)
    assert same(got, union_of_singles(small_log))


def plain_buckets(lo, hi, cap, spans):
    """The hours of a window's buckets, by going through every hour."""
    return [h for h in range(-6 * 3600, cap + 6 * 3600, 3600) if h >= lo and (hi is None or h < hi)]


def test_buckets_make_up_the_window(spark):
    from hitfeed.operators.multifeed import SPANS, FeedScope, row_buckets, window_buckets
    day, cap = 86400, 70 * 86400
    hours = spark.range(-6, cap // 3600 + 6).selectExpr("id * 3600 AS hour")
    windows = [(0, day), (0, None), (3600, 7200), (5 * 3600, 2 * day + 3600), (day, 65 * day), (64 * day, None), (3 * 3600, 69 * day + 7 * 3600),
               (-7200, 3600), (-9 * 3600, None), (cap, None), (cap + 3600, None), (cap - 3600, cap + 7200), (69 * day + 3600, None), (2 * day, 2 * day)]
    table = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(windows)], "i int, lo long, hi long")
    scope = FeedScope(windows, {None}, False, True)
    assert scope.spans(cap) == list(SPANS)
    keys = table.select("i", "lo", "hi", F.explode(window_buckets("lo", "hi", cap)).alias("b"))
    rows = hours.select("hour", F.explode(F.array(*row_buckets("hour", SPANS, cap))).alias("b"))
    met = rows.join(keys, "b").filter("(hour >= 0 AND hour < %d) OR (hour >= lo AND (hi IS NULL OR hour < hi))" % cap)
    got = {}
    for r in met.collect():
        got.setdefault(r["i"], []).append(r["hour"])
    for i, (lo, hi) in enumerate(windows):
        assert sorted(got.get(i, [])) == plain_buckets(lo, hi, cap, SPANS)  # each hour once
    assert keys.groupBy("i").count().agg(F.max("count")).first()[0] < 240


def test_hour_buckets_only_where_needed():
    from hitfeed.operators.multifeed import FeedScope
    day = 86400
    assert FeedScope([(0, day), (day, None)], {None}, False, True).spans(3 * day) == [day]
    assert FeedScope([(3600, None)], {None}, False, True).spans(3 * day) == [day, 3600]
    assert FeedScope([(0, None)], {None}, False, True).spans(90 * day) == [64 * day, day]


def test_feeds_of_other_windows_are_no_candidates(spark, small_log):
    """Thousands of feeds on one policy, most of them one hour long: the join's keys alone give the result."""
    from hitfeed.operators import multifeed as mf
    n = 3000
    feeds = spark.range(n).selectExpr("concat('f', id) AS feed", "'error' AS parent_policies", "CAST(NULL AS STRING) AS source",
                                      f"{NOW} - 3600 * (1 + id % 700) AS lo")
    table = feeds.selectExpr("feed", "source", "parent_policies AS policy", "lo AS min_hour", "lo + 3600 AS max_hour", "CAST(NULL AS STRING) AS kind")
    cap = mf.time_cap(NOW)
    scope = mf.FeedScope.of_table(table)
    assert len(scope.windows) == 700 and scope.spans(cap) == [86400, 3600]
    keys = table.select("feed", "policy", F.explode(mf.window_buckets("min_hour", "max_hour", cap)).alias("b"))
    assert keys.count() == n
    hits = mf.wanted_hits(small_log, "parent_policies", scope, table)
    rows = hits.select("event_id", "policy", "hour", F.explode(F.array(*mf.row_buckets("hour", scope.spans(cap), cap))).alias("b"))
    want = hits.join(table, "policy").filter("hour >= min_hour AND hour < max_hour").count()
    assert want > n / 10 and rows.join(keys, ["policy", "b"]).count() == want


def test_bitmap_drops_rows_before_the_generator(spark, small_log):
    from hitfeed.operators import multifeed as mf
    table = spark.createDataFrame([("a", f"x{i}") for i in range(3000)] + [("b", "p3")], "feed string, policy string")
    bits = mf.policy_bitmap(table).first()["words"]
    assert len(bits) == mf.BITMAP_BITS // 64 and 2800 < sum(bin(w & (1 << 64) - 1).count("1") for w in bits) <= 3001
    scope = mf.FeedScope([(0, None)], {None}, False, True)
    hits = mf.wanted_hits(small_log, "parent_policies", scope, table)
    kept = {r[0] for r in hits.select("policy").distinct().collect()}
    assert "p3" in kept and len(kept) <= 3  # nearly all of the others are gone
    assert hits.filter("policy = 'p3'").count() == small_log.select(F.explode("parent_policies").alias("p")).filter("p = 'p3'").count()
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "exists" in plan[plan.index("Generate"):]  # the test on the array is below the generator


def test_many_policies_in_a_list_of_feeds(spark, small_log):
    feeds = [*FEEDS, Feed("many", FeedSpec(parent_policies=",".join(f"x{i}" for i in range(500)) + ",p2", day_range="20240101-20240103"))]
    got = export_multi(small_log, feeds, NOW)
    extra = export_feed(small_log, feeds[-1].spec, NOW).select(F.lit("many").alias("feed"), "*")
    assert extra.count() and same(got, union_of_singles(small_log).unionByName(extra))


def test_rows_outside_the_ordinary_range(spark, small_log):
    odd = small_log.limit(4).withColumn("hour", F.expr(f"CAST(element_at(array(-7200, {NOW + 5 * 86400}, {NOW + 86400}, NULL), "
                                                         "CAST(1 + monotonically_increasing_id() % 4 AS INT)) AS INT)"))
    odd = spark.createDataFrame(odd.withColumn("parent_policies", F.array(F.lit("error"))).collect(), small_log.schema)
    feeds = [Feed("open", FeedSpec(parent_policies="error", hours_ago=5)), Feed("day", FeedSpec(parent_policies="error", day_range="20240205-20240205")),
             Feed("all", FeedSpec(parent_policies="error", hours_ago=10 ** 6), kind="dns")]
    got = export_multi(odd, feeds, NOW)
    want = None
    for f in feeds:
        src = odd.filter("NOT endswith(subscriber, '.proxy')") if f.kind else odd
        one = export_feed(src, f.spec, NOW).select(F.lit(f.name).alias("feed"), "*")
        want = one if want is None else want.unionByName(one)
    assert got.count() >= 3 and same(got, want)
