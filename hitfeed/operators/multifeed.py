"""Many feeds in one scan.

The per-feed form scans the source once per feed.  Here the source is scanned once, with the feeds' merged
time windows (both bounds) and their common kind as partition filters.

* **Before the generator** rows without a wanted policy are dropped: by the policies as literals where a
  list of feeds names few, else by a bitmap of policy hashes that Spark aggregates from the feed table (a fixed
  size however many the policies are; a false positive only costs work, the join decides).
* **The join** is on source, policy and time.  Every window is cut into buckets of aligned spans (64 days, a day, an
  hour) that together are exactly the window, so a row meets a feed only if it is one of its hits, and once: feeds
  with other windows on the same policy are no candidates.  A row carries one key for each size of bucket
  that occurs.  Before 1970 and after the day of ``now`` there is one bucket each, where the bounds decide.

The result equals the union of the per-feed exports, tagged by feed.  Policy lists are de-duplicated per feed
first: ``IN`` is idempotent, a join is not.  A feed with a subscriber gets that subscriber's rows only (its proxy
logs included); a feed without one gets every subscriber's.

Sizing: the feed table is an ordinary DataFrame, whatever its size, and the plan is the same for few
and many feeds.  Spark broadcasts it if its size is below the session's broadcast threshold;
otherwise the join is a shuffle join, where AQE splits a policy that holds a large share of the
hits (``salt_buckets`` splits it explicitly).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hitfeed.functions.policies import unique_policies
from hitfeed.functions.timebounds import DAY, HOUR
from hitfeed.operators.hits import explode_policies
from hitfeed.plans.feed import FeedSpec
from hitfeed.schemas import PROXY_SUFFIX, normalize_kind
from hitfeed.sources.logs import kind_predicate

FEED_TABLE_DDL = "feed string, source string, policy string, min_hour long, max_hour long, kind string"

#: Join key of feeds that read every subscriber.
ANY_SOURCE = ""
#: Sizes of time buckets, the largest first.
SPANS = (64 * DAY, DAY, HOUR)
#: A bucket that no window has.
NO_BUCKET = -2
#: Bits of the policy bitmap, and policies of a list of feeds up to which literals are used instead.
BITMAP_BITS, LITERALS = 1 << 16, 64


@dataclass(frozen=True)
class Feed:
    """One feed job: a name, a spec, optional kind and subscriber restrictions, location inputs."""

    name: str
    spec: FeedSpec
    kind: str | None = None
    subscriber: str | None = None
    receiver: str | None = None
    ordinal: str | None = None
    output_filename: str | None = None

    def __post_init__(self):
        if self.kind is not None:
            object.__setattr__(self, "kind", normalize_kind(self.kind))


def feed_rows(feeds: Sequence[Feed], now: int) -> list[tuple]:
    """(feed, source, policy, min_hour, max_hour, kind) per distinct policy of each feed."""
    names = [f.name for f in feeds]
    if len(set(names)) != len(names):
        raise ValueError(f"feed names must be unique: {names}")
    rows = []
    for f in feeds:
        lo, hi = f.spec.window(now)
        rows += [(f.name, f.subscriber, p, lo, hi, f.kind) for p in unique_policies(f.spec.values)]
    return rows


def feeds_frame(spark: SparkSession, feeds: Sequence[Feed], now: int) -> DataFrame:
    """The rows of a list of feeds, as a local relation: Spark knows its size without a job."""
    schema = T._parse_datatype_string(FEED_TABLE_DDL)
    columns = zip(*feed_rows(feeds, now))
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.fieldNames()), schema)


def feed_locations_frame(spark: SparkSession, feeds: Sequence[Feed], salt: str) -> DataFrame:
    """``(feed, feed_location, output_filename)`` for feeds that carry subscriber, receiver and
    ordinal; the slow hash runs in the Arrow UDF on executors, one row per feed.  Pass it as
    ``extra`` to :func:`multi_feed_hits`."""
    from hitfeed.functions.location import location_column

    rows = [(f.name, f.ordinal, f.subscriber, f.receiver, f.output_filename) for f in feeds]
    missing = [r[0] for r in rows if None in r[1:4]]
    if missing:
        raise ValueError(f"feeds without ordinal/subscriber/receiver: {missing}")
    table = spark.createDataFrame(rows, "feed string, ordinal string, subscriber string, receiver string, output_filename string")
    named = ["output_filename"] if any(r[4] for r in rows) else []
    return table.select("feed", location_column(salt, "ordinal", "subscriber", "receiver").alias("feed_location"), *named)


def feed_table_from_frame(feeds: DataFrame, now: int, delimiter: str = ",",
                          policy_column: str = "parent_policies") -> DataFrame:
    """A feeds *table* -> the (feed, source, policy, min_hour, max_hour, kind) form, computed by Spark.

    Columns: ``feed``, ``policies`` and/or ``parent_policies`` (one of them set per feed; a table with
    ``policies`` alone is read for either column), ``hours_ago`` or ``day_range`` (exactly one set), and
    optionally ``full_days``, ``kind``, ``subscriber`` and ``delimiter``.  Rows for the other policy
    column are left out.  A row that breaks a rule of :class:`FeedSpec` raises ``ValueError``.
    """
    cols = set(feeds.columns)
    col = lambda name, kind: F.col(name).cast(kind) if name in cols else F.lit(None).cast(kind)
    both = {"policies", "parent_policies"} <= cols
    lists = F.col(policy_column if both else "policies" if "policies" in cols else "parent_policies")
    other = F.col("policies" if policy_column == "parent_policies" else "parent_policies") if both else F.lit(None)
    text = lambda c: F.coalesce(c, F.lit(""))
    full = F.coalesce(col("full_days", "boolean"), F.lit(False))
    hours = F.expr("try_cast(hours_ago AS BIGINT)") if "hours_ago" in cols else F.lit(None).cast("long")
    given = F.col("hours_ago").isNotNull() if "hours_ago" in cols else F.lit(False)
    days = col("day_range", "string")
    kind = F.lower(col("kind", "string"))
    cut = F.coalesce(col("delimiter", "string"), F.lit(delimiter))
    parts = F.array_distinct(F.filter(F.split(lists, F.concat(F.lit("\\Q"), cut, F.lit("\\E"))), lambda p: p != F.lit("")))
    back = F.lit(int(now)) - F.lit(HOUR) * hours
    day = lambda at: F.unix_date(F.try_to_timestamp(F.substring(days, at, 8), F.lit("yyyyMMdd")).cast("date")).cast("long") * DAY
    form = days.isNotNull() & F.coalesce(days.rlike("^[0-9]{8}-[0-9]{8}$"), F.lit(False))
    start, end = F.when(form, day(1)), F.when(form, day(10) + DAY)
    unit = F.when(full, F.lit(DAY)).otherwise(F.lit(HOUR))
    rows = feeds.select(
        F.col("feed").cast("string").alias("feed"), col("subscriber", "string").alias("source"), parts.alias("parts"),
        F.when(given, back - F.pmod(back, unit)).otherwise(start).alias("min_hour"),
        F.when(~given, end).alias("max_hour"), kind.alias("kind"),
        F.concat_ws(
            "; ", F.when(F.col("feed").isNull(), "no feed name"),
            F.when((text(lists) != "") & (text(other) != ""), "both policy columns are set"),
            F.when((text(lists) == "") & (text(other) == ""), "no policies"),
            F.when((text(lists) != "") & (F.size(parts) == 0), "empty policy list"),
            F.when(given == days.isNotNull(), "exactly one of hours_ago and day_range must be set"),
            F.when(given & F.coalesce(hours < 0, F.lit(True)), "hours_ago is not a whole number of hours"),
            F.when(days.isNotNull() & F.coalesce(start >= end, F.lit(True)), "invalid day range"),
            F.when(days.isNotNull() & full, "full_days applies to hours_ago windows only"),
            F.when(kind.isNotNull() & ~F.coalesce(kind.isin("dns", "proxy"), F.lit(False)), "unknown kind"),
        ).alias("fault"), (text(other) == "").alias("ours"))
    bad = rows.filter("fault <> ''").agg(F.count("*").alias("n"), F.min(F.struct("feed", "fault")).alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} invalid feeds, e.g. {bad['first']['feed']!r}: {bad['first']['fault']}")
    return rows.filter("ours").select("feed", "source", F.explode("parts").alias("policy"), "min_hour", "max_hour", "kind")


def merged_windows(windows: Sequence[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """Half-open windows joined where they meet; an end of None is open."""
    out: list[tuple[int, int | None]] = []
    for lo, hi in sorted(windows, key=lambda w: w[0]):
        if out and (out[-1][1] is None or lo <= out[-1][1]):
            last = out[-1][1]
            out[-1] = (out[-1][0], None if last is None or hi is None else max(last, hi))
        else:
            out.append((lo, hi))
    return out


@dataclass(frozen=True)
class FeedScope:
    """What the feeds have in common: known before the join is planned."""

    windows: list[tuple[int, int | None]]
    kinds: set[str | None]
    named: bool  # some feeds name a subscriber
    unnamed: bool  # some do not
    policies: list[str] | None = None  # all of them, if they are few

    @classmethod
    def of_list(cls, feeds: Sequence[Feed], now: int) -> FeedScope:
        if not feeds:
            raise ValueError("no feeds")
        policies = sorted({p for f in feeds for p in f.spec.values})
        return cls(sorted({f.spec.window(now) for f in feeds}, key=str), {f.kind for f in feeds}, any(f.subscriber for f in feeds),
                   not all(f.subscriber for f in feeds), policies if len(policies) <= LITERALS else None)

    @classmethod
    def of_table(cls, table: DataFrame) -> FeedScope:
        """The distinct windows and kinds reach the driver: at most a few for each hour of retention."""
        rows = table.select("min_hour", "max_hour", "kind", F.col("source").isNull().alias("any")).distinct().collect()
        if not rows:
            raise ValueError("no feeds")
        return cls(sorted({(r["min_hour"], r["max_hour"]) for r in rows}, key=str), {r["kind"] for r in rows},
                   not all(r["any"] for r in rows), any(r["any"] for r in rows))

    def predicate(self) -> Column:
        """Partition predicate of the scan."""
        out = None
        for lo, hi in merged_windows(self.windows):
            p = F.col("hour") >= F.lit(lo)
            p = p if hi is None else p & (F.col("hour") < F.lit(hi))
            out = p if out is None else out | p
        if len(self.kinds) == 1 and None not in self.kinds:
            out = out & kind_predicate(next(iter(self.kinds)))
        return out

    def spans(self, cap: int) -> list[int]:
        """Bucket sizes that occur in the windows."""
        length = max((cap if hi is None else min(hi, cap)) - max(lo, 0) for lo, hi in self.windows)
        hourly = any(0 < x < cap and x % DAY for w in self.windows for x in w if x is not None)
        return [s for s, used in zip(SPANS, (length >= SPANS[0], True, hourly)) if used]


def time_cap(now: int) -> int:
    """The first hour of the day after ``now``: from there on rows share one bucket."""
    return now - now % DAY + DAY


def bucket(span: int, at: str) -> str:
    """One number (SQL) for the aligned bucket of a size that starts at ``at``; the outer buckets are those of size 0."""
    return f"({at}) * 4L + {SPANS.index(span) if span else 3}"


def window_buckets(lo: str, hi: str, cap: int) -> Column:
    """Array of the aligned buckets that make up the window of columns ``lo`` <= hour < ``hi`` (open where null).

    As one SQL expression: built from single columns it costs more time than the join of a few feeds."""
    up = lambda x, s: f"({x} + pmod(-{x}, {s}L))"
    down = lambda x, s: f"({x} - pmod({x}, {s}L))"

    def whole(a: str, b: str, span: int) -> str:
        return f"CASE WHEN {a} < {b} THEN transform(sequence({a}, {b} - {span}L, {span}L), at -> {bucket(span, 'at')}) ELSE none END"

    def cut(a: str, b: str, spans: tuple[int, ...]) -> list[str]:
        """The largest buckets within [a, b), then the smaller ones on both sides of them."""
        span, rest = spans[0], spans[1:]
        if not rest:
            return [whole(a, b, span)]
        left = f"least({up(a, span)}, {b})"
        right = f"greatest({down(b, span)}, {left})"
        return [whole(left, right, span), *cut(a, left, rest), *cut(right, b, rest)]

    ends = f"struct(greatest({lo}, 0L) AS a, least(coalesce({hi}, {cap}L), {cap}L) AS b)"
    outer = [f"CASE WHEN {lo} < 0 THEN array({bucket(0, '-1')}) ELSE none END",
             f"CASE WHEN coalesce({hi} > {cap}, true) THEN array({bucket(0, str(cap))}) ELSE none END"]
    every = ", ".join([*cut("w.a", "w.b", SPANS), *outer]).replace("none", "CAST(array() AS ARRAY<BIGINT>)")
    return F.expr(f"transform(array({ends}), w -> concat({every}))[0]")


def row_buckets(hour: str, spans: Sequence[int], cap: int) -> list[Column]:
    """The bucket of a row for each size; before 1970 and from ``cap`` on the outer one (and one that no feed has)."""
    outer = f"CASE WHEN {hour} < 0 THEN {bucket(0, '-1')} ELSE {bucket(0, str(cap))} END"
    # never null: nothing has to be tested before the join
    return [F.expr(f"coalesce(CASE WHEN {hour} >= 0 AND {hour} < {cap} THEN {bucket(s, f'{hour} - pmod({hour}, {s})')} "
                   f"ELSE {NO_BUCKET if i else outer} END, {NO_BUCKET}L)") for i, s in enumerate(spans)]


def policy_bitmap(table: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """One row, one array of 64-bit words: the hashes of all policies of the feed table."""
    at = F.pmod(F.xxhash64("policy"), F.lit(bits))
    words = table.select(F.floor(at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    held = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.select(F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda w: F.coalesce(F.col("held")[w], F.lit(0).cast("long"))).alias("words"))


def in_bitmap(policy: Column, words: Column, bits: int = BITMAP_BITS) -> Column:
    at = F.pmod(F.xxhash64(policy), F.lit(bits))
    return F.call_function("shiftright", words[F.floor(at / 64).cast("int")], (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def wanted_hits(logs: DataFrame, column: str, scope: FeedScope, table: DataFrame) -> DataFrame:
    """The exploded hits of rows that hold a policy of some feed; others are dropped before the generator."""
    if scope.policies is not None:
        return explode_policies(logs, column, scope.policies)
    words = F.col("_words")
    rows = logs.withColumn("_words", policy_bitmap(table).scalar()).filter(F.exists(column, lambda p: in_bitmap(p, words)))
    hits = explode_policies(rows.drop("_words"), column)
    return hits.withColumn("_words", policy_bitmap(table).scalar()).filter(in_bitmap(F.col("policy"), words)).drop("_words")


def multi_feed_hits(logs: DataFrame, feeds, now: int, *, policy_column: str = "parent_policies",
                    extra: DataFrame | None = None, salt_buckets: int | None = None) -> DataFrame:
    """Union of per-feed hits, with the feed name first.

    ``feeds``: a sequence of :class:`Feed` (all on ``policy_column``) or a feeds table (see
    :func:`feed_table_from_frame`).  ``extra``: optional ``(feed, ...)`` frame whose other
    columns (e.g. ``feed_location``) are carried into the output; it has one row per feed.
    ``salt_buckets``: split every policy over that many join keys -- hits get a deterministic
    salt from a row hash, the feed table is replicated once per bucket -- so a policy holding
    a large share of the hits is spread over as many tasks even without AQE's skew handling.
    """
    spark = logs.sparkSession
    if isinstance(feeds, DataFrame):
        table = feed_table_from_frame(feeds, now, policy_column=policy_column)
        scope = FeedScope.of_table(table)
    else:
        for f in feeds:
            if f.spec.policy_column != policy_column:
                raise ValueError(f"feed {f.name!r} reads {f.spec.policy_column}, not {policy_column}")
        table = feeds_frame(spark, feeds, now)
        scope = FeedScope.of_list(feeds, now)
    hits = wanted_hits(logs.filter(scope.predicate()), policy_column, scope, table)

    # the keys of a hit: its buckets, and its subscriber or the key of every subscriber, where feeds name some
    cap = time_cap(int(now))
    buckets = row_buckets("hour", scope.spans(cap), cap)
    subscriber = F.regexp_replace(F.col("subscriber"), PROXY_SUFFIX.replace(".", r"\.") + "$", "")
    sources = [subscriber] * scope.named + [F.lit(ANY_SOURCE)] * scope.unnamed
    several = lambda keys: keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    keyed = hits.withColumn("_bucket", several(buckets))
    f = table.withColumn("_f_bucket", F.explode(window_buckets("min_hour", "max_hour", cap)))
    f = f.select("_f_bucket", F.coalesce("source", F.lit(ANY_SOURCE)).alias("_f_source"),
                 *[F.col(c).alias(f"_f_{c}") for c in table.columns if c != "source"])
    cond = (keyed["_bucket"] == F.col("_f_bucket")) & (keyed["policy"] == F.col("_f_policy"))
    if scope.named:
        keyed = keyed.withColumn("_source", several(sources))
        cond = cond & (keyed["_source"] == F.col("_f_source"))
    # the bounds decide in the outer buckets only, the first (before 1970) and the last
    outer = (keyed["hour"] < 0) | (keyed["hour"] >= cap)
    cond = cond & (~outer | ((keyed["hour"] >= F.col("_f_min_hour"))
                             & (F.col("_f_max_hour").isNull() | (keyed["hour"] < F.col("_f_max_hour")))))
    if scope.kinds not in ({None}, {"dns"}, {"proxy"}):  # one kind of all feeds is in the predicate of the scan
        is_proxy = F.col("subscriber").endswith(PROXY_SUFFIX)
        cond = cond & (F.col("_f_kind").isNull() | ((F.col("_f_kind") == F.lit("proxy")) == is_proxy))
    if salt_buckets and salt_buckets > 1:
        n = int(salt_buckets)
        # spread by a hash of the scalar columns (maps cannot be hashed)
        scalar = [c.name for c in hits.schema.fields if isinstance(c.dataType, T.AtomicType)]
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in scalar]), F.lit(n)))
        f = f.withColumn("_f_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        cond = cond & (F.col("_salt") == F.col("_f_salt"))
    out = keyed.join(f, cond, "inner").select(F.col("_f_feed").alias("feed"), *[keyed[c] for c in hits.columns])
    return out if extra is None else out.join(extra, "feed", "left")
