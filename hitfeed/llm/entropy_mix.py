"""Mixing sources to target weights by entropy balancing.

Among all rates of the documents that make each source's words come to its target, the one closest to
the corpus itself (least relative entropy, words as base measure) is an exponential tilt: a
document's rate is exp(lambda of its source).  The multipliers minimise the convex dual

    sum over documents of size * exp(lambda_source) - sum over sources of target * lambda_source

by damped Newton steps.  The constraints of different sources share no document, so the Hessian is
diagonal and its entries need the documents only through the words of each source: they are
summed once over the corpus (combined before the shuffle), and each source takes its own steps on the
executors.

Rates become whole copies: the integer part for every document, and one more for documents in the
order of a hash of their id, their size and a number until the source's remaining words are taken.  The place where
that ends is found level by level: from 4,096 bins of the first digits of the hash, of the next ones, from the ids
and sizes there, and from 4,096 bins of a hash of the number.  Only documents that agree with the end on all levels
are ordered, so neither a large source nor an id that many documents share is gathered in one task; a
source's words miss its target by less than one document, and reruns agree.

Targets: sources by code point (null last) weigh ``weights`` in turn; a target stops at ``cap`` times
its source's words and the excess goes to the others by weight.

Defined cases: a null text has size 0; documents without words take nothing, and a source without
words has target 0; repeated rows are mixed row by row; ties in the order are between rows of one id and size; a
null doc_id counts as an empty text in the hash; long texts count whole; extra columns are ignored by the query and
kept by :func:`mixed_documents`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitfeed.llm.common import id_text, materialize

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 60


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_order() -> Column:
    return F.md5(id_text(F.col("doc_id")))


def level_keys() -> list[Column]:
    """What the order goes by, level by level, as text: few values within one value of the levels before."""
    return [F.substring(hash_order(), 1, 3), F.substring(hash_order(), 4, 3),
            F.concat_ws(":", hash_order(), F.lpad(F.col("size").cast("string"), 19, "0")),
            F.substring(F.md5(F.col("number").cast("string")), 1, 3)]


LEVELS = ["level_1", "level_2", "level_3", "level_4"]


def capped_targets(totals: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row per source."""
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.array(*map(F.lit, weights))[turn])
    # fill in order of the level at which a source is full; the level of the first one that is not full is
    # the common one
    by_level = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    level = ((F.sum("source_size").over(everything)
              - cap * F.coalesce(F.sum("source_size").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    full = F.col("level") * F.col("weight") > cap * F.col("source_size")
    return (weighed.withColumn("level", level).withColumn("common", F.max(F.when(~full, F.col("level"))).over(everything))
            .select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"),
                                                     F.col("common") * F.col("weight")).alias("target")))


def newton_rate(size: Column, target: Column) -> Column:
    """exp of the minimiser of size * exp(x) - target * x, by damped Newton steps from 0."""
    taken = lambda x: size.cast("double") * F.exp(x)
    step = lambda x, _: x + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), target / taken(x) - 1))
    dual = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    return F.when((size > 0) & (target > 0), F.exp(dual)).otherwise(F.lit(0.0))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """A row per source: target, rate, whole copies, and where the extra copies end (``end``, a key for each level, and the
    words ``before`` it).

    ``sizes`` has doc_id, source, size and number of every document and must be stored.
    """
    keyed = sizes.select("source", "size", *[k.alias(n) for k, n in zip(level_keys(), LEVELS)])
    bins = materialize(keyed.groupBy("source", "level_1").agg(F.sum("size").alias("size")), "mix-bins")
    totals = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = capped_targets(totals, weights, cap).withColumn("rate", newton_rate(F.col("source_size"), F.col("target")))
    plan = plan.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan.withColumns({"end": F.array().cast("array<string>"), "before": F.lit(0).cast("long")}), "mix-targets")
    for i, level in enumerate(LEVELS):
        if i:
            at = F.slice(F.array(*LEVELS[:i]), 1, i)
            p = plan.select(F.col("source").alias("s"), "end")
            near = keyed.join(p, F.col("source").eqNullSafe(F.col("s"))).filter(at == F.col("end"))
            bins = near.groupBy("source", level).agg(F.sum("size").alias("size"))
        plan = materialize(with_end(plan, bins, level), "mix-plan")
    return plan


def with_end(plan: DataFrame, bins: DataFrame, level: str) -> DataFrame:
    """Extend ``end`` by the first bin of a level at whose end the extra words are all taken, and ``before`` by the bins
    that precede it; a source whose documents are all taken gets the end '~', behind every key."""
    order = W.partitionBy("s").orderBy(level)
    b = bins.select(F.col("source").alias("s"), level, "size").withColumn("upto", F.sum("size").over(order))
    met = plan.join(b, F.col("source").eqNullSafe(F.col("s")), "left")
    here = F.when(F.col("before") + F.col("upto") >= F.col("rest"), F.col(level))
    found = met.groupBy("source").agg(
        F.min(here).alias("key"), F.min_by(F.col("upto") - F.col("size"), here).alias("passed")).withColumnRenamed("source", "s")
    out = plan.join(found, F.col("source").eqNullSafe(F.col("s")))
    return out.select(*[c for c in plan.columns if c not in ("end", "before")],
                      F.concat("end", F.array(F.coalesce("key", F.lit("~")))).alias("end"),
                      (F.col("before") + F.coalesce("passed", F.lit(0))).alias("before"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan's columns and ``copies`` to rows with doc_id, source, size and number.

    Only the documents at a source's end, on every level, are ordered; all others are decided by their keys.
    """
    p = plan.withColumnRenamed("source", "plan_source")
    at = rows.withColumn("key", F.array(*level_keys())).join(p, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    clear = at.filter("key <> end").withColumn("extra", (F.col("key") < F.col("end")).cast("long"))
    order = W.partitionBy("source").orderBy("key", "doc_id", "number")
    past = F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = at.filter("key = end").withColumn("extra", (past + F.col("size") / 2 <= F.col("rest")).cast("long"))
    return clear.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra")).drop("key", "extra")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and a number of every document (the same in every reading of a stored table)."""
    return docs.select(*more, "doc_id", "source", n_words().alias("size"), F.monotonically_increasing_id().alias("number"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, rate, copies) of every document."""
    sizes = materialize(sized(docs), "mix-sizes")
    rows = with_copies(sizes, mixing_plan(sizes, weights, cap))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                       "rate", "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The documents, each as often as the mix takes it (documents not taken go)."""
    plan = mixing_plan(materialize(sized(docs), "mix-sizes"), weights, cap)
    rows = with_copies(sized(docs, F.struct(*docs.columns).alias("row")), plan).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
          ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
p AS (SELECT source, source_size,
             least(CAST(3 * source_size AS DOUBLE), weight * max(CASE WHEN level * weight <= 3 * source_size THEN level END) OVER ()) AS target
      FROM l),
w AS (SELECT *, CASE WHEN source_size > 0 AND target > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM p),
r AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
c AS (SELECT *, whole + CASE WHEN size > 0 AND past + size / 2 <= rest THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, CAST(copies AS BIGINT) AS copies FROM c
"""
