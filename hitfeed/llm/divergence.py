"""Source divergence audit: how far the word use of the sources of a language lies apart.

Terms are runs of letters (A-Z in lower case, everything beyond ASCII as it is).  Each language keeps
the terms that at least ``min_docs`` of its documents hold.  A group (language, source) gives every
kept term a smoothed share of a billion, p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares cost
floor((p - q)^2 / (p + q)), all in exact integers.

Counting: a task adds up the terms of its documents by group and hands on sums, which Spark adds up.
Kept terms get a number (any, unique) and a block (a hash of the term, so that a block holds about
``block`` of them); a group's counts in a block are arrays sorted by number.

Pairs: every unordered pair of sources of a language is a row of work for each block, where the two groups' arrays
meet (a co-group: a full join on pair and block).  It finds the shared numbers by galloping (exponential) search of the shorter array in
the longer one, and prices shared and one-sided terms; terms that both lack are counted
(V less the union) and priced once, as they all cost the same.  Both directions of a pair have
the same value.  A task holds one block of two groups at a time, however large the
sources are.

Terms: the ``top`` terms of a group that exceed the language's share, by the same price.

Defined cases: null text, lang and source are read as ''; repeated rows count one by one; ties are
ordered by item (UTF-8); groups without kept terms take part with counts of 0, a language without kept
terms prices its pairs at 0; texts are read whole (long ones in slices between terms); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitfeed.llm.common import materialize

SCALE = 1_000_000_000
#: Kept terms in a block of a group's arrays, about.
BLOCK = 16_384
#: Entries that a counting task holds before it hands them on.
HELD = 400_000
#: Bytes of a text that are cut into terms at once.
SLICE = 4_000_000

#: What stands in a text for each byte: letters and bytes beyond ASCII stay, A-Z in lower case, the rest ends a term.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def term_slices(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded slice of it at a time."""
    data = (text or "").encode("utf-8").translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                if n:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                        pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()),
                        pa.array([in_docs[t] for t in n], pa.int64())], names=names)
            held.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in term_slices(text):
                    n.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    partial = docs.select(*group(), "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def share(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / whole): long division by three digits at a time, exact while ``whole`` < 9 * 10^15."""
    out, rest = np.divmod(np.asarray(count, np.int64) + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def price(p, q):
    return (p - q) ** 2 // (p + q)


def gallop(needles: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """The first position in ``sorted_`` that is not below each needle (both ascending).

    All needles at once: from a place in proportion, steps that double until they enclose the needle, then halving.
    """
    m, n = len(needles), len(sorted_)
    if not m or not n:
        return np.zeros(m, np.int64)
    at = np.arange(m) * n // m
    lo, hi = at.copy(), at.copy()  # sorted_[lo - 1] < needle <= sorted_[hi], past the ends too
    step, todo = 1, np.arange(m)
    while len(todo := todo[(lo[todo] > 0) & (sorted_[np.maximum(lo[todo] - 1, 0)] >= needles[todo])]):
        hi[todo] = lo[todo] - 1
        lo[todo] = np.maximum(lo[todo] - step, 0)
        step *= 2
    step, todo = 1, np.arange(m)
    while len(todo := todo[(hi[todo] < n) & (sorted_[np.minimum(hi[todo], n - 1)] < needles[todo])]):
        lo[todo] = np.maximum(lo[todo], hi[todo] + 1)
        hi[todo] = np.minimum(hi[todo] + step, n)
        step *= 2
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        below = open_ & (sorted_[np.minimum(mid, n - 1)] < needles)
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def merge_price(ids_a, n_a, whole_a: int, ids_b, n_b, whole_b: int) -> tuple[int, int]:
    """(price of the terms that one or both hold, number of those terms) of two sorted arrays."""
    if len(ids_a) > len(ids_b):
        ids_a, n_a, whole_a, ids_b, n_b, whole_b = ids_b, n_b, whole_b, ids_a, n_a, whole_a
    at = gallop(ids_a, ids_b)
    shared = at < len(ids_b)
    shared[shared] = ids_b[at[shared]] == ids_a[shared]
    p, q = share(n_a, whole_a), share(n_b, whole_b)
    none_a, none_b = share(0, whole_a), share(0, whole_b)
    only_b = np.ones(len(ids_b), bool)
    only_b[at[shared]] = False
    total = (price(p[shared], q[at[shared]]).sum() + price(p[~shared], none_b).sum() + price(q[only_b], none_a).sum())
    return int(total), int(len(ids_a) + only_b.sum())


def priced_blocks(arrays: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, value, held) of each block of each pair; ``pairs`` has lang, a, b, whole_a, whole_b."""
    def price_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(), c.is_valid().to_pylist()) for c in batch.columns[:4]]
            whole = [c.to_pylist() for c in batch.columns[4:6]]
            priced = []
            for i in range(batch.num_rows):
                ids_a, n_a, ids_b, n_b = (v[at[i]:at[i + 1]] if there[i] else none for at, v, there in lists)
                priced.append(merge_price(ids_a, n_a, whole[0][i], ids_b, n_b, whole[1][i]))
            value, held = zip(*priced) if priced else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[6:], pa.array(value, pa.int64()), pa.array(held, pa.int64())],
                                             names=["lang", "a", "b", "value", "held"])

    keys = ["lang", "a", "b", "block"]

    def side(at: str) -> DataFrame:
        own = arrays.select("lang", F.col("source").alias(at), "block", "ids", "counts").join(pairs, ["lang", at])
        own = own.select(*keys, "whole_a", "whole_b", "ids", "counts")
        return own.toDF(*(f"{at}_{c}" for c in own.columns))  # the two sides come from the same tables

    left, right = side("a"), side("b")
    met = left.join(right, [left[f"a_{k}"] == right[f"b_{k}"] for k in keys], "full")
    either = lambda c: F.coalesce(f"a_{c}", f"b_{c}").alias(c)
    return met.select("a_ids", "a_counts", "b_ids", "b_counts", *map(either, ["whole_a", "whole_b", "lang", "a", "b"])).mapInArrow(
        price_pairs, "lang string, a string, b string, value long, held long")


def exact_share(count: Column, whole: Column) -> Column:
    """:func:`share` as a column."""
    part = F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))
    return (part + 1).cast("long")


def exact_price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source, ``term`` rows for the top terms."""
    counts = materialize(term_counts(docs), "audit-counts")
    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= min_docs).select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("id")))
    kept = materialize(kept, "audit-terms")  # its numbers are read more than once
    blocks = max(1, -(-kept.count() // block))
    entry = F.struct("id", "n", "lang_n", "term")
    arrays = (counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
              .groupBy("lang", "source", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
              .agg(F.array_sort(F.collect_list(entry)).alias("e"))
              .select("lang", "source", "block", F.col("e.id").alias("ids"), F.col("e.n").alias("counts"),
                      F.col("e.lang_n").alias("lang_counts"), F.col("e.term").alias("terms")))
    arrays = materialize(arrays, "audit-arrays")
    # a row per group: N + 2 V of the group and of its language, and V
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = arrays.select("lang", "source", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    totals = (docs.select(*group()).distinct().join(whole, "lang", "left")
              .join(own.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
                      (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("whole"),
                      (F.coalesce("lang_total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_whole")))
    totals = materialize(totals, "audit-groups")
    return _pairs(arrays, totals).unionByName(_terms(arrays, totals, top))


def _pairs(arrays: DataFrame, totals: DataFrame) -> DataFrame:
    side = lambda at: totals.select("lang", F.col("source").alias(at), F.col("whole").alias(f"whole_{at}"))
    pairs = side("a").join(side("b"), "lang").filter("a < b")  # the rows of the result, one per pair
    found = priced_blocks(arrays, pairs).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))
    none = lambda at: exact_share(F.lit(0).cast("long"), F.col(f"whole_{at}"))
    absent = F.col("v") - F.coalesce("held", F.lit(0))
    value = F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + absent * exact_price(none("a"), none("b"))).otherwise(F.lit(0))
    priced = (pairs.join(found, ["lang", "a", "b"], "left").join(totals.select("lang", F.col("source").alias("a"), "v"), ["lang", "a"])
              .select("lang", "a", "b", value.cast("long").alias("value")))
    # both directions of a pair, from one evaluation
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = priced.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")
    return _ranked(both, "pair")


def _terms(arrays: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    at = F.explode(F.arrays_zip("counts", "lang_counts", "terms"))
    rows = arrays.join(totals, ["lang", "source"]).select("lang", "source", "whole", "lang_whole", at.alias("t"))
    p, q = exact_share(F.col("t.counts"), F.col("whole")), exact_share(F.col("t.lang_counts"), F.col("lang_whole"))
    rows = rows.select("lang", "source", F.col("t.terms").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    return _ranked(rows.select("lang", "source", "item", exact_price(F.col("p"), F.col("q")).alias("value")), "term").filter(
        F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
                  row_number() OVER () AS doc FROM documents),
w AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(l.v, 0) AS v, coalesce(t.total, 0) + 2 * coalesce(l.v, 0) AS whole,
             coalesce(l.total, 0) + 2 * coalesce(l.v, 0) AS lang_whole
      FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l ON s.lang = l.lang
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t ON s.lang = t.lang AND s.source = t.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // g.whole AS HUGEINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // g.lang_whole AS HUGEINT) AS q
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
             CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""
