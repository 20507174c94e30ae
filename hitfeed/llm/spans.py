"""Spans of regular-expression matches as columns, in code points, without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Matches whose lengths are summed together; keeps the cost of positions near linear.
CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def running_sums(steps: Column) -> Column:
    """Sums up to each element: sums of chunks, then within a chunk."""
    zero = F.lit(0).cast("long")
    plus = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, zero, plus)
    part = lambda xs, first, n: F.slice(xs, first, n)
    chunks = lambda xs: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: total(part(xs, c * CHUNK + 1, F.lit(CHUNK))))
    before = lambda sums: F.transform(sums, lambda x, i: total(part(sums, F.lit(1), i)))
    return let(steps, lambda xs: let(let(chunks(xs), before), lambda offsets: F.transform(
        xs, lambda x, i: offsets[F.floor(i / CHUNK).cast("int")]
        + total(part(xs, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK + 1)))))


def spans(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column, Column], Column] | None = None,
          group: int | None = None, hint: Column | None = None) -> Column:
    """Array of (start, rank, kind, end, match, part) of the leftmost non-overlapping matches.

    Positions come from the lengths of the gaps between matches.  ``keep(match, part)`` drops
    failing matches, ``part`` being capture ``group``.  ``hint`` is a cheap condition without
    which there is no match.
    """
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)

    def build(gaps: Column, found: Column, parts: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(gaps[i]) + F.when(i > 0, F.length(found[i - 1])).otherwise(0)).cast("long"))
        return let(running_sums(steps), lambda starts: F.transform(found, lambda m, i: F.struct(
            starts[i].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (starts[i] + F.length(m)).alias("end"), m.alias("match"), parts[i].alias("part"))))

    every = let(gaps, lambda g: let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: (
        build(g, found, found) if group is None
        else let(F.regexp_extract_all(text, p, F.lit(group)), lambda parts: build(g, found, parts)))))
    if keep:
        every = F.filter(every, lambda s: F.coalesce(keep(s["match"], s["part"]), F.lit(False)))
    seen = F.rlike(text, p) if hint is None else hint & F.rlike(text, p)
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,match:string,part:string>>")
    return F.when(seen, every).otherwise(none)


def span_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
