"""Exact top-k search by inner product over a bit-sliced index.

Components become integers, floor(``scale`` x).  The index stores blocks of vectors as bit slices: slice
b of dimension d is a bitmap over the block's rows that holds bit b of (component - least component of
the block).  The rows of a block stand in the order of vec_id.

A query adds up the slices: a set bit j of its component d adds slice b with weight 2^(b + j).
The bitmaps of one weight are reduced by carry-save adders (three bitmaps to a sum and a carry of twice
the weight), so that the scores of all rows of a block come out as slices again, 64 rows to a machine
word.  A negative component adds the complements; what that adds to every row is the same and is taken
off at the end.  The best rows are selected from the most significant slice downward: rows
that have the bit come first while fewer than ``k`` do.  After the last slice the open rows have one and
the same score, the boundary, and go in order of vec_id.  Scores are read back from the slices.

The index is cut into blocks and the queries into chunks; every block meets every chunk in a task of its own,
which returns ``k`` rows for each query.  Nothing else is compared, sampled or left out, so the result is exact.

Defined cases: vectors that are null or hold null or non-finite components take no part; a query searches the
vectors of its own length; rows that share a vec_id are rows of their own, and each is a query; a null
vec_id is no query and comes after all others in a tie; equal rows are interchangeable; scores that do not fit
a long are an error (``ValueError`` in the task); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from hitfeed.llm.common import materialize, parts, runs

#: Components in a block of the index, and in a chunk of queries, about.
BLOCK_VALUES, CHUNK_VALUES = 1 << 21, 1 << 17
WORD = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(row, vec_id, x): every sound vector as integers; ``row`` tells rows apart."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    return embeddings.filter(sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("x"))


def bitmap(bits: np.ndarray) -> np.ndarray:
    """(n, rows) booleans as (n, words) of 64 rows each, the first row in the lowest bit."""
    n, rows = bits.shape
    out = np.zeros((n, -(-rows // WORD) * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, :packed.shape[1]] = packed
    return out.view("<u8").astype(np.uint64, copy=False)


def members(bitmap_: np.ndarray) -> np.ndarray:
    """Positions of the set bits, ascending."""
    return np.flatnonzero(np.unpackbits(bitmap_.astype("<u8").view(np.uint8), bitorder="little"))


class SlicedBlock:
    """The bit slices of a block: ``planes`` by (bit, dimension), low bits first."""

    def __init__(self, rows: int, low: np.ndarray, widths: np.ndarray, planes: np.ndarray):
        self.rows, self.low, self.widths, self.planes = rows, low, widths, planes
        self.dims = [np.flatnonzero(widths > b) for b in range(int(widths.max(initial=0)))]  # of the slices of each bit
        self.first = np.cumsum([0, *map(len, self.dims)])
        self.words = -(-rows // WORD)
        self.all = bitmap(np.ones((1, rows), bool))[0]

    @classmethod
    def build(cls, x: np.ndarray) -> SlicedBlock:
        """From (rows, dimensions) integers."""
        low = x.min(axis=0) if x.shape[1] else np.empty(0, np.int64)
        # as unsigned: the difference of two longs always fits
        above = (x - low).astype(np.uint64)
        top = above.max(axis=0) if x.shape[1] else np.empty(0, np.uint64)
        widths = np.array([int(t).bit_length() for t in top], np.int64)
        planes = [bitmap((above[:, np.flatnonzero(widths > b)].T >> np.uint64(b) & np.uint64(1)).astype(bool))
                  for b in range(int(widths.max(initial=0)))]
        words = -(-len(x) // WORD)
        return cls(len(x), low, widths, np.concatenate([np.empty((0, words), np.uint64), *planes]))

    def check(self, queries: np.ndarray) -> None:
        """All scores of these queries must fit a long."""
        if not self.rows or not len(queries):
            return
        most = [max(abs(int(a)), abs(int(a) + (1 << int(w)))) for a, w in zip(self.low, self.widths)]
        if sum(m * max(abs(int(a)), abs(int(b))) for m, a, b in zip(most, queries.min(axis=0), queries.max(axis=0))) >= 1 << 62:
            raise ValueError("inner products of these vectors do not fit a long")

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the scores of all rows, low bits first, and what is to be added to each)."""
        size, minus = np.abs(q), q < 0
        by_weight: dict[int, list[np.ndarray]] = {}
        for b, dims in enumerate(self.dims):
            own, flip = size[dims], np.where(minus[dims], FULL, np.uint64(0))
            for j in range(int(own.max(initial=0)).bit_length()):
                at = np.flatnonzero(own >> j & 1)
                if len(at):
                    by_weight.setdefault(b + j, []).append(self.planes[self.first[b] + at] ^ flip[at, None])
        complement = sum(int(s) * ((1 << int(w)) - 1) for s, w in zip(size[minus], self.widths[minus]))
        return add_slices(by_weight, self.words), sum(int(a) * int(l) for a, l in zip(q, self.low)) - complement

    def top(self, q: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the ``k`` best rows, row ``without`` left out; ties by position."""
        slices, base = self.scores(q)
        ahead, open_ = np.zeros(self.words, np.uint64), self.all.copy()
        if without is not None:
            open_[without // WORD] &= ~np.uint64(1 << without % WORD)
        n_ahead = 0
        for s in reversed(slices):
            having = open_ & s
            n = n_ahead + int(np.bitwise_count(having).sum())
            if n <= k:  # all that have the bit are in; go on among the others
                ahead, n_ahead, open_ = ahead | having, n, open_ & ~s
                if n == k:
                    break
            else:
                open_ = having
        chosen = members(ahead)
        if len(chosen) < k:  # the boundary: equal scores, so the first in order
            chosen = np.concatenate([chosen, members(open_)[:k - len(chosen)]])
        score = np.full(len(chosen), base, np.int64)
        for w, s in enumerate(slices):
            score += (s[chosen // WORD] >> (chosen % WORD).astype(np.uint64) & np.uint64(1)).astype(np.int64) << w
        order = np.lexsort((chosen, -score))
        return chosen[order], score[order]


def add_slices(by_weight: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The sum of bitmaps with weights 2^w as slices, low bits first: carry-save adders, weight by weight."""
    out: list[np.ndarray] = []
    w, last = 0, max(by_weight, default=-1)
    carried: list[np.ndarray] = []
    while w <= last or carried:
        stack = [*by_weight.get(w, []), *carried]
        x = np.concatenate(stack) if stack else np.zeros((1, words), np.uint64)
        carried = []
        while len(x) > 1:
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            else:
                m = len(x) // 3
                a, b, c = x[:m], x[m:2 * m], x[2 * m:3 * m]
                half = a ^ b
                carried.append(a & b | half & c)
                x = np.concatenate([half ^ c, x[3 * m:]])
        out.append(x[0])
        w += 1
    return out


INDEX = "dim int, block int, n int, rows binary, ids binary, nulls binary, low binary, widths binary, planes binary"


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """A row per block: its rows in the order of vec_id, and their slices."""
    keys = ["dim", "block"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in runs(batches, keys):
            null = b["vec_id"].isna().to_numpy()
            ids = b["vec_id"].fillna(0).to_numpy(np.int64)
            rows = b["row"].to_numpy(np.int64)
            order = np.lexsort((rows, ids, null))
            x = np.array(b["x"].tolist(), np.int64).reshape(len(b), -1)[order]
            s = SlicedBlock.build(x)
            yield pd.DataFrame({
                "dim": b["dim"].iloc[:1].to_numpy(), "block": b["block"].iloc[:1].to_numpy(), "n": [len(b)],
                "rows": [rows[order].tobytes()], "ids": [ids[order].tobytes()], "nulls": [null[order].tobytes()],
                "low": [s.low.tobytes()], "widths": [s.widths.tobytes()], "planes": [s.planes.tobytes()]})

    cut = vectors.select(F.size("x").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"),
                         "row", "vec_id", "x")
    return cut.repartition(max(blocks, parts(vectors.sparkSession)), *keys).sortWithinPartitions(*keys).mapInPandas(build, INDEX)


def search(index: DataFrame, queries: DataFrame, blocks: int, chunks: int, k: int) -> DataFrame:
    """(q_row, query_id, vec_id, row, score): the ``k`` best of each block for each query."""
    keys = ["dim", "block", "chunk"]

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {c: [] for c in ("q_row", "query_id", "vec_id", "row", "score")}
        if len(left) and len(right):
            r = left.iloc[0]
            dim, words = int(r["dim"]), -(-int(r["n"]) // WORD)
            block = SlicedBlock(int(r["n"]), np.frombuffer(r["low"], np.int64), np.frombuffer(r["widths"], np.int64),
                                np.frombuffer(r["planes"], np.uint64).reshape(-1, words))
            rows, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
            null = np.frombuffer(r["nulls"], bool)
            place = dict(zip(rows.tolist(), range(len(rows))))
            q = np.array(right["x"].tolist(), np.int64).reshape(len(right), dim)
            block.check(q)
            for x, q_row, q_id in zip(q, right["row"].tolist(), right["vec_id"].tolist()):
                at, score = block.top(x, k, place.get(q_row))
                found["q_row"] += [q_row] * len(at)
                found["query_id"] += [q_id] * len(at)
                found["vec_id"] += [None if n else i for n, i in zip(null[at].tolist(), ids[at].tolist())]
                found["row"] += rows[at].tolist()
                found["score"] += score.tolist()
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in found.items()})

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = index.select("*", every(chunks, "chunk")).groupBy(*keys)
    right = queries.select(F.size("x").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"),
                           "row", "vec_id", "x", every(blocks, "block")).groupBy(*keys)
    return left.cogroup(right).applyInPandas(cell, "q_row long, query_id long, vec_id long, row long, score long")


def top_inner_products(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64,
                       block_values: int = BLOCK_VALUES, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row whose vec_id ``every`` divides."""
    vectors = materialize(quantised(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale), "sliced-vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    size = F.size("x") + 1
    n = vectors.agg(F.sum(size).alias("all"), F.sum(F.when(is_query, size)).alias("queries")).first()
    blocks = max(1, -(-(n["all"] or 0) // block_values))
    # chunks of bounded size, and enough cells for the session's tasks
    chunks = max(1, -(-(n["queries"] or 0) // chunk_values), -(-parts(vectors.sparkSession) // blocks))
    index = materialize(build_index(vectors, blocks), "sliced-index")
    found = search(index, vectors.filter(is_query), blocks, chunks, k)
    order = W.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r,
             CAST(CASE WHEN len(q.x) = 0 THEN 0 ELSE list_dot_product(q.x, c.x) END AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 20
"""
