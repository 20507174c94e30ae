"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

Learning: from a bounded sample, principal axes and a rotation that brings the projected vectors
close to the corners of a cube (alternating signs and an orthogonal Procrustes step), so
that every bit is balanced.  Several rotations from different starts give 64 bits each.

Retrieval: each 64-bit code is cut into substrings.  Two vectors are candidates if a
substring differs in at most one bit; then one of its halves is equal, so the bucket of each half
finds them (and the other half is probed within the bucket).  Every row is indexed.  A
pair that meets in several tables is counted in the first of them only.  The halves grow with the number of
different vectors (:func:`index_shape`), so that a bucket holds about ``BUCKET_ROWS`` of them, and there are as
many rotations as keep the chance that a pair at the threshold meets.

Only ids and codes go into the tables.  A first pass over the buckets names the vectors that have a candidate at
all (by substring, and by the distance of the whole codes, which drops nearly all chance meetings); only their
vectors are fetched, for those buckets, and compared there.

Rerank: cosine of the original vectors in double precision, >= ``threshold``.  Equal vectors are one, with
their number, from the start.  Large buckets are cut into blocks of bounded size, compared pairwise in
separate tasks.  A task returns a number of links and one neighbour (a spanning forest) for each vector,
never the pairs.

Recall is that of the index: tests hold it against brute force.  Pairs below the threshold
are never linked.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths never link; rows with one vec_id are one vector
(the smallest embedding); a null vec_id links with nothing and has component null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hitfeed.llm.common import block_cells, components, materialize, merge_links, parts, runs

#: Vectors that learn the rotations.
SAMPLE = 10_000
#: Vectors in a block; a bucket above it is compared block by block.
BLOCK = 1024
#: Candidate pairs that a task reranks at once.
PAIRS = 100_000
CODE_BITS = 64
#: Different vectors that a bucket should hold, about, and the bits of half a substring, at least.
BUCKET_ROWS, LEAST_HALF = 512, 8
#: Chance that a pair at the threshold meets in no table (for independent bits).
MISS = 0.055
#: Components of the vectors that learn the rotations, at most.
SAMPLE_VALUES = 4_000_000
#: Share of code bits that a candidate may differ in: far above a pair at the threshold, below most chance pairs.
FAR = 0.3


def index_shape(vectors: int, threshold: float) -> tuple[int, int]:
    """(rotations, bits of a substring) for a number of different vectors."""
    half = LEAST_HALF
    while vectors > BUCKET_ROWS << half and 4 * half < CODE_BITS:
        half += 1
    differ = np.arccos(min(1.0, max(0.0, threshold))) / np.pi
    meets = (1 - differ) ** (2 * half) + 2 * half * differ * (1 - differ) ** (2 * half - 1)
    substrings = int(np.ceil(np.log(MISS) / np.log1p(-meets))) if meets < 1 else 1
    return max(2, -(-substrings // (CODE_BITS // (2 * half)))), 2 * half


def fit_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Projection (dimensions x bits) onto principal axes, rotated towards balanced codes."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        r = (left @ right).T
    return axes @ r


def fit_codes(sample: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, planes): 64 bits for each rotation; short vectors need several rotations for 64."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    x = unit - mean
    bits = min(CODE_BITS, x.shape[1])
    each = -(-CODE_BITS // bits)
    planes = [np.hstack([fit_rotation(x, bits, r * each + i) for i in range(each)])[:, :CODE_BITS]
              for r in range(rotations)]
    return mean, np.hstack(planes)


def sign_codes(x: np.ndarray, mean: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, rotations) 64-bit codes of unit vectors."""
    bits = (x - mean) @ planes >= 0
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


class HalfTables:
    """The index tables: every half of every substring of every code."""

    def __init__(self, rotations: int, substring_bits: int):
        self.half = substring_bits // 2
        self.low = np.uint64((1 << self.half) - 1)
        self.substrings = [(r, s) for r in range(rotations) for s in range(0, CODE_BITS - substring_bits + 1, substring_bits)]
        self.tables = [(r, s, h) for r, s in self.substrings for h in (0, 1)]
        self.probes = [0, *(1 << i for i in range(self.half))]

    def halves(self, codes: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, other half) of each code in a table."""
        r, s, h = self.tables[table]
        a = codes[:, r] >> np.uint64(s) & self.low
        b = codes[:, r] >> np.uint64(s + self.half) & self.low
        return (a, b) if h == 0 else (b, a)

    def first_meeting(self, x: np.ndarray, y: np.ndarray, table: int) -> np.ndarray:
        """Whether a pair of codes meets in no table before ``table``."""
        first = np.ones(len(x), bool)
        d = x ^ y
        for t in range(table):
            same, other = self.halves(d, t)
            first &= (same != 0) | (np.bitwise_count(other) > 1)
        return first

    def candidates(self, x: np.ndarray, y: np.ndarray, table: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of one bucket whose other halves differ in one bit at most."""
        _, a = self.halves(x, table)
        _, b = self.halves(y, table)
        order = np.argsort(b, kind="stable")
        b = b[order]
        for probe in self.probes:
            want = a ^ np.uint64(probe)
            lo = np.searchsorted(b, want, "left")
            n = np.searchsorted(b, want, "right") - lo
            ends = np.cumsum(n)
            at = 0
            while at < len(n):  # rows of ``x`` whose candidates fill a chunk
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
                rows = np.repeat(np.arange(at, to), n[at:to])
                if len(rows):
                    within = np.arange(len(rows)) - np.repeat(ends[at:to] - n[at:to] - base, n[at:to])
                    yield rows, order[np.repeat(lo[at:to], n[at:to]) + within]
                at = to


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, ok, h0, h1): one row per vec_id; ok marks vectors that can link, the hashes tell vectors apart."""
    one = embeddings.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound
          & F.exists("embedding", lambda v: v != 0))
    return one.withColumns({"ok": F.coalesce(ok, F.lit(False)), "h0": F.xxhash64("embedding"), "h1": F.xxhash64(F.lit(1), "embedding")})


def different(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, m, h0, h1): the smallest id of each different vector, and how many have it."""
    least = F.min(F.struct("vec_id", "embedding")).alias("least")
    return rows.filter("ok").groupBy("h0", "h1").agg(least, F.count("*").alias("m")).select("least.vec_id", "least.embedding", "m", "h0", "h1")


def learning_sample(sound: DataFrame, sample: int) -> np.ndarray | None:
    """At most ``sample`` vectors (and ``SAMPLE_VALUES`` components) of the commonest length, those of the lowest hashes of
    their ids; None if there are none."""
    sizes = sound.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return None
    dim = sizes[0]["dim"]
    taken = (sound.filter(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id")
             .limit(max(CODE_BITS, min(sample, SAMPLE_VALUES // dim))).select("embedding").toArrow())
    x = np.concatenate([c.flatten().to_numpy() for c in taken.column(0).chunks]).reshape(-1, dim).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def stored_type(rows: DataFrame) -> str:
    """Numpy's type for the bytes of a vector: the column's own precision."""
    return "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def vector_codes(rows: DataFrame, mean: np.ndarray, planes: np.ndarray) -> DataFrame:
    """(vec_id, m, dim, codes, vec) of each different vector: its codes and its bytes."""
    dim, stored = len(mean), np.dtype(stored_type(rows))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.zeros((len(b), dim))
            raw = []
            for i, v in enumerate(b["embedding"]):
                v = np.asarray(v, np.float64)
                raw.append(v.astype(stored).tobytes())
                v = v / np.abs(v).max()
                x[i, :min(len(v), dim)] = (v / np.linalg.norm(v))[:dim]
            yield pd.DataFrame({"vec_id": b["vec_id"], "m": b["m"], "dim": [len(r) // stored.itemsize for r in raw],
                                "codes": [c.tobytes() for c in sign_codes(x, mean, planes)], "vec": raw})

    return rows.select("vec_id", "m", "embedding").mapInPandas(encode, "vec_id long, m long, dim int, codes binary, vec binary")


def keyed_codes(coded: DataFrame, tables: HalfTables) -> DataFrame:
    """A row for each vector and table, without the vector: (t, dim, bits, vec_id, codes)."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            codes = np.frombuffer(b"".join(b["codes"]), np.uint64).reshape(len(b), -1)
            for t in range(len(tables.tables)):
                bits, _ = tables.halves(codes, t)
                yield pd.DataFrame({"t": t, "dim": b["dim"], "bits": bits.astype(np.int64), "vec_id": b["vec_id"], "codes": b["codes"]})

    return coded.select("vec_id", "dim", "codes").mapInPandas(keys, "t int, dim int, bits long, vec_id long, codes binary")


KEYS = ["t", "dim", "bits"]


CELL = [*KEYS, "lo", "hi"]


def cell_candidates(cell: pd.DataFrame, tables: HalfTables) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(order of the cell's rows, its first block in front; pairs of places in that order that this cell compares)."""
    t, lo, hi = int(cell["t"].iat[0]), cell["lo"].iat[0], cell["hi"].iat[0]
    own = cell["own"].to_numpy()
    order = np.argsort(own != lo, kind="stable")
    n_lo = int((own == lo).sum())
    codes = np.frombuffer(b"".join(cell["codes"]), np.uint64).reshape(len(cell), -1)[order]
    second = np.arange(len(cell)) if lo == hi else np.arange(n_lo, len(cell))
    far = FAR * 64 * codes.shape[1]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in tables.candidates(codes[:n_lo], codes[second], t):
            j = second[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            near = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1) <= far
            i, j = i[near], j[near]
            first = tables.first_meeting(codes[i], codes[j], t)
            yield i[first], j[first]

    return order, pairs()


def cells_with_candidates(cells: DataFrame, tables: HalfTables) -> DataFrame:
    """The rows of ``cells`` that have a candidate there."""
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in runs(batches, CELL):
            if len(cell) < 2:
                continue
            order, pairs = cell_candidates(cell, tables)
            seen = np.zeros(len(cell), bool)
            for i, j in pairs:
                seen[i] = seen[j] = True
            if seen.any():
                yield cell.iloc[np.sort(order[seen])]

    by_cell = cells.select(*CELL, "own", "vec_id", "codes").repartition(parts(cells.sparkSession), *CELL).sortWithinPartitions(*CELL)
    return by_cell.mapInPandas(mark, "t int, dim int, bits long, lo int, hi int, own int, vec_id long, codes binary")


def link_cells(cells: DataFrame, tables: HalfTables, threshold: float, stored: str) -> DataFrame:
    """(vec_id, n, peer): links counted in a cell (a vector that m rows have counts m times) and a vector of the same linked group."""
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in runs(batches, CELL):
            if len(cell) < 2:
                continue
            order, pairs = cell_candidates(cell, tables)
            ids, m = cell["vec_id"].to_numpy()[order], cell["m"].to_numpy()[order]
            x = np.frombuffer(b"".join(cell["vec"]), stored).reshape(len(cell), -1)[order].astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            parent, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            for i, j in pairs:
                near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[near], j[near]
                n += (np.bincount(i, m[j], len(n)) + np.bincount(j, m[i], len(n))).astype(np.int64)
                merge_links(parent, i, j)
            linked = np.flatnonzero(n)
            if len(linked):
                yield pd.DataFrame({"vec_id": ids[linked], "n": n[linked], "peer": ids[parent[linked]]})

    by_cell = cells.select(*CELL, "own", "vec_id", "codes", "m", "vec").repartition(
        parts(cells.sparkSession), *CELL).sortWithinPartitions(*CELL)
    return by_cell.mapInPandas(link, "vec_id long, n long, peer long")


def embedding_components(embeddings: DataFrame, threshold: float = 0.9, rotations: int | None = None,
                         substring_bits: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; rotations and bits of a substring follow the number of
    different vectors where they are not given."""
    rows = materialize(vectors(embeddings), "vectors")
    one = materialize(different(rows), "different-vectors")
    learn = learning_sample(one, sample)
    members = rows.filter("ok").select("vec_id", "h0", "h1").join(
        one.select(F.col("vec_id").alias("same"), "m", "h0", "h1"), ["h0", "h1"]).select("vec_id", "same", "m")
    if learn is not None:
        shape = index_shape(one.count(), threshold)
        rotations, substring_bits = rotations or shape[0], substring_bits or shape[1]
        tables = HalfTables(rotations, substring_bits)
        coded = materialize(vector_codes(one, *fit_codes(learn, rotations)), "vector-codes")
        keyed = keyed_codes(coded, tables)
        large = (keyed.groupBy(*KEYS).count().filter(F.col("count") > block)
                 .select(*KEYS, F.ceil(F.col("count") / block).cast("int").alias("n_blocks")))
        met = materialize(cells_with_candidates(block_cells(keyed, KEYS, large, F.xxhash64("vec_id"), block), tables), "candidates")
        found = materialize(link_cells(met.join(coded.select("vec_id", "m", "vec"), "vec_id"), tables, threshold, stored_type(one)), "links")
        counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
        reach = components(found, "vec_id", "peer")
        linked = counts.join(reach.withColumnRenamed("node", "vec_id"), "vec_id", "full").withColumnRenamed("vec_id", "same")
        members = members.join(linked, "same", "left")
    else:
        members = members.withColumns({"n": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    links = members.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "same").alias("component"))
    out = rows.select("vec_id").join(links, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
