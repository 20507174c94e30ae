"""Bottom-k sketches of word shingles: document fingerprints that merge.

The sketch of a text is the ``k`` smallest distinct hashes of its shingles (five words; fewer
words are one shingle; no words, none).  Sketches of parts merge into the sketch of the whole.
From two sketches come estimates of resemblance (shared part of the ``k`` smallest of the union),
containment and the number of distinct shingles.  A sketch that holds fewer than ``k`` hashes
is complete, and its estimates are exact.

``edited_fingerprints`` compares every document with an edited form of it (its last half
replaced by the start of the next document) and with the next document itself.  Documents are
dealt by ascending doc_id into ranges; each range also gets the first document of the next
one, so one pass in order sees every pair of neighbours.

Defined cases: a null text is an empty one; two empty sketches have likeness 1, an empty and
another 0; null doc_ids come first in the order, equal doc_ids are ordered by text; the one
document of a table is its own next; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hitfeed.llm.common import map_texts, parts

#: Bits of a shingle hash that a sketch keeps.
HASH_BITS = 48
SPACE = float(1 << HASH_BITS)


def sketch(text: str | None, k: int = 256, shingle: int = 5) -> np.ndarray:
    """The ``k`` smallest distinct shingle hashes, ascending."""
    words = (text or "").encode("utf-8").split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    else:
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(size + 1) - 1
        starts = (stops - size)[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(line[a:b]) for a, b in zip(starts, stops[shingle - 1:].tolist())],
                        np.uint64, len(starts))
    return smallest(h >> np.uint64(64 - HASH_BITS), k)


def smallest(h: np.ndarray, k: int) -> np.ndarray:
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = 256) -> np.ndarray:
    """The sketch of two parts together."""
    return smallest(np.concatenate([a, b]), k)


def distinct_count(s: np.ndarray, k: int = 256) -> float:
    """Distinct shingles: exact below ``k``, else (k - 1) over the k-th smallest hash's share."""
    return float(len(s)) if len(s) < k else (k - 1) * SPACE / float(s[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = 256) -> float:
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = 256) -> float:
    """Share of a's distinct shingles that b holds."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def encode(s: np.ndarray) -> str:
    """Eight characters for each hash (six bytes, big end first, base 64)."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def document_fingerprints(docs: DataFrame, k: int = 256, shingle: int = 5) -> DataFrame:
    """(doc_id, fingerprint, n_distinct) of every document."""
    def of(texts):
        s = [sketch(t, k, shingle) for t in texts]
        return [pa.array(map(encode, s), pa.string()), pa.array([distinct_count(x, k) for x in s], pa.float64())]

    return map_texts(docs, lambda: of, "fingerprint string, n_distinct double")


def with_neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, doc_id, text, extra): every document in its doc_id range, and in each range
    also the document that follows its last one (``extra``)."""
    ids = docs.select("doc_id")
    # the bounds: quantiles of the ids; one per range reaches the driver
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.approxQuantile("doc_id", cuts, 0.5 / ranges))) if cuts else []
    edges = np.array(bounds)

    @F.pandas_udf("int")
    def number(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.where(doc_id.isna(), 0, np.searchsorted(edges, doc_id.fillna(0))).astype("int32"))

    number = number("doc_id")
    rows = docs.select(number.alias("range"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = ids.select(number.alias("range"), "doc_id").groupBy("range").agg(
        F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()  # a row per range
    heads.sort(key=lambda r: r["range"])
    # the first document after each range; after the last, the very first
    after = [(heads[i - 1]["range"], None if h["nulls"] else h["head"]) for i, h in enumerate(heads)]
    table = docs.sparkSession.createDataFrame(after, "range int, head long")
    extra = rows.drop("range").join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head")))
    return rows.withColumn("extra", F.lit(False)).unionByName(
        extra.select("range", "doc_id", "text").withColumn("extra", F.lit(True)))


def edited_fingerprints(docs: DataFrame, k: int = 256, shingle: int = 5, ranges: int | None = None) -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and their likenesses."""
    spark = docs.sparkSession
    n = parts(spark)
    rows = with_neighbours(docs, ranges or 4 * n).repartition(n, "range").sortWithinPartitions(
        "range", "extra", F.col("doc_id").asc_nulls_first(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def one(doc_id, text, own, next_text, next_own):
        half = len(text) // 2
        edited = text[:len(text) - half] + next_text[:half]
        changed = sketch(edited, k, shingle)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), encode(own), encode(changed),
                resemblance(own, changed, k), resemblance(own, next_own, k))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is still to come
        for b in batches:
            out = []
            for rng, doc_id, text, extra in zip(*(c.to_pylist() for c in b.columns)):
                if held is not None and held[0] == rng:
                    own = sketch(text, k, shingle)
                    out.append(one(*held[1:], text, own))
                    held = None if extra else (rng, doc_id, text, own)
                elif not extra:
                    held = (rng, doc_id, text, sketch(text, k, shingle))
                # else: another of several documents with the id that follows the range
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names=names)

    kind = docs.schema["doc_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return rows.mapInArrow(walk, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, "
                                 "fingerprint string, edited_fingerprint string, near_edited double, near_next double")
