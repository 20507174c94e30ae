"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents become token identifiers plus one closing identifier, cut into pieces of at most
``capacity``.  Only the histogram of piece lengths (at most ``capacity`` rows, whatever the
corpus) reaches the driver.  There lengths are placed longest first, each into the pack
with the most room left (the shortest pack), which splits and updates counts of packing
patterns.  The patterns are then joined back: the r-th piece of a length (ranked over all
pieces) goes to the r-th place that the patterns hold for that length.

Defined cases: a null text is an empty one, and an empty document is its closing
identifier alone; repeated rows are packed row by row, and equal or null ids make no large bucket; long texts
become many pieces; extra columns are ignored; an empty table gives no rows.  Special strings inside texts become their identifier, as the
tokenizer's library does by default.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F

from hitfeed.llm.common import materialize
from hitfeed.llm.token_count import WordCache, byte_symbols

#: Column that tells equal pieces apart.
NUMBER = "number"
#: Rows of one rank bucket: the most that one window partition orders.
RANK_BLOCK = 10_000

# fixed value: the split pattern of this vocabulary family
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Identifiers of a byte-level vocabulary file, with a cache per word.

    No match of the split pattern runs from a non-space into the white space after it, and
    the last of several white-space characters goes with the word that follows.  So a text
    can be cut before each space and its parts be encoded on their own, unless a space
    stands within a longer run of white space; such texts are encoded whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level BPE")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.within = re.compile(r"\s (?:\s|\Z)")
        self.cache = WordCache(lambda w: array("I", self.encoding.encode_ordinary(" " + w)).tobytes())

    def ids(self, text: str | None) -> bytes:
        """The identifiers as unsigned little-endian 32-bit numbers."""
        if not text:
            return b""
        if any(s in text for s in self.special) or self.within.search(text):
            return array("I", self.encoding.encode(text, allowed_special="all")).tobytes()
        head, *rest = text.split(" ")
        return array("I", self.encoding.encode_ordinary(head)).tobytes() + b"".join(map(self.cache.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, closing: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole capacities, then the rest."""
    end = np.array([closing], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            rows = []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                rows += [(row, s, min(capacity, n - s), zlib.crc32(ids[4 * s:4 * (s + capacity)]), n)
                         for s in range(0, n, capacity)]
            row, *rest = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with a number of their own, fixed once they are stored."""
    return pieces.withColumn(NUMBER, F.monotonically_increasing_id())


def pack_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a pack, packs of that kind), longest lengths first, into the shortest pack."""
    room: dict[int, list[tuple[list[int], int]]] = {}  # open packs by the room left
    done: list[tuple[list[int], int]] = []

    def keep(pack: list[int], count: int, left: int) -> None:
        if left:
            room.setdefault(left, []).append((pack, count))
        else:
            done.append((pack, count))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        for left in sorted((r for r in room if r >= length), reverse=True):
            while todo and room[left]:
                pack, count = room[left].pop()
                put = min(count, todo)
                if count > put:
                    room[left].append((pack, count - put))
                keep([*pack, length], put, left - length)
                todo -= put
            if not room[left]:
                del room[left]
            if not todo:
                break
        if todo:
            keep([length], todo, capacity - length)
    return done + [x for left in sorted(room) for x in room[left]]


def pattern_places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of every place."""
    places, taken, sequence = [], {}, 0
    for pack, count in patterns:
        offset = 0
        for length in pack:
            first = taken.get(length, 0)
            places.append((length, first, first + count, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    return places


def pack(pieces: DataFrame, capacity: int, rank_block: int = RANK_BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length`` <= ``capacity``).

    ``pieces`` must be :func:`numbered` and stored (it is read more than once).  The rank of a piece within its
    length comes from hash buckets of about ``rank_block`` rows: a row number within
    (bucket, length) plus the pieces of that length in earlier buckets, so a length that
    most pieces share is ordered in many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    places = pattern_places(pack_patterns(histogram, capacity))
    buckets = max(1, -(-sum(histogram.values()) // rank_block))
    # pieces that are equal in all columns (repeated rows, empty texts without id) are told apart by their own number
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", NUMBER), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    earlier = rows.groupBy("bucket", "length").count().select(
        "bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    within = W.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", NUMBER)
    ranked = (rows.withColumn("within", F.row_number().over(within) - 1).join(earlier, ["bucket", "length"])
              .withColumn("rank", F.col("earlier") + F.col("within")))
    # one row for each place of a pattern: bounded by the capacity, not by the corpus
    table = spark.createDataFrame(places, "length long, first long, end long, sequence long, offset long")
    return (ranked.join(F.broadcast(table), "length")
            .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
            .withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
            .select(*[c for c in pieces.columns if c != NUMBER], "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """One row for each piece of every document, with its sequence and its offset there."""
    return pack(materialize(numbered(cut_pieces(docs, tokenizer_path, capacity)), "pieces"), capacity)
