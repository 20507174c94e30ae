"""SimHash near-duplicates: 64-bit fingerprints compared bit-sliced.

Fingerprint: lower-cased (A-Z) words, shingles of ``shingle`` words, XXH64 (seed 42) of each;
a bit is 1 if it is set in more than half of the hashes.  Equal fingerprints are one row from
there on, however many documents share them.

Candidates are complete: of ``radius`` + ``spare`` blocks of the 64 bits, two fingerprints within
``radius`` bits agree on at least ``spare`` blocks, so they meet in the bucket of such a combination of
blocks.  Within a bucket the fingerprints are stored as 64 vertical bit planes (64 fingerprints to
a machine word).  The distances of one fingerprint to a whole word are counted at once with
carry-save counters; a row of words is abandoned as soon as every lane has passed the radius.
Large buckets are cut into blocks of bounded size that are compared pairwise in separate tasks.
Each comparison returns a spanning forest of its links, never the pairs.

Defined cases: null and wordless texts have fingerprint 0 and link like any other; fewer words
than a shingle are one shingle; repeated rows and ties each get their row with the same
component; a null doc_id never names a component unless no other id is in it; very long texts are hashed whole;
extra columns are ignored by the query and kept by :func:`drop_near_duplicates`, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hitfeed.llm.common import block_cells, components, free_name, map_texts, materialize, merge_links, parts, runs

#: Fingerprints in a block; a bucket above it is compared block by block.
BLOCK = 2048
#: Fingerprints that a bucket should hold on average, at most.
BUCKET_ROWS = 512


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one text as a signed 64-bit number."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).astype(np.int64))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(size + 1) - 1
    starts, stops = (stops - size)[:len(words) - shingle + 1].tolist(), stops[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64, len(starts))
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        set_ += np.unpackbits(h[i:i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(h)).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long."""
    return map_texts(docs, lambda: lambda texts: [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())],
                     "fp long")


def block_masks(radius: int, spare: int) -> list[int]:
    """Bit masks of every choice of ``spare`` out of ``radius + spare`` blocks of the 64 bits."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges[:-1], edges[1:])]
    return [sum(block[i] for i in c) for c in combinations(range(n), spare)]


def spare_blocks(n: int, radius: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Blocks that must agree so that ``n`` spread fingerprints make buckets of ``bucket_rows`` at most."""
    spare = 1
    while n > bucket_rows << (64 * spare // (radius + spare)) and comb(radius + spare + 1, spare + 1) <= 128:
        spare += 1
    return spare


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit p of 64 fingerprints in each word of plane p."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # rows x 64
    return np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(">u8").astype(np.uint64)


def within_radius(queries: np.ndarray, fps: np.ndarray, radius: int, step: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, fingerprint) of at most ``radius`` differing bits, chunk by chunk."""
    planes = bit_planes(fps)
    width = planes.shape[1]
    levels = radius.bit_length()  # a counter of this many bits holds 0 .. 2**levels - 1 >= radius
    start = (1 << levels) - 1 - radius  # counters start here, so that passing the radius overflows
    chunk = max(1, (1 << 16) // width)
    for at in range(0, len(queries), chunk):
        rows = np.arange(at, min(at + chunk, len(queries)))
        q = queries[rows]
        count = [np.full((len(rows), width), (1 << 64) - 1 if start >> k & 1 else 0, np.uint64) for k in range(levels)]
        over = np.zeros((len(rows), width), np.uint64)
        for p in range(64):
            flip = np.where(q >> np.uint64(63 - p) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            carry = planes[p][None, :] ^ flip[:, None]
            for k in range(levels):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p % step == step - 1:
                live = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
                if not live.all():  # abandon the rows where every lane has passed the radius
                    if not live.any():
                        break
                    rows, q, over = rows[live], q[live], over[live]
                    count = [c[live] for c in count]
        else:
            near = np.unpackbits((~over).astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1)[:, :len(fps)]
            i, j = np.nonzero(near)
            yield rows[i], j


def link_cells(cells: DataFrame, radius: int) -> DataFrame:
    """Forest edges (a, b) between the fingerprints of each cell."""
    keys = ["mask_no", "bits", "lo", "hi"]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in runs(batches, keys):
            if len(cell) < 2:
                continue
            fp = cell["fp"].to_numpy()
            own, lo, hi = cell["own"].to_numpy(), cell["lo"].iat[0], cell["hi"].iat[0]
            order = np.argsort(own != lo, kind="stable")  # the first block in front
            fp, n_lo = fp[order], int((own == lo).sum())
            u = fp.view(np.uint64)
            first, second = (u, u) if lo == hi else (u[:n_lo], u[n_lo:])
            shift = 0 if lo == hi else n_lo
            parent = np.arange(len(fp))
            for i, j in within_radius(first, second, radius):
                merge_links(parent, i, j + shift)
            linked = np.flatnonzero(parent != np.arange(len(fp)))
            if len(linked):
                yield pd.DataFrame({"a": fp[parent[linked]], "b": fp[linked]})

    n = parts(cells.sparkSession)
    return cells.select(*keys, "own", "fp").repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(
        link, "a long, b long")


def near_links(fps: DataFrame, radius: int = 4, block: int = BLOCK, spare: int | None = None) -> DataFrame:
    """Forest edges (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    spark = fps.sparkSession
    masks = block_masks(radius, spare or spare_blocks(fps.count(), radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask_no"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
        for i, m in enumerate(signed)])).alias("k")).select("k.mask_no", "k.bits", "fp")
    large = (keyed.groupBy("mask_no", "bits").count().filter(F.col("count") > block)
             .select("mask_no", "bits", F.ceil(F.col("count") / block).cast("int").alias("n_blocks")))
    return link_cells(block_cells(keyed, ["mask_no", "bits"], large, F.xxhash64("fp"), block), radius)


def least_of_components(reach: DataFrame, least: DataFrame) -> DataFrame:
    """(component, component_id): the smallest ``least`` of the nodes of each component of ``reach``.

    Nodes are dealt by themselves and add up their components first; only then do the sums, one per component
    and partition, meet by component, so a component with a large share of the nodes is no hot key."""
    n = parts(reach.sparkSession)
    own = reach.join(least, reach["node"] == least["fp"]).select("component", "least", F.pmod(F.xxhash64("node"), F.lit(n)).alias("part"))
    some = own.groupBy("component", "part").agg(F.min("least").alias("least"))
    return some.groupBy("component").agg(F.min("least").alias("component_id"))


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; component_id is the smallest
    doc_id reachable by links of at most ``radius`` differing bits."""
    marked = materialize(fingerprints(docs, shingle), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    reach = materialize(components(near_links(distinct.select("fp"), radius, block)), "simhash-reach")
    smallest = materialize(least_of_components(reach, distinct), "simhash-least")
    # a large component's nodes all look up one row: AQE splits that key, or broadcasts a small table
    named = reach.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    every = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # stored, so that the last join has no shuffle in common with this one and AQE can split a hot fingerprint
    every = materialize(every, "simhash-named")
    return marked.join(every, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(docs: DataFrame) -> Column:
    """Orders the rows and tells them apart: by doc_id, nulls last, then 128 bits of all columns; only equal rows share it."""
    flat = [F.to_json(c) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in docs.columns]
    whole = [*flat, *map(F.isnull, docs.columns)]  # the hash passes over nulls
    return F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"),
                    F.xxhash64(*whole).alias("h0"), F.xxhash64(F.lit(1), *whole).alias("h1"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component: the row of the smallest :func:`row_key` (of repeated rows, one)."""
    name = free_name("key", docs)
    keyed = docs.withColumn(name, row_key(docs))
    reach = simhash_components(keyed.select(F.col(name).alias("doc_id"), "text"), shingle, radius)
    keep = reach.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(keep, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
