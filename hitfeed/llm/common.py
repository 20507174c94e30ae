"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitfeed.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared scratch folder and read it back.

    A reliable lineage cut: what is read later never recomputes the plan above it, and
    survives the loss of executors.  The copy is removed when the driver ends (or by :func:`discard`).
    """
    return store(df, name)[0]


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`materialize`, with the path, for results that are discarded later."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def free_name(name: str, *taken: DataFrame | list[str]) -> str:
    """``name``, or the first of name_1, name_2, ... that none of the frames (or lists of columns) has."""
    used = {c.lower() for t in taken for c in (t if isinstance(t, list) else t.columns)}
    out, i = name, 0
    while out.lower() in used:
        i += 1
        out = f"{name}_{i}"
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove stored results that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(c: Column) -> Column:
    """An id as text; a null id is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], list[pa.Array]]], columns: str) -> DataFrame:
    """doc_id and what a function makes of the texts of a batch (one value per text and column).

    ``make`` runs once in each task.  Ids pass through as Arrow columns, so null and large
    ids stay as they are.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *of(b.column(1).to_pylist())], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Split a stream of key-sorted batches into one frame per key.

    Holds one batch and one key's rows; callers bound the rows of a key beforehand.
    """
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = tuple(k[lo])
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[lo:hi])
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def merge_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the linked rows ``a[i]``-``b[i]`` in ``parent`` (in place); roots are the smallest rows."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def block_cells(df: DataFrame, keys: list[str], counts: DataFrame, salt: Column, block: int) -> DataFrame:
    """Spread the rows of each key over cells of at most about two blocks of rows.

    ``counts`` holds ``keys`` and ``n_blocks``.  A key with one block is one cell (0, 0).  A
    larger key is cut into blocks by ``salt`` (a hash of the row), and every pair of
    blocks is a cell, so any two rows of the key meet in exactly one cell (two rows of one
    block in that block's own).  Adds ``own`` (the row's block), ``lo`` and ``hi`` (the cell).
    """
    n = F.coalesce(F.col("n_blocks"), F.lit(1))
    return (
        df.join(counts, keys, "left")
        .withColumn("own", F.pmod(salt, n).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("n_blocks", "other")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star / small-star rounds.  Every round is a grouped minimum (combined before
    the shuffle) and a join, so a hub with very many neighbours is neither collected into
    an array nor sent to one task whole (skewed join partitions are split by AQE).  The edge list
    is written to the shared scratch folder after each round; the loop ends when a round
    changes nothing.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    spark = edges.sparkSession
    e, kept = store(e, "edges")
    state = None
    for _ in range(max_rounds):
        # large star: neighbours above a node hang on the node's smallest neighbour (or itself)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of a node hang on the smallest of them
        down = large.filter("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        down, star = store(down, "star")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e, new = store(small, "edges")
        discard(spark, star, kept)
        kept = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
