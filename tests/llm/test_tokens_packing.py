import json
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hitfeed.llm.common import materialize
from hitfeed.llm.packing import cut_pieces, encoder, numbered, pack, pack_documents, pack_patterns, pattern_places
from hitfeed.llm.token_count import WordCache, counter, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*"abcXYZ'sdΣσςİßẞéÉ́\u0085 \x1c\x1f　  \t\n12٣½中文字😀👍🏽'S'LL \r\n", "<|endoftext|>",
          "<|startoftext|>", "don't", "WE'LL", "ﬁ", "ǅ", "Å", "<|", "the and ", "   "]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=20)  # assigned characters


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(text):
    lib = _lib(WORDS)
    assert counter(WORDS).count(text) == len(lib.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(text):
    lib = _lib(BYTES)
    assert np.frombuffer(encoder(BYTES).ids(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


@lru_cache
def _lib(path):
    return Tokenizer.from_file(path)


def test_whole_documents_and_long_words(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["x" * 5000, "ab" * 4000 + " é" * 300, "the " * 9000]
    for t in texts:
        assert counter(WORDS).count(t) == len(_lib(WORDS).encode(t, add_special_tokens=False).ids)
        assert np.frombuffer(encoder(BYTES).ids(t), "<u4").tolist() == _lib(BYTES).encode(t, add_special_tokens=False).ids


def test_cache_is_bounded():
    c = WordCache(len, 10)
    assert [c[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)]
    assert len(c) <= 10 and len(c.old) <= 10 and c["3"] == 1


def test_token_count_rows(spark):
    rows = [(1, None), (2, ""), (3, "thé end"), (3, "thé end"), (None, "a"), (2**60 + 1, "a " * 3000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, token_counts(df, WORDS).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(_lib(WORDS).encode(t or "").ids), n > 2048) for d, t in rows]
    assert got == sorted(want, key=str)
    assert token_counts(df.limit(0), WORDS).count() == 0


def test_shortest_pack_first():
    # 6 and 5 open packs; 4 goes to the shortest that fits (5 -> 9), then 1 fills on from the shortest
    assert sorted(pack_patterns({6: 1, 5: 1, 4: 1, 1: 1}, 10)) == [([5, 4], 1), ([6, 1], 1)]
    assert pack_patterns({10: 3}, 10) == [([10], 3)] and pack_patterns({}, 10) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**6), max_size=40))
def test_patterns_hold_every_piece_once(histogram):
    patterns = pack_patterns(histogram, 64)
    held = {}
    for p, n in patterns:
        assert sum(p) <= 64
        for length in p:
            held[length] = held.get(length, 0) + n
    assert held == histogram
    ends = {}
    for length, first, end, _, _ in pattern_places(patterns):
        assert first == ends.get(length, 0)
        ends[length] = end
    assert ends == histogram


@pytest.mark.parametrize("block", [10_000, 3])
def test_pieces_fill_sequences(spark, block):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "of", "xqz", "é"]) for _ in range(rnd.choice([0, 1, 5, 40, 90])))) for i in range(60)]
    rows += [(100, None), (101, ""), (5, rows[5][1]), (None, "no id"), (102, "<|endoftext|> in text")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, offset string")
    out = pack(materialize(numbered(cut_pieces(df, BYTES, 32)), "pieces"), 32, rank_block=block).toPandas()
    ids = {d: [*_lib(BYTES).encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    total = sum(len(_lib(BYTES).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert out["length"].sum() == total
    for r in out.itertuples():
        own = ids[None if np.isnan(r.doc_id) else int(r.doc_id)]
        piece = own[r.start:r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all()
    assert out.groupby("sequence_id")["length"].sum().max() <= 32
    assert pack_documents(df.limit(0), BYTES).count() == 0


def test_layout_is_checked(tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"model": {"type": "Unigram"}, "normalizer": None,
                                                 "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": []}))
    with pytest.raises(ValueError):
        encoder(str(tmp_path / "x.json"))


def test_equal_pieces_make_no_large_bucket(spark):
    """A third of the rows are one text without id: their ranks come from many buckets, and every piece has a place."""
    rows = [(None, "the same words again")] * 400 + [(i, "other words " * (i % 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    pieces = materialize(numbered(cut_pieces(df, BYTES, 64)), "pieces")
    sizes = pieces.selectExpr("pmod(xxhash64(doc_id, start, ids_crc32, number), 20) AS b").groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) < 150
    out = pack(pieces, 64, rank_block=60).toPandas()
    assert len(out) == pieces.count() and "number" not in out.columns
    for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
