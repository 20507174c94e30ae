import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitfeed.llm import fim_chunks as fim

SCHEMA = "doc_id long, text string, n string, form int, output string, draws string"


def expected(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcdefg é日😀<>PSM\n") for _ in range(rnd.randrange(1, 3000))) for _ in range(6)]
    out = ["", "\n", "\n\n", "x", "no end", "a\nb", "a\nb\n", "<P>", "a <S> b\nc", "<M", "<<P\n>", "a<\nP>b", "\r\n\x0b\x85 x\n", "é" * 5000 + "\n日",
           "x" * 40_000, "<" * 20_000 + "\n" + ">" * 20_000]
    for _ in range(n):
        out.append("".join(rnd.choice([*shared, "line\n", "tail", "<P", ">", "S>"]) for _ in range(rnd.randrange(1, 8))))
    return out


def test_against_plain_python(spark):
    rows = [(i, t, "a", 1, "b", "c") for i, t in enumerate(texts(1, 120))]
    rows += [(None, "null id\nx\ny", "a", 1, "b", "c"), (7, None, "a", 1, "b", "c"), rows[30], rows[30]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = fim.fill_in_middle(docs)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((r[0], *expected(*r[:2])) for r in rows), key=str)
    back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fim.fim_digests(docs).collect()}
    assert digests == {(r[0], sha(expected(*r[:2])[-1]), sha(r[1])) for r in rows}


def test_empty_table(spark):
    assert fim.fim_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rates(spark):
    docs = spark.createDataFrame([(i, f"a\nb\nc{i}") for i in range(400)], "doc_id long, text string")
    forms = [r["form"] for r in fim.fill_in_middle(docs, rate=50, spm=10).collect()]
    assert 140 < forms.count("plain") < 260 and 2 < forms.count("spm") < 50
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_a_very_long_text():
    text = "".join(random.Random(2).choice(["some words\n", "é", "日本 ", "\n"]) for _ in range(900_000))
    out = fim.transform(text, (123_456, 345_678, 0, 80), fim.ContentCache())
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(x % (len(lines) + 1) for x in (123_456, 345_678))
    assert out[0] == len(lines) and out[2] == len("".join(lines[:a])) and out[3] == len("".join(lines[a:b]))


def test_chunks_follow_the_content():
    rnd = np.random.default_rng(3)
    passage = rnd.integers(32, 127, 60_000, dtype=np.uint8)
    ends = [set(fim.chunk_ends(np.concatenate([rnd.integers(32, 127, n, dtype=np.uint8), passage]))) for n in (0, 777, 1_100_000)]
    shifted = [{e - n for e in x if e > n} for x, n in zip(ends, (0, 777, 1_100_000))]
    assert len(shifted[0] & shifted[1] & shifted[2]) > 0.9 * len(shifted[0])
    for x in ends:
        sizes = np.diff([0, *sorted(x)])
        assert sizes.max() <= fim.MOST and (sizes[:-1] >= fim.LEAST).all()


def test_rolling_hash_sees_its_window():
    data = np.random.default_rng(4).integers(0, 256, 500, dtype=np.uint8)
    h = fim.rolling_hash(data)
    for i in (0, 5, 31, 32, 100, 499):
        want = sum(int(fim.GEAR[data[i - j]]) << j for j in range(min(i + 1, 32))) % (1 << 32)
        assert int(h[i]) == want


@pytest.mark.parametrize("limit", [10, 3000, 1 << 25])
def test_the_cache_is_bounded_and_right(limit):
    cache = fim.ContentCache(limit)
    rnd = random.Random(5)
    for _ in range(300):
        chunk = bytes(rnd.choice(b"ab\n<P>") for _ in range(rnd.randrange(1, 50)))
        assert cache(chunk) == fim.summarise(chunk)
    assert sum(map(len, cache.young)) + sum(map(len, cache.old)) <= limit + 100
