"""Token counts without identifiers: heap-and-linked-list byte-pair merging.

A word starts as its byte symbols (the last one marked as word end).  A heap holds every
adjacent pair that has a merge rank; the lowest rank (leftmost first) is popped, the pair
is merged in a linked list, and the two new neighbours are pushed.  The count of a word is
its initial symbols minus the merges made; no token identifiers are produced.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
row by row; extra columns are ignored; an empty table gives no rows.  Special strings inside
a text count as one token each, as the tokenizer's library does by default.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from hitfeed.llm.common import map_texts

#: Words kept by a worker; twice as many at most (two generations).
CACHE_WORDS = 250_000

# fixed values: the byte alphabet of byte-level vocabularies (printable Latin-1 as itself,
# the other bytes from U+0100 on in order)
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_symbols() -> list[str]:
    rest = iter(range(256))
    shown = set(PRINTABLE)
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


def merged_length(symbols: list[int], ranks: dict[int, int], base: int) -> int:
    """Symbols left after all merges, lowest rank first, then leftmost.

    Symbols are numbers below 2**20: the byte symbols first (``base`` of them), then the symbol
    that the merge of each rank makes.  ``ranks`` has the rank of the pair (a, b) at a << 20 | b.
    """
    n = len(symbols)
    sym = symbols + [0]
    heap = []
    for i in range(n - 1):
        r = ranks.get(sym[i] << 20 | sym[i + 1])
        if r is not None:
            heap.append(r << 32 | i)
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    left = n
    while heap:
        e = pop(heap)
        i = e & 0xFFFFFFFF
        j = nxt[i]
        if j >= n or sym[i] < 0 or get(sym[i] << 20 | sym[j]) != e >> 32:
            continue  # a neighbour has changed since this entry was pushed
        a = sym[i] = base + (e >> 32)
        sym[j] = -1
        left -= 1
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            r = get(a << 20 | sym[k])
            if r is not None:
                push(heap, r << 32 | i)
        k = prv[i]
        if k >= 0:
            r = get(sym[k] << 20 | a)
            if r is not None:
                push(heap, r << 32 | k)
    return left


class WordCache(dict):
    """Value of a word, computed when missing; two generations bound the memory."""

    def __init__(self, compute, size: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


class TokenCounter:
    """Counts for one vocabulary file: lower-cased words with word ends, white space dropped.

    Reads normaliser steps, split pattern, merges and special tokens from the file and
    refuses a file of another layout.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"{path}: not a lower-casing word BPE")
        end = model["end_of_word_suffix"] or ""
        alphabet = byte_symbols()
        number = {x: i for i, x in enumerate(alphabet + [x + end for x in alphabet])}
        self.base = len(number)
        self.ranks = {}
        for rank, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.ranks[number[x] << 20 | number[y]] = rank
            number[x + y] = self.base + rank
        # white space by the Unicode property, as the vocabulary's own engine reads \s
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = [t[:2] for t in special]
        # a word of white space's making holds whole matches of the pattern only
        self.odd = regex.compile("[\x1c-\x1f]")  # white space to str.split, not to the pattern
        self.cache = WordCache(self._of_chunk)
        self.word_cache = WordCache(self.of_word)

    def of_word(self, word: str) -> int:
        symbols = list(word.encode("utf-8"))
        symbols[-1] += 256
        return merged_length(symbols, self.ranks, self.base)

    def _of_chunk(self, chunk: str) -> int:
        return sum(map(self.word_cache.__getitem__, self.words.findall(chunk)))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # one code point at a time: a capital sigma never becomes a final sigma
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if self.odd.search(text):
            return self._of_chunk(text)
        return sum(map(self.cache.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(m in text for m in self.marks):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self._plain, pieces))
        return self._plain(text)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    def make():
        count = counter(tokenizer_path).count
        return lambda texts: [pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                              pa.array(list(map(count, texts)), pa.int64())]

    return map_texts(docs, make, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
