"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it.  A text is
parsed from left to right into the longest substrings that the automaton knows; a text in the
language falls into few long phrases, another into many short ones.  Phrases times the bits
that point into the learned text, per letter of the parsed text, is the cross entropy; the language
that needs fewest wins.

Whole texts are parsed, in segments of ``SEGMENT`` symbols whose phrases are added up (every language
has the same cuts): many segments take a step at once through the automaton.  Its transitions are a dense table
where that is small, else a hash table, so memory follows the learned text and not the size of its alphabet.  The learned
text is a bounded sample: the ``docs_per_language`` different texts of each language with the smallest
hashes (all, if fewer), ``chars_per_language`` characters of them (less, if all languages together would
pass ``chars_in_all``).  All of these texts take part: the longer ones, cut to the same size, by pieces
that are spread over the text.

Defined cases: ``und`` and score 0 for a null text, one without a letter, or if nothing was learned;
ties go to the first language by name; letters that no sample holds are a phrase each; repeated rows
get the same result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hitfeed.llm.common import id_text, map_texts

SEGMENT = 256
#: Symbols that are parsed together; bounds the memory of a task.
CHUNK = 4_000_000
DOCS_PER_LANGUAGE = 200
CHARS_PER_LANGUAGE = 40_000
#: Symbols of all languages together, so that many languages still fit a worker.
CHARS_IN_ALL = 1_600_000
#: Cells of all dense transition tables together (4 bytes each); languages beyond it have hashed ones.
DENSE_CELLS = 24_000_000
#: Pieces of a text that is longer than its share, and the characters a piece should have at least.
PIECES, PIECE = 4, 50


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case code point of every letter of the basic plane; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


def letters(text: str | None) -> np.ndarray:
    """Code points of a text: lower-case letters, runs of anything else as one 0."""
    cp = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    far = cp > 0xFFFF
    out = letter_table()[np.where(far, 0, cp)]
    if far.any():  # beyond the basic plane: all letters are one symbol
        alpha = {c: chr(c).isalpha() for c in np.unique(cp[far]).tolist()}
        out[far] = [0xFFFF if alpha[c] else 0 for c in cp[far].tolist()]
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    return out[keep]


class Edges(NamedTuple):
    """The transitions of an automaton, sorted by state, then symbol; state 0 is the start."""

    symbols: np.ndarray  # code points of the text, ascending; edges number them from 0
    states: int
    source: np.ndarray
    symbol: np.ndarray
    target: np.ndarray


def suffix_automaton(text: np.ndarray) -> Edges:
    """Automaton of all substrings of the code points: at most two states and three edges for each of them."""
    symbols, numbers = np.unique(text, return_inverse=True)
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in numbers.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    count = np.fromiter(map(len, nxt), np.int64, len(nxt))
    flat = lambda of: np.fromiter((x for edges in nxt for x in of(sorted(edges.items()))), np.int32, int(count.sum()))
    return Edges(symbols, len(nxt), np.repeat(np.arange(len(nxt), dtype=np.int32), count),
                 flat(lambda e: [c for c, _ in e]), flat(lambda e: [to for _, to in e]))


class DenseSteps:
    """Transitions as a table of states x own symbols: one look per step."""

    def __init__(self, edges: Edges):
        self.size = len(edges.symbols) + 1  # the last symbol: not in the text
        self.table = np.full(edges.states * self.size, -1, np.int32)
        self.table[edges.source.astype(np.int64) * self.size + edges.symbol] = edges.target

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.table[state.astype(np.int64) * self.size + symbol]


class HashedSteps:
    """Transitions in a hash table with open addressing: memory in proportion to the edges, whatever the alphabet."""

    def __init__(self, edges: Edges):
        self.size = len(edges.symbols) + 1
        keys = edges.source.astype(np.int64) * self.size + edges.symbol
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.targets = np.full(1 << bits, -1, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)  # of several that want a slot, one gets it
            won = free[first]
            self.keys[at[won]], self.targets[at[won]] = keys[won], edges.target[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = at[todo] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        keys = state.astype(np.int64) * self.size + symbol
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.targets[at], -1).astype(np.int32)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):  # the few whose slot another edge has taken
            at[todo] = at[todo] + 1 & self.mask
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.targets[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


def learn(learned: tuple[tuple[str, str], ...]) -> list[tuple[str, int, Edges]]:
    """(language, symbols of its text, automaton) of each learned text; built once, on the driver, from the bounded sample."""
    texts = [(name, letters(t)) for name, t in learned]
    return [(name, len(x), suffix_automaton(x)) for name, x in texts]


class CrossParser:
    """The automata of all languages; each numbers its own symbols.

    The languages with the smallest tables have dense ones, ``DENSE_CELLS`` together at most; the others are hashed.
    Both give the same steps."""

    def __init__(self, learned: list[tuple[str, int, Edges]], dense_cells: int = DENSE_CELLS):
        self.languages = [name for name, _, _ in learned]
        self.bits = np.log2([max(2, n) for _, n, _ in learned])
        self.numbers, self.steps = [], [None] * len(learned)
        for _, _, e in learned:
            number = np.full(1 << 16, len(e.symbols), np.uint16)
            number[e.symbols] = np.arange(len(e.symbols))
            self.numbers.append(number)
        cells = [e.states * (len(e.symbols) + 1) for _, _, e in learned]
        for i in sorted(range(len(learned)), key=lambda i: cells[i]):
            dense_cells -= cells[i]
            self.steps[i] = (DenseSteps if dense_cells >= 0 else HashedSteps)(learned[i][2])

    def phrases(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(segments, languages) phrases; ``segments`` (SEGMENT x n code points) has the longest first."""
        out = np.ones((len(lengths), len(self.steps)), np.int64)
        active = [int(np.searchsorted(-lengths, -step, "left")) for step in range(int(lengths[0]))]
        for i, (number, step_of) in enumerate(zip(self.numbers, self.steps)):
            own = number[segments]
            start = np.maximum(step_of(np.zeros(step_of.size, np.int32), np.arange(step_of.size)), 0)
            state = np.zeros(len(lengths), np.int32)
            for step, n in enumerate(active):
                c = own[step, :n]
                to = step_of(state[:n], c)
                miss = (to < 0) | (state[:n] == 0)  # no longer match, or an unknown symbol before
                if step:  # the first phrase is counted already
                    out[:n, i] += miss
                state[:n] = np.where(miss, start[c], to)
        return out

    def entropies(self, texts: list) -> list:
        """Bits per symbol of each text by language; None without a letter."""
        found = [None] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            x = letters(t)
            if x.any():
                held.append((i, x))
                size += len(x)
            if held and (size >= CHUNK or i == len(texts) - 1):
                self._parse(held, found)
                held, size = [], 0
        if held:
            self._parse(held, found)
        return found

    def _parse(self, held: list, found: list) -> None:
        sizes = np.array([len(x) for _, x in held])
        owner = np.repeat(np.arange(len(held)), -(-sizes // SEGMENT))
        flat = np.concatenate([x for _, x in held])
        first = np.concatenate([np.arange(s, s + n, SEGMENT) for s, n in zip(np.cumsum(sizes) - sizes, sizes)])
        length = np.minimum(SEGMENT, np.repeat(np.cumsum(sizes), -(-sizes // SEGMENT)) - first)
        order = np.argsort(-length, kind="stable")
        at = first[order][None, :] + np.arange(SEGMENT)[:, None]
        segments = flat[np.minimum(at, len(flat) - 1)]
        phrases = self.phrases(segments, length[order])
        total = np.zeros((len(held), len(self.steps)), np.int64)
        np.add.at(total, owner[order], phrases)
        for (i, x), n in zip(held, total):
            found[i] = n * self.bits / len(x)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text, h in zip(texts, self.entropies(texts)):
            if h is None:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(h))
            # code lengths as posterior weights, of at most 64 symbols
            names.append(self.languages[best])
            scores.append(float(1 / np.exp2(-(h - h[best]) * min(64, len(text))).sum()))
        return names, scores


_parsers: dict[int, CrossParser] = {}


def parser(key: int, learned) -> CrossParser:
    """The parser of a broadcast, one for each Python worker."""
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(learned.value)
    return _parsers[key]


def held_out(doc_id, folds: int = 3):
    return F.crc32(id_text(doc_id)) % folds == 1


def even_share(lengths: list[int], total: int) -> int:
    """The size at which texts, the longer ones cut to it, have ``total`` characters together; at least 1."""
    for i, n in enumerate(sorted(lengths)):
        share = total // (len(lengths) - i)
        if n > share:
            return max(1, share)
        total -= n
    return max(lengths)


def pieces_of(text: Column, size: Column) -> Column:
    """A text of at most ``size`` characters as it is, of a longer one up to ``PIECES`` pieces spread over it."""
    n = F.length(text)
    k = F.greatest(F.lit(1), F.least(F.lit(PIECES), F.floor(size / PIECE))).cast("int")
    piece = F.floor(size / k).cast("int")
    cut = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(
        text, (F.floor(n / k * i + (n / k - piece) / 2) + 1).cast("int"), piece))
    return F.when(n <= size, text).otherwise(F.array_join(cut, "\n"))


def learned_texts(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE,
                  chars_per_language: int = CHARS_PER_LANGUAGE, chars_in_all: int = CHARS_IN_ALL) -> tuple[tuple[str, str], ...]:
    """(language, text) from a bounded sample of labelled documents outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "hash").distinct().groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return ()
    # more than are taken, so that practically never fewer pass; the copies of a text pass together
    some = docs_per_language + 10 * docs_per_language ** 0.5 + 50
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, some / n)])[F.col("lang")]
    spread = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    passed = rows.select("lang", "text", spread.alias("spread")).filter(F.col("spread") < share)
    lengths: dict[str, list[tuple[float, int]]] = {}
    for r in sorted(passed.select("lang", "spread", F.length("text").alias("n")).distinct().collect()):
        lengths.setdefault(r["lang"], []).append((r["spread"], r["n"]))
    most = min(chars_per_language, chars_in_all // len(lengths))
    taken = {k: x[:docs_per_language] for k, x in lengths.items()}
    last = F.create_map(*[F.lit(v) for k, x in taken.items() for v in (k, x[-1][0])])[F.col("lang")]
    size = F.create_map(*[F.lit(v) for k, x in taken.items() for v in (k, even_share([n for _, n in x], most))])[F.col("lang")]
    sample = (passed.filter(F.col("spread") <= last).select("lang", "spread", pieces_of(F.col("text"), size).alias("text"))
              .distinct().collect())
    by_language: dict[str, list[str]] = {}
    for r in sorted(sample):
        by_language.setdefault(r["lang"], []).append(r["text"])
    return tuple((name, "\n".join(t)) for name, t in sorted(by_language.items()))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    sample = learned_texts(docs)
    # a few bytes for each character of the bounded sample
    shipped, key = docs.sparkSession.sparkContext.broadcast(learn(sample)) if sample else None, hash(sample)

    def make():
        if shipped is None:
            return lambda texts: [pa.array(["und"] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
        p = parser(key, shipped)
        return lambda texts: [pa.array(x, t) for x, t in zip(p.predict(texts), (pa.string(), pa.float64()))]

    return map_texts(docs, make, "lang_pred string, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
