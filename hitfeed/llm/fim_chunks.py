"""Fill-in-middle transformation over content-defined chunks.

A text is cut by a rolling hash: a chunk ends where the hash of the last 32 bytes has ``MASK`` clear, so a
passage that many documents share falls into the same chunks wherever it stands.  A chunk's summary (its line
ends, its code points before each of them and in all, whether it holds a marker, and its first and last
bytes, for markers across a boundary) is computed once and kept in a content cache of bounded size; a
chunk counts as known only if its whole content is equal.  The line count of a document is the sum over its
chunks; the running sums locate the chunk and then the line end at which the document is cut.

The text of n lines (each with its line end; the last may lack it) is cut after the smaller and after the larger of two
draws from 0 to n; prefix, suffix and middle are put behind their markers, in the order of one of two forms.
Draws come from the SHA-256 of a salted doc_id, so reruns agree.  A document that is empty, holds a marker or
is not chosen stays as it is (``plain``).

Defined cases: a null text is an empty one; a null doc_id counts as an empty text in the draw; repeated rows get the
same result; a text without line ends is one line, however long; the rolling hash runs over long texts in
pieces; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hitfeed.llm.common import id_text

# fixed values: the markers
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes that the rolling hash sees, and the bits of it that are 0 at the end of a chunk (of about 1,024 bytes).
WINDOW, MASK = 32, np.uint32(0x3FF << 22)
#: Bytes of a chunk, at least (but for the last) and at most.
LEAST, MOST = 128, 16_384
#: Bytes that are hashed at once, that the cache holds, and of output in a batch.
PIECE, CACHE, BATCH = 1 << 20, 1 << 25, 1 << 24
#: A random number for each byte.
GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes up to each byte: sum of GEAR shifted by the distance."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # windows of twice the size from two of the size
        before = h[:-step] << np.uint32(step)
        h[step:] += before
        step *= 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """The end of every chunk, by content."""
    ends, last, n = [], 0, len(data)
    for at in range(0, n, PIECE):
        seen = max(0, at - WINDOW + 1)
        marks = np.flatnonzero(rolling_hash(data[seen:at + PIECE])[at - seen:] & MASK == 0) + at + 1
        for end in marks.tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                last = end
                ends.append(last)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


class Summary(NamedTuple):
    breaks: list[int]  # bytes up to each line end, itself included
    chars_at: list[int]  # code points up to there
    n_chars: int
    marked: bool
    head: bytes
    tail: bytes


def summarise(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.cumsum(data & 0xC0 != 0x80)  # code points begin at bytes that are no continuation
    return Summary(breaks.tolist(), starts[breaks - 1].tolist(), int(starts[-1]), any(m in chunk for m in MARKERS),
                   chunk[:2], chunk[-2:])


class ContentCache:
    """Summaries by content: two generations, together of bounded size."""

    def __init__(self, limit: int = CACHE):
        self.limit, self.size = limit // 2, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def __call__(self, chunk: bytes) -> Summary:
        found = self.young.get(chunk)  # equal content, not only an equal hash
        if found is None:
            found = self.old.get(chunk) or summarise(chunk)
            if self.size > self.limit:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = found
            self.size += len(chunk) + 32 * len(found.breaks) + 200
        return found


class Lines:
    """Where the lines of a text end, from the summaries of its chunks."""

    def __init__(self, data: bytes, cache: ContentCache):
        self.ends = chunk_ends(np.frombuffer(data, np.uint8))
        self.starts = [0, *self.ends[:-1]]
        self.chunks = [cache(data[a:b]) for a, b in zip(self.starts, self.ends)]
        self.breaks = list(accumulate(len(c.breaks) for c in self.chunks))
        self.chars = [0, *accumulate(c.n_chars for c in self.chunks)]
        open_ = bool(data) and not data.endswith(b"\n")
        self.n = (self.breaks[-1] if self.breaks else 0) + open_
        self.size = len(data)
        self.marked, tail = False, b""
        for c in self.chunks:
            joint = tail + c.head
            self.marked = self.marked or c.marked or any(m in joint for m in MARKERS)
            tail = (tail + c.tail)[-2:]

    def cut(self, lines: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``lines`` lines."""
        if not lines:
            return 0, 0
        i = bisect_left(self.breaks, lines)
        if i == len(self.breaks):  # the last line, without an end
            return self.size, self.chars[-1]
        within = lines - (self.breaks[i - 1] if i else 0) - 1
        c = self.chunks[i]
        return self.starts[i] + c.breaks[within], self.chars[i] + c.chars_at[within]


def transform(text: str | None, draws: tuple[int, int, int, int], cache: ContentCache, rate: int = 100, spm: int = 50) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    data = text.encode("utf-8")
    lines = Lines(data, cache)
    n = lines.n
    if not data or lines.marked or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = map(lines.cut, sorted(d % (n + 1) for d in draws[:2]))
    prefix, middle, suffix = (x.decode("utf-8") for x in (data[:a], data[a:b], data[b:]))
    if draws[3] % 100 < spm:
        return n, "spm", a_chars, b_chars - a_chars, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a_chars, b_chars - a_chars, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, salt: str = "7:", rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; ``rate`` percent are transformed,
    ``spm`` percent of them with the suffix in front."""
    digest = F.sha2(F.concat(F.lit(salt), id_text(F.col("doc_id"))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ContentCache()
        for b in batches:
            rows, size, at = [], 0, 0
            for i in range(b.num_rows):
                rows.append(transform(b.column(1)[i].as_py(), b.column(2)[i].as_py(), cache, rate, spm))
                size += len(rows[-1][-1])
                if size > BATCH or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, len(rows)), *map(pa.array, zip(*rows), kinds)], names=names)
                    rows, size, at = [], 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", draws.alias("draws")).mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind each of three markers; texts hold none themselves."""
        rest = F.substring(output, len(first) + 1, F.length(output))
        one, tail = F.substring_index(rest, second, 1), F.substring(rest, F.instr(rest, second) + len(second), F.length(rest))
        return one, F.substring_index(tail, MIDDLE, 1), F.substring(tail, F.instr(tail, MIDDLE) + len(MIDDLE), F.length(tail))

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix_first, prefix_second, middle_last = between(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix_second, middle_last, suffix_first)).otherwise(output))


def fim_digests(docs: DataFrame, salt: str = "7:", rate: int = 100, spm: int = 50) -> DataFrame:
    """Line counts, forms, and digests of every output and of the text restored from it."""
    rows = fill_in_middle(docs, salt, rate, spm)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
             list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS draws FROM d),
c AS (SELECT *, len(lines) AS n, least(draws[1] % (len(lines) + 1), draws[2] % (len(lines) + 1)) AS a,
             greatest(draws[1] % (len(lines) + 1), draws[2] % (len(lines) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 100 THEN 'plain'
                  WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(lines[:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
             array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
