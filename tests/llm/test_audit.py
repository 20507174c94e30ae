import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from hitfeed.llm.divergence import audit, gallop, merge_price, share, term_slices

SCHEMA = "doc_id long, text string, lang string, source string, n long, value string, rank int, term string"


def terms_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def expected(rows, min_docs=10, top=10):
    """The audit in plain Python: (lang, source, part, item, value, rank)."""
    docs = [(t, lang or "", s or "") for _, t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        held = Counter(t for d in own for t in set(terms_of(d[0])))
        kept = {t for t, n in held.items() if n >= min_docs}
        groups = {s: Counter(t for d in own if d[2] == s for t in terms_of(d[0]) if t in kept) for s in {d[2] for d in own}}
        whole = sum(groups.values(), Counter())

        def p(c, t):
            return 1 + 10 ** 9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        parts = {(s, "pair"): [] for s in groups} | {(s, "term"): [] for s in groups}
        for a, b in permutations(groups, 2):
            parts[a, "pair"].append((sum(f(p(groups[a], t), p(groups[b], t)) for t in kept), b))
        for s, c in groups.items():
            parts[s, "term"] = [(f(p(c, t), p(whole, t)), t) for t in c if p(c, t) > p(whole, t)]
        for (s, part), found in parts.items():
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            for rank, (value, item) in enumerate(found if part == "pair" else found[:top], 1):
                out.append((lang, s, part, item, value, rank))
    return sorted(out)


def run(spark, rows, **kw):
    full = [(*r, 1, "x", 2, "y") for r in rows]  # more columns, named like the operator's own
    docs = spark.createDataFrame(full, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in audit(docs, **kw).collect())


def corpus(rnd, n):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "日本", "ÀB", "ab1cd", "x-y"]
    rows = []
    for i in range(n):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s1", "s2", "s3", None, ""])
        text = " ".join(rnd.choice(words[:30] if lang == "de" else words) for _ in range(rnd.randrange(40)))
        rows.append((i, rnd.choice([text, text, text.upper(), None, ""]), lang, source))
    return rows + rows[:20]  # repeated rows count


def test_against_plain_python(spark):
    rows = corpus(random.Random(5), 250)
    assert run(spark, rows) == expected(rows)


def test_many_blocks_give_the_same(spark):
    rows = corpus(random.Random(6), 120)
    assert run(spark, rows, min_docs=3, block=7, top=4) == expected(rows, 3, 4)


def test_languages_without_kept_terms_and_groups_without_terms(spark):
    rows = [(i, "one two", "en", "a") for i in range(12)] + [(20, None, "en", "b"), (21, "12 34", "en", "c"), (22, "rare", "fr", "a"),
                                                             (23, "words", "fr", "b"), (24, None, None, None)]
    found = run(spark, rows)
    assert found == expected(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in found
    assert {r[1] for r in found if r[0] == "en" and r[2] == "pair"} == {"a", "b", "c"}
    assert not [r for r in found if r[0] == ""]  # one group alone, no terms: no pair and no term


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_text_is_read_in_slices():
    text = "Alpha beta42gamma " * 300_000
    n = Counter()
    for part in term_slices(text):
        n.update(part)
    assert n == {b"alpha": 300_000, b"beta": 300_000, b"gamma": 300_000}
    assert [x for part in term_slices("x" * 9_000_000) for x in part] == [b"x" * 9_000_000]


def test_gallop_is_a_sorted_search():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, rnd.integers(1, 400), rnd.integers(0, 120))) for _ in "ab")
        if rnd.random() < 0.3:
            b = b + 200
        assert (gallop(a, b) == np.searchsorted(b, a)).all()


def test_share_is_exact_for_large_counts():
    for n, whole in [(0, 2), (7, 10 ** 15), (10 ** 14, 10 ** 15 + 7), (8 * 10 ** 15, 9 * 10 ** 15 - 1)]:
        assert int(share(n, whole)) == 1 + 10 ** 9 * (n + 2) // whole


@pytest.mark.parametrize("seed", range(5))
def test_merge_price(seed):
    rnd = random.Random(seed)
    a, b = ({rnd.randrange(50): rnd.randrange(1, 1000) for _ in range(rnd.randrange(30))} for _ in "ab")
    wa, wb = sum(a.values()) + 100, sum(b.values()) + 100
    p = lambda c, t, w: 1 + 10 ** 9 * (c.get(t, 0) + 2) // w
    cost = sum((p(a, t, wa) - p(b, t, wb)) ** 2 // (p(a, t, wa) + p(b, t, wb)) for t in a.keys() | b.keys())
    arrays = [np.array(sorted(c)) for c in (a, b)]
    counts = [np.array([c[t] for t in sorted(c)], np.int64) for c in (a, b)]
    assert merge_price(arrays[0], counts[0], wa, arrays[1], counts[1], wb) == (cost, len(a.keys() | b.keys()))
