import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitfeed.llm.langid_crossparse import (
    CrossParser, DenseSteps, HashedSteps, SEGMENT, learn, learned_texts, letters, predict_languages, suffix_automaton,
)
from hitfeed.llm.qda_quality import COUNTS, QualityModel, counts, fit_quality, document_counts, keep_quality, quality_scores

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    right = (got["predicted"] == got["quality"]).mean()
    low, high = got[got["quality"] == 0]["score"], got[got["quality"] == 1]["score"]
    auc = np.mean([(h > low.to_numpy()).mean() for h in high])
    assert len(got) > 40 and right >= 0.95 and auc >= 0.98
    assert got["score"].between(0, 1).all()


def test_score_uses_the_text_alone(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_scores(d, lab).collect())) for d, lab in ((docs, labels), (other, flipped)))
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b]
    assert np.allclose([r[2] for r in a], [r[2] for r in b])


def test_log_densities_match_the_formula(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["aa", "Bb!", "c,", "12", "#"][:5 - 2 * (i % 2)]) for _ in range(rnd.randrange(4, 60)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(0, 1)], "doc_id long, quality int")
    stored = document_counts(docs).cache()
    m = fit_quality(stored, labels, shrinkage=0.2)
    kept = [(i, t) for i, t in rows if i and __import__("zlib").crc32(str(i).encode()) % 5]
    x = m.features(np.array([counts(t) for _, t in kept], float))
    y = np.array([i % 2 for i, _ in kept])
    pooled = sum(((x[y == k] - x[y == k].mean(0)) ** 2).sum(0) for k in (0, 1)) / len(y) + 1e-6
    d = np.log(y.mean() / (1 - y.mean()))
    for k, sign in ((0, -1), (1, 1)):
        cov = 0.8 * np.cov(x[y == k].T, bias=True) + 0.2 * np.diag(pooled) + 1e-9 * np.eye(x.shape[1])
        z = x - x[y == k].mean(0)
        d = d + sign * (-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1])
    got = m.score(np.array([counts(t) for _, t in kept], float))
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(d, -500, 500))), atol=1e-6)


def test_quality_corner_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x " * 30000, "c"), (1, None, "a"), (3, "plain text here.", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_scores(docs, none).collect()] == [0.5] * 5
    one = spark.createDataFrame([(3, 1), (2, 1), (1, 1), (4, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(docs, one).collect()} == {1.0}
    assert sorted(map(tuple, keep_quality(docs, one).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert quality_scores(docs.limit(0), one).count() == 0
    # partitions without a labelled row
    spread = spark.range(40, numPartitions=8).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    few = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert quality_scores(spread, few).count() == 40
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(counts("a b")) == len(COUNTS) and isinstance(QualityModel(np.zeros(len(COUNTS)), 1, 0.5).score(np.zeros((2, len(COUNTS)))), np.ndarray)


def brute_phrases(learned, text):
    """Greedy longest matches by substring search, in the same segments."""
    n = 0
    for at in range(0, len(text), SEGMENT):
        seg, i = text[at:at + SEGMENT], 0
        while i < len(seg):
            j = i + 1
            while j <= len(seg) and seg[i:j] in learned:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


def test_phrases_match_substring_search():
    rnd = random.Random(2)
    learned = [("aa", "".join(rnd.choice("abc ") for _ in range(400))), ("bb", "".join(rnd.choice("abdé ") for _ in range(300)))]
    p = CrossParser(learn(tuple(learned)))
    texts = ["".join(rnd.choice("ABcdéz, x") for _ in range(rnd.randrange(1, 900))) for _ in range(40)]
    norm = lambda t: "".join(chr(c) if c else " " for c in letters(t))
    for t, h in zip(texts, p.entropies(texts)):
        x = norm(t)
        if not x.strip():
            assert h is None
            continue
        want = [brute_phrases(norm(text), x) * max(1, np.log2(len(norm(text)))) / len(x) for _, text in learned]
        assert np.allclose(h, want)


@pytest.mark.parametrize("kind", [DenseSteps, HashedSteps])
def test_automaton_knows_all_substrings(kind):
    step = kind(suffix_automaton(np.array([7, 9, 7, 7, 9, 2000])))  # numbered 0, 1, 0, 0, 1, 2
    one = lambda s, c: int(step(np.array([s], np.int32), np.array([c]))[0])
    known = lambda w: (s := 0) == 0 and all((s := one(s, c)) >= 0 for c in w)
    text = "010012"
    subs = {text[i:j] for i in range(6) for j in range(i + 1, 7)}
    for n in range(1, 7):
        for k in range(4 ** n):
            w = np.base_repr(k, 4).zfill(n)  # 3: a symbol that is not in the text
            assert known(map(int, w)) == (w in subs)


def test_large_alphabets_take_little_memory():
    """Three languages, one of 3,000 Han letters: tables under 200 MB, and the same entropies as dense ones have."""
    rnd = np.random.default_rng(5)
    han = lambda n: "".join(map(chr, 0x4E00 + (rnd.zipf(1.3, n) - 1) % 3000))
    latin = lambda letters_, n: " ".join("".join(rnd.choice(list(letters_), 5)) for _ in range(n // 6))
    learned = learn((("en", latin("etaoinshr", 40_000)), ("fr", latin("esaitnrulé", 40_000)), ("zh", han(40_000))))
    assert [len(e.symbols) > 1500 for _, _, e in learned] == [False, False, True]
    p = CrossParser(learned)
    tables = [x for s in p.steps for x in ([s.table] if isinstance(s, DenseSteps) else [s.keys, s.targets])]
    assert sum(t.nbytes for t in [*tables, *p.numbers]) < 60e6
    assert [type(s) for s in p.steps] == [DenseSteps, DenseSteps, HashedSteps]
    texts = [latin("etaoinshr", 300), latin("esaitnrulé", 300), han(300), "日本 and more", "", han(3000) + latin("eta", 400)]
    hashed = CrossParser(learned, dense_cells=0).entropies(texts)
    dense = CrossParser(learned, dense_cells=10 ** 9).entropies(texts)
    for a, b, c in zip(hashed, dense, p.entropies(texts)):
        assert (a is None and b is None and c is None) or ((a == b).all() and (b == c).all())
    assert p.predict(texts)[0][:3] == ["en", "fr", "zh"]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = predict_languages(docs.withColumn("lang_pred", F.lit(1))).join(docs, "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.98
    assert got["score"].between(0, 1).all()


def test_language_corner_cases(spark):
    rows = [(12, "the cat and the hat " * 20, "en"), (13, "der hund und das haus " * 20, "de"), (7, None, "en"), (7, "12 !! 3", None),
            (None, "the hat", None), (8, "und der hund", None), (8, "und der hund", None), (9, "😀 𝒜", None), (10, "", "de"),
            (11, "the cat and " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keep = [r for r in rows if r[2] and r[1]]
    assert all(__import__("zlib").crc32(str(r[0]).encode()) % 3 != 1 for r in keep)
    got = sorted(((r["doc_id"] or 0), r["lang_pred"]) for r in predict_languages(docs).collect())
    assert got == [(0, "en"), (7, "und"), (7, "und"), (8, "de"), (8, "de"), (9, "en"), (10, "und"), (11, "en"), (12, "en"), (13, "de")]
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert learned_texts(nothing) == () and {r["lang_pred"] for r in predict_languages(nothing).collect()} == {"und"}
    assert predict_languages(docs.limit(0)).count() == 0


def test_languages_of_copies_are_learned(spark):
    word = F.concat_ws(" ", *[F.concat(F.lit(w), F.col("copy").cast("string"), F.lit(w)) for w in ("der", "hund", "haus")])
    few = spark.range(6000).selectExpr("id AS doc_id", "id % 3 AS copy").select("doc_id", word.alias("text"), F.lit("de").alias("lang"))
    many = spark.range(6000, 6900).selectExpr("id AS doc_id", "concat('the cat ', id, ' hat') AS text", "'en' AS lang")
    got = dict(learned_texts(few.union(many)))
    assert sorted(got) == ["de", "en"]
    assert len(got["de"].split("\n")) == 3 and len(got["en"].split("\n")) == 200


def test_every_sampled_document_takes_part(spark):
    rows = [(i, f"{w}{w}{w} " * n, "en") for i, (w, n) in enumerate([("ab", 30000), ("cd", 30000), ("ef", 3), ("gh", 20), ("ij", 30000)] * 3)]
    rows.append((50, "start " + "x" * 60000 + " middle " + "y" * 60000 + " end", "de"))
    rows = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 3 != 1]
    present = {r[1][:2] for r in rows if r[2] == "en"}
    got = dict(learned_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert len(present) == 5 and all(p in got["en"] for p in present) and 39_000 < len(got["en"]) <= 40_100
    assert {"x", "y"} <= set(got["de"])
    small = dict(learned_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars_in_all=2000))
    assert all(p in small["en"] for p in present) and len(small["en"]) <= 1_100


@pytest.mark.parametrize("text", [None, "", "123", "Ä", "a1b", "  x"])
def test_letters(text):
    x = letters(text)
    assert ((x[1:] != 0) | (x[:-1] != 0)).all()
