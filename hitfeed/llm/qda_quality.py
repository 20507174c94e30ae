"""Quality classifier: regularised quadratic discriminant over document statistics.

Counts of a text (letters, symbols, lines, repeated words, ...) become logarithms of rates, each
pulled towards the corpus rate by a few pseudo-observations, so that short texts stay near
the ordinary.  Each class of labelled documents gets a mean and a covariance, shrunk towards the
pooled variances.  The score is the sigmoid of the difference of the two Mahalanobis log
densities and priors, from cached inverse Cholesky factors.

All labelled rows are learned from (sums and products are added up on the executors; only
they reach the driver).  Inputs of a score are counts of its text alone.

Defined cases: null and empty texts are scored as a text without observations; repeated rows get
the same score; documents with contradictory labels are not learned from; without rows of both
classes the score is the share of class 1 (0.5 without labels); very long texts are counted whole; extra columns are
ignored by the query and kept by :func:`keep_quality`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hitfeed.llm.common import id_text, map_texts, materialize

SYMBOLS = b"#$%&*@^~|<>{}[]=+_\\/"
STOPS = b".,;:?!'\"()-"
LOWER, UPPER, DIGITS = bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789"
HIGH = bytes(range(128, 256))

#: (name, numerator, denominator, pseudo-observations for each word of ``pull``)
RATES = [
    ("word_length", "word_bytes", "words", 1), ("word_square", "word_squares", "words", 1),
    ("longest", "longest", "root_words", 0.25), ("capitals", "upper", "letters", 4), ("digits", "digits", "bytes", 4),
    ("symbols", "symbols", "bytes", 4), ("stops", "stops", "words", 1), ("shouts", "shouts", "words", 1),
    ("high", "high", "bytes", 4), ("lines", "lines", "words", 1), ("adjacent", "adjacent", "words", 1),
    ("repeats", "repeats", "words", 1), ("commonest", "commonest", "words", 1), ("same_lines", "same_lines", "lines", 0.25),
    ("led", "led", "words", 1),
]
COUNTS = ["words", "root_words", "bytes", "word_bytes", "word_squares", "longest", "upper", "letters", "digits", "symbols",
          "stops", "shouts", "high", "lines", "adjacent", "repeats", "commonest", "same_lines", "led"]


def counts(text: str | None) -> list[float]:
    """What is counted in a text, in the order of COUNTS."""
    b = (text or "").encode("utf-8")
    held = lambda chars: len(b) - len(b.translate(None, chars))
    words = b.split()
    n = len(words)
    seen = Counter(words)
    lines = b.split(b"\n")
    sizes = np.fromiter(map(len, words), np.float64, n)
    upper = held(UPPER)
    return [n, n ** 0.5, len(b), float(sizes.sum()), float(sizes @ sizes), float(sizes.max(initial=0)), upper,
            upper + held(LOWER), held(DIGITS), held(SYMBOLS), held(STOPS), b.count(b"!"), held(HIGH), len(lines),
            sum(map(bytes.__eq__, words, words[1:])), n - len(seen), max(seen.values(), default=0),
            len(lines) - len(set(lines)), sum(w[:1].isupper() for w in words)]


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) of every document."""
    def of(texts):
        return [pa.array([list(map(float, counts(t))) for t in texts], pa.list_(pa.float64()))]

    return map_texts(docs, lambda: of, "counts array<double>")


@dataclass(frozen=True)
class QualityModel:
    totals: np.ndarray  # corpus sums of COUNTS
    pull: float
    prior: float  # share of class 1
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None  # inverse Cholesky factors

    def features(self, c: np.ndarray) -> np.ndarray:
        at = {name: i for i, name in enumerate(COUNTS)}
        out = [np.log1p(c[:, at["words"]])]
        for _, top, bottom, weight in RATES:
            a, b = c[:, at[top]], c[:, at[bottom]]
            rate = (self.totals[at[top]] + 0.5) / (self.totals[at[bottom]] + 1)
            out.append(np.log((a + weight * self.pull * rate) / (b + weight * self.pull)))
        return np.column_stack(out)

    def score(self, c: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(c), self.prior)
        x = self.features(c)
        density = []
        for mean, inverse in zip(self.means, self.factors):
            z = (x - mean) @ inverse.T
            density.append(np.log(np.diag(inverse)).sum() - 0.5 * (z * z).sum(axis=1))
        d = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(id_text(doc_id)) % folds == 0


def fit_quality(stored: DataFrame, labels: DataFrame, pull: float = 40.0, shrinkage: float = 0.1) -> QualityModel:
    """Learn from the stored counts of the labelled documents outside the held-out fold."""
    total = stored.agg(*[F.sum(F.col("counts")[i]).alias(c) for i, c in enumerate(COUNTS)]).first()
    totals = np.array([v or 0.0 for v in total])
    plain = QualityModel(totals, pull, 0.5)
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    learn = stored.join(known, "doc_id").filter(~held_out(F.col("doc_id"))).select("quality", "counts")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for b in batches:
            if len(b):
                x = plain.features(np.vstack(b["counts"]))
                for q in (0, 1):
                    one = np.hstack([np.ones(((b["quality"] == q).sum(), 1)), x[b["quality"] == q]])
                    sums[q] = sums.get(q, 0) + one.T @ one
        if sums:
            yield pd.DataFrame({"quality": list(sums), "sums": [s.reshape(-1) for s in sums.values()]})

    rows = (learn.mapInPandas(products, "quality int, sums array<double>")
            .select("quality", F.posexplode("sums")).groupBy("quality", "pos").agg(F.sum("col").alias("s")).collect())
    size = len(RATES) + 2
    sums = np.zeros((2, size * size))
    for r in rows:  # 2 x size x size rows
        sums[r["quality"], r["pos"]] = r["s"]
    sums = sums.reshape(2, size, size)
    n = sums[:, 0, 0]
    if not n.all():
        return QualityModel(totals, pull, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [s[0, 1:] / s[0, 0] for s in sums]
    scatter = [s[1:, 1:] - s[0, 0] * np.outer(m, m) for s, m in zip(sums, means)]
    pooled = np.diag(sum(scatter)) / n.sum() + 1e-6
    factors = []
    for s, k in zip(scatter, n):
        cov = (1 - shrinkage) * s / k + shrinkage * np.diag(pooled) + 1e-9 * np.eye(size - 1)
        factors.append(np.linalg.inv(np.linalg.cholesky(cov)))
    return QualityModel(totals, pull, float(n[1] / n.sum()), tuple(means), tuple(factors))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    stored = materialize(document_counts(docs), "quality")
    model = fit_quality(stored, labels)

    @F.pandas_udf("double")
    def score(c: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(c)) if len(c) else [], dtype="float64")

    return stored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("counts").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least ``threshold``, unchanged (no shuffle of texts).

    Texts are counted once: the documents are stored with their counts, from which the model learns and scores."""
    @F.pandas_udf("array<double>")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, counts(t))) for t in text], dtype="object")

    stored = materialize(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", count("text").alias("counts")), "quality-documents")
    model = fit_quality(stored.select("doc_id", "counts"), labels)

    @F.pandas_udf("boolean")
    def good(c: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(c)) >= threshold if len(c) else [], dtype="bool")

    return stored.filter(good("counts")).select("row.*")
