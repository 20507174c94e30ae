"""Secret scan: fixed patterns and a battery of randomness tests, without Python.

Base spans come from patterns (assignments, access keys, long hexadecimal runs).  The battery looks
at every other long run of key characters: an encoding is inferred from the characters that occur
(decimal, hexadecimal, upper- or lower-case base 36, base 64), and in that encoding

* a chi-squared test of alphabet uniformity,
* a runs test (above and below the middle of the alphabet),
* a lag-one serial correlation test,
* a test of sequences: steps that repeat at some lag, as in counters

must not reject randomness; a run that fails one has no evidence for it at all.  Evidence against the other
explanation, names (words, identifiers, paths, numbers), is a likelihood ratio: bits of the run under a model
of names less its bits as random symbols of its encoding.  The model has the corpus's own letter pairs (of
all words of all documents) and fixed chances of changes between lower case, upper case, digits and
separators, where a new word may begin.  Under the model a ratio of b bits has a chance of at most 2^-b,
whatever the length (Markov's inequality), which is the run's tail; a short run needs more per
character.  The false-discovery rate is then held at ``fdr`` within each length class (Benjamini-Hochberg
over all candidates of the corpus, from a histogram of the tails).

Defined cases: a null text is an empty one; repeated rows get the same spans, and each counts as a
candidate; ties of position are ordered by kind as listed; runs of a text are scanned whole, however
long (the cost is linear); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import log2, log10

from pyspark.sql import Column, DataFrame, functions as F

from hitfeed.llm.common import materialize
from hitfeed.llm.spans import let, span_text, spans

KINDS = ("assign", "access", "hex", "random")
# fixed values: the base patterns
ASSIGN = r"""((?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Key characters that a run must have for the battery to look at it, and symbols without separators that it judges.
LEAST = 16


#: A word to learn letter pairs from: lower case, with a capital at most, and not a part of a run of key characters.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{0,63}+(?![A-Za-z0-9+/_=-])"


def run_pattern(least: int) -> str:
    return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}+"


# fixed values: how often, in names, lower case, upper case, digits and separators (rows: what stands before; the first
# row: nothing) are followed by each other; letters of European prose, per thousand, which stand for 2,000 letter
# pairs where the corpus has few
KIND_STEPS = ((0.45, 0.35, 0.10, 0.10), (0.72, 0.15, 0.06, 0.07), (0.45, 0.33, 0.12, 0.10), (0.20, 0.25, 0.38, 0.17), (0.45, 0.25, 0.15, 0.15))
LETTERS_PER_1000 = (82, 15, 33, 43, 140, 15, 18, 30, 74, 3, 6, 42, 27, 73, 63, 23, 5, 67, 68, 78, 33, 11, 12, 3, 11, 5)
PRIOR_PAIRS = 2000
#: Share of letters in names that follow no pairs of the corpus (abbreviations).
FREE_LETTERS = 0.2
#: Randomness is rejected above this normal deviate (about one in a thousand).
REJECT = 3.1
#: Lags at which repeated steps are looked for.
LAGS = 8
#: Bins of -log10 of a tail, and their width.
BIN, MOST = 0.25, 160

LOWER, UPPER, DIGITS, SEPARATORS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_="
SYMBOLS = LOWER + UPPER + DIGITS + SEPARATORS
ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 36: "0123456789abcdefghijklmnopqrstuvwxyz",
             64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    found = F.concat(
        spans(text, ASSIGN, "assign", 0, lambda m, part: F.length(part) >= 8, group=3),
        spans(text, ACCESS, "access", 1, hint=F.contains(text, F.lit("AKIA"))),
        spans(text, HEX, "hex", 2))
    return F.array_sort(found)


def symbols_of(match: Column) -> Column:
    """(size of the inferred alphabet, numbers of the symbols in it), without separators."""
    plain = F.regexp_replace(match, "[-_=]", "")
    fold = (F.when(F.rlike(plain, F.lit("^[0-9]*$")), F.lit(10)).when(F.rlike(plain, F.lit("^([0-9a-f]*|[0-9A-F]*)$")), F.lit(16))
            .when(F.rlike(plain, F.lit("^([0-9a-z]*|[0-9A-Z]*)$")), F.lit(36)).otherwise(F.lit(64)))
    letters = F.create_map(*[x for k, a in ALPHABETS.items() for x in (F.lit(k), F.lit(a))])
    return let(fold, lambda k: let(F.when(k == 64, plain).otherwise(F.lower(plain)), lambda s: F.struct(
        k.alias("k"), F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(letters[k], c)).alias("x"))))


def letter_pairs(docs: DataFrame) -> list[list[float]]:
    """27 x 26 chances of a letter after a letter (row 0: at the start of a word), from all words of all documents.

    Words are added up first; their pairs, at most 27 x 26 rows, reach the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).groupBy("w").count()
    at = F.explode(F.sequence(F.lit(1), F.length("w")))
    code = lambda i: F.ascii(F.substring(F.col("w"), i, F.lit(1))) - 96
    pairs = words.select("w", "count", at.alias("i")).select(
        F.when(F.col("i") > 1, code(F.col("i") - 1)).otherwise(0).alias("a"), code(F.col("i")).alias("b"), "count")
    found = pairs.groupBy("a", "b").agg(F.sum("count").alias("n")).collect()
    n = [[0.0] * 26 for _ in range(27)]
    for r in found:
        n[r["a"]][r["b"] - 1] = float(r["n"])
    total = sum(LETTERS_PER_1000)
    return [[(c + PRIOR_PAIRS * p / total) / (sum(row) + PRIOR_PAIRS) for c, p in zip(row, LETTERS_PER_1000)] for row in n]


def name_bits(pairs: list[list[float]]) -> list[float]:
    """Bits of each symbol after each symbol (row 0: at the start of a run) under the model of names; a separator has none.

    An array of (1 + symbols) x symbols, row by row."""
    def kind(c: str) -> int:
        return 1 + next(i for i, s in enumerate((LOWER, UPPER, DIGITS, SEPARATORS)) if c in s)

    out = []
    for before in ["", *SYMBOLS]:
        k = kind(before) if before else 0
        for c in SYMBOLS:
            to = kind(c)
            if to == 4 and c not in "+/":
                out.append(0.0)
                continue
            p = KIND_STEPS[k][to - 1]
            if to <= 2:  # a word goes on within lower case, after its capital, and within capitals
                goes_on = (k, to) in ((1, 1), (2, 1), (2, 2))
                pair = pairs[1 + LOWER.index(before.lower()) if goes_on else 0][LOWER.index(c.lower())]
                p *= (1 - FREE_LETTERS) * pair + FREE_LETTERS / 26
            else:
                p /= 10 if to == 3 else len(SEPARATORS)
            out.append(-log2(p))
    return out


def bits_table(pairs: list[list[float]]) -> Column:
    return F.expr("array(" + ", ".join(f"{x:.4f}D" for x in name_bits(pairs)) + ")")


def bits_as_a_name(match: Column, table: Column) -> Column:
    """Bits of a run under the model of names."""
    codes = F.transform(F.filter(F.split(match, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    n = len(SYMBOLS)
    return let(codes, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.lit(0.0), lambda total, i: total + table[
        F.when(i > 0, x[i - 1]).otherwise(0) * n + x[i] - 1]))


def repeated_steps(x: Column, k: Column) -> Column:
    """Whether at some lag more steps equal the one before them than random symbols would have."""
    def excess(lag: Column) -> Column:
        same = F.aggregate(F.sequence(lag + 1, F.size(x) - 1), F.lit(0.0), lambda n, i: n + F.when(
            x[i] - x[i - lag] == x[i - 1] - x[i - 1 - lag], 1.0).otherwise(0.0))
        mean = (F.size(x) - 1 - lag) / k
        return same > mean + 2 * REJECT * F.sqrt(mean) + 2
    return F.exists(F.sequence(F.lit(1), F.least(F.lit(LAGS), F.size(x) - 3)), excess)


def battery(match: Column, table: Column, least: int = LEAST) -> Column:
    """(-log10 tail under the model of names, whether randomness is not rejected) of one run; a tail of 0 where it is."""
    plain = F.regexp_replace(match, "[-_=]", "")

    def judge(s: Column) -> Column:
        k, x = s["k"].cast("double"), s["x"]
        n = F.size(x).cast("double")
        plus = lambda a, v: a + v
        total = lambda xs: F.aggregate(xs, F.lit(0.0), plus)
        # the counts of each symbol, from what is left without it: linear in the length
        text = F.when(s["k"] == 64, plain).otherwise(F.lower(plain))
        counts = F.transform(F.split(F.lit(ALPHABETS[64]), ""), lambda c: F.when(
            c != "", F.length(text) - F.length(F.replace(text, c, F.lit("")))).otherwise(0))
        squares = total(F.transform(counts, lambda v: v.cast("double") * v))
        pairs = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.struct(x[i - 1].alias("a"), x[i].alias("b")))

        def tests(squares: Column, pairs: Column, mean: Column) -> Column:
            chi = k / n * squares - n
            spread = 2 / (9 * (k - 1))
            z_uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), 1 / 3) - (1 - spread)) / F.sqrt(spread)
            low = total(F.transform(x, lambda v: F.when(v <= k / 2, 1.0).otherwise(0.0)))
            runs = 1 + total(F.transform(pairs, lambda p: F.when((p["a"] <= k / 2) != (p["b"] <= k / 2), 1.0).otherwise(0.0)))
            both = 2 * low * (n - low)
            z_runs = (runs - 1 - both / n) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
            var = total(F.transform(x, lambda v: F.pow(v - mean, 2.0)))
            serial = total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))) / F.greatest(var, F.lit(1e-9))
            z_serial = serial * F.sqrt(n)
            random = ((z_uniform <= REJECT) & (F.abs(z_runs) <= REJECT) & (F.abs(z_serial) <= REJECT)
                      & ~F.coalesce(repeated_steps(x, k), F.lit(False)))
            # one of four encodings was chosen by the run itself: two bits
            bits = bits_as_a_name(match, table) - n * F.log2(k) - 2
            evidence = random & (bits > 0) & (k > 10)  # digits alone are a number
            return F.struct(F.when(evidence, bits * log10(2)).otherwise(0.0).alias("tail"), random.alias("random"))

        judged = let(squares, lambda q: let(pairs, lambda p: let(total(x) / n, lambda m: tests(q, p, m))))
        return F.when(F.size(x) >= least, judged).otherwise(F.struct(F.lit(0.0).alias("tail"), F.lit(False).alias("random")))

    return let(symbols_of(match), judge)


def length_class(size: Column) -> Column:
    """Lengths doubling from class to class in half steps."""
    return F.floor(2 * F.log2(size.cast("double"))).cast("int")


def scan(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, base, runs): spans of the patterns, and every judged run that no base span covers."""
    table = bits_table(letter_pairs(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", base_spans(text).alias("base"), spans(text, run_pattern(least), "random", 3).alias("found"))
    free = F.filter("found", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    judged = F.transform(F.col("free"), lambda r: let(battery(r["match"], table, least), lambda j: F.struct(
        r["start"].alias("start"), r["rank"].alias("rank"), r["kind"].alias("kind"), r["end"].alias("end"),
        length_class(r["end"] - r["start"]).alias("length_class"), j["tail"].alias("tail"), j["random"].alias("random"))))
    return rows.withColumn("free", free).select("doc_id", F.transform("base", lambda s: s.dropFields("match", "part")).alias("base"),
                                                judged.alias("runs"))


def tail_limits(scanned: DataFrame, fdr: float) -> dict[int, float]:
    """Least -log10 tail of a discovery in each length class: Benjamini-Hochberg over a histogram."""
    at = F.least(F.lit(MOST), F.floor(F.col("r.tail") / BIN)).cast("int")
    bins = (scanned.select(F.explode("runs").alias("r")).groupBy(F.col("r.length_class").alias("c"), at.alias("bin"))
            .agg(F.count("*").alias("n")).collect())  # classes x bins
    limits = {}
    for c in {b["c"] for b in bins}:
        own = {b["bin"]: b["n"] for b in bins if b["c"] == c}
        m, above = sum(own.values()), 0
        for i in sorted(own, reverse=True):
            above += own[i]
            if i and 10 ** (-i * BIN) * m <= fdr * above:  # all runs of the bin have a tail of 10^-(i BIN) at most
                limits[c] = i * BIN
    return limits


def secret_spans(docs: DataFrame, fdr: float = 0.01, least: int = LEAST) -> DataFrame:
    """(doc_id, base, found): arrays of spans of the patterns, and those with the battery's discoveries."""
    scanned = materialize(scan(docs, least), "secrets")
    limits = tail_limits(scanned, fdr)
    table = (F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits
             else F.lit(None).cast("map<int,double>"))
    added = F.filter("runs", lambda r: r["random"] & F.coalesce(r["tail"] >= table[r["length_class"]], F.lit(False)))
    added = F.transform(added, lambda r: r.dropFields("length_class", "tail", "random"))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))


def secrets(docs: DataFrame, fdr: float = 0.01, least: int = LEAST) -> DataFrame:
    """Counts and digest of the base spans and the text of all spans of every document."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(docs, fdr, least).select("doc_id", *map(of, KINDS[:3]), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                                          span_text(F.col("found")).alias("spans"))
