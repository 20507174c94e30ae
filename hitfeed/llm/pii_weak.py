"""Personal data by weak supervision, without Python.

Base spans come from fixed patterns and their checks.  Candidates are these spans and looser ones
(numbers that stand in a longer run, unprefixed phones, obfuscated addresses, account and
social-security numbers).  Five labelers vote +1, 0 or -1 on each candidate:

* ``form``: a regular expression of the kind's strict form,
* ``check``: check digits and value ranges,
* ``gazetteer``: issuer prefixes, country codes and top-level domains,
* ``context``: words before the span that speak for or against,
* ``alone``: whether the span is a word of its own.

Expectation-maximisation estimates the reliability of each labeler (chance of each vote for true and
for false candidates) from the counts of vote patterns, a table of bounded size.  The posteriors train
the final classifier, a naive Bayes model with reliabilities by kind that fall back to those of all kinds.
A loose candidate becomes a span if its posterior reaches ``accept`` and its kind's check does not
speak against it; base spans always stay.

Defined cases: a null text is an empty one; repeated rows get the same spans, and each counts in
the estimates; spans are ordered by kind as listed, then start; without candidates the priors stand; very long texts are
searched whole; extra columns are ignored by the query and kept by :func:`redact`, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from hitfeed.llm.common import materialize
from hitfeed.llm.spans import let, span_text, spans

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
LABELERS = ("form", "check", "gazetteer", "context", "alone")

# fixed values: the base patterns.  A match starts where its run of characters starts, so that no
# position within a run is tried again.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# without one of these there is no loose match
LOOSE_HINT = {"email": r"(?i)[\[(]at[\])]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}

STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{2,4}[\x20.-][0-9]{3,4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){3,7}(?:\x20[A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
}
GAZETTEER = {
    "email": r"(?i)[.\])\x20](?:com|org|net|edu|gov|int|io|info|biz|de|fr|es|it|uk|us|eu|nl|ch|at|be|pl|pt|se|no|dk|fi|ie|ca|au|nz|br|mx|ar|jp|cn|in|ru)$",
    "ip": r"^(?!0\.|127\.|169\.254\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6011|6[245])",
    "phone": r"^\+?\(?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})[\x20().-]",
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)",
    "ssn": r"^(?!000|666|9)",
}
FOR = (r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|reach|mail|e-mail|email|write|card|visa|mastercard|credit|iban|account|"
       r"ssn|social|security|ip|address|host|telefon|téléphone|teléfono|anruf|courriel|correo|konto|compte|cuenta)\b")
AGAINST = (r"(?i)\b(?:version|v|release|isbn|issn|order|invoice|page|pages|pp|ref|serial|figure|fig|table|section|chapter|sku|build|doi|"
           r"item|part|model|lot)\b")
NEAR = 40

#: Pseudo-counts of the votes (-1, 0, +1) of a labeler on false and true candidates: they fix which class is which.
PSEUDO = ((8.0, 4.0, 1.0), (1.0, 4.0, 8.0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def base_spans(text: Column) -> list[Column]:
    some = lambda x: F.contains(text, F.lit(x))
    return [
        spans(text, EMAIL, "email", 0, hint=some("@")),
        spans(text, IP, "ip", 1, lambda m, _: F.rlike(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))),
        spans(text, CARD, "card", 2, lambda m, _: luhn(digits(m))),
        spans(text, PHONE, "phone", 3, lambda m, _: F.length(digits(m)).between(9, 15), hint=some("+")),
    ]


def loose_spans(text: Column) -> list[Column]:
    return [spans(text, p, kind, KINDS.index(kind), hint=F.rlike(text, F.lit(LOOSE_HINT[kind])) if kind in LOOSE_HINT else None)
            for kind, p in LOOSE.items()]


def by_kind(kind: Column, of: dict) -> Column:
    """The value of ``of`` for a kind; 0 for a kind that it lacks."""
    out = F.lit(0)
    for k, v in of.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def vote(true: Column, false: Column | None = None) -> Column:
    """+1 if ``true``, -1 if ``false`` (not ``true``, where None), else 0."""
    other = F.lit(-1) if false is None else F.when(false, -1).otherwise(0)
    return F.coalesce(F.when(true, 1).otherwise(other), F.lit(0))


def mod_97(iban: Column) -> Column:
    """Remainder of the rearranged account number, letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def add(r: Column, c: Column) -> Column:
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(c == "", r).when(n < 10, (r * 10 + n) % 97).otherwise((r * 100 + n) % 97)

    return F.aggregate(turned, F.lit(0), add)


def votes(text: Column, s: Column) -> dict[str, Column]:
    """The labelers' votes on one candidate."""
    m, kind = s["match"], s["kind"]
    like = lambda patterns: by_kind(kind, {k: vote(F.rlike(m, F.lit(p)), F.lit(False)) for k, p in patterns.items()})
    d = digits(m)
    last10 = F.substring(d, -10, 10)
    before = F.substring(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(NEAR)).cast("int"))
    around = F.concat(F.substring(text, s["start"].cast("int"), F.when(s["start"] > 0, 1).otherwise(0)),
                      F.substring(text, s["end"].cast("int") + 1, F.lit(1)))
    return {
        "form": like(STRICT),
        "check": by_kind(kind, {
            "email": vote(~F.rlike(m, F.lit(r"\.\.|^[.]|[.]@|-$"))), "ip": F.lit(1), "card": vote(luhn(d)),
            "phone": vote(F.length(d).between(10, 15) & (~F.rlike(d, F.lit("^(?:1[0-9]{10}|[0-9]{10})$"))
                                                         | F.rlike(last10, F.lit("^[2-9][0-9]{2}[2-9][0-9]{6}$")))),
            "iban": vote(mod_97(m) == 1), "ssn": vote(F.rlike(m, F.lit("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")))}),
        "gazetteer": like(GAZETTEER),
        "context": vote(F.rlike(before, F.lit(FOR)) & ~F.rlike(before, F.lit(AGAINST)), F.rlike(before, F.lit(AGAINST))),
        "alone": vote(~F.rlike(around, F.lit(r"[\p{L}\p{N}_/=#-]"))),
    }


def voted(text: Column, found: Column) -> Column:
    """(rank, start, kind, end, votes) of each span."""
    return F.transform(found, lambda s: F.struct(
        s["rank"].alias("rank"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.concat_ws(",", *[v.cast("string") for v in votes(text, s).values()]).alias("votes")))


def with_candidates(docs: DataFrame, *more: Column) -> DataFrame:
    """``more`` columns, and ``base`` and ``loose``: voted spans of the base patterns, and loose ones that lie in none of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*more, text.alias("whole_text"), F.concat(*base_spans(text)).alias("base"), F.concat(*loose_spans(text)).alias("loose"))
    free = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    rows = rows.withColumn("loose", free)
    found = [F.array_sort(voted(F.col("whole_text"), F.col(c))).alias(c) for c in ("base", "loose")]
    return rows.select(*[c for c in rows.columns if c not in ("whole_text", "base", "loose")], *found)


class SpanModel:
    """Reliabilities by EM over the vote patterns, and the naive Bayes classifier that they train."""

    def __init__(self, patterns: list[tuple[str, str, int]], rounds: int = 40):
        rows = [(kind, tuple(map(int, v.split(","))), n) for kind, v, n in patterns]
        posterior = [1.0 if sum(v) > 0 else 0.0 for _, v, _ in rows]  # majority vote
        for _ in range(rounds):
            self.prior, self.chance = self._maximise(rows, posterior)
            posterior = [self._posterior(self.prior, self.chance, v) for _, v, _ in rows]
        # the classifier: reliabilities by kind, the pooled ones being worth ten candidates
        self.by_kind = {}
        for kind in KINDS:
            own = [(r, p) for r, p in zip(rows, posterior) if r[0] == kind]
            pooled = [[[10 * x for x in c] for c in y] for y in self.chance]
            self.by_kind[kind] = self._maximise([r for r, _ in own], [p for _, p in own], pooled, 10 * self.prior, 10)

    @staticmethod
    def _maximise(rows, posterior, pseudo=None, true=1.0, all_=2.0):
        pseudo = pseudo or [[list(PSEUDO[y]) for _ in LABELERS] for y in (0, 1)]
        n = [[list(c) for c in y] for y in pseudo]
        for (_, v, count), p in zip(rows, posterior):
            true, all_ = true + p * count, all_ + count
            for j, x in enumerate(v):
                n[1][j][x + 1] += p * count
                n[0][j][x + 1] += (1 - p) * count
        return true / all_, [[[x / sum(c) for x in c] for c in y] for y in n]

    @staticmethod
    def _log_odds(prior, chance, v):
        odds = log(max(prior, 1e-9)) - log(max(1 - prior, 1e-9))
        return odds + sum(log(chance[1][j][x + 1] / chance[0][j][x + 1]) for j, x in enumerate(v))

    def _posterior(self, prior, chance, v):
        return 1 / (1 + exp(-max(-500.0, min(500.0, self._log_odds(prior, chance, v)))))

    def score(self, kind: Column, votes: Column) -> Column:
        """Log odds of a candidate as a column."""
        table = {k: F.array(*[F.array(*[F.lit(log(c[1][j][x] / c[0][j][x])) for x in range(3)]) for j in range(len(LABELERS))])
                 for k, (_, c) in self.by_kind.items()}
        prior = {k: F.lit(self._log_odds(p, c, ())) for k, (p, c) in self.by_kind.items()}
        v = F.transform(F.split(votes, ","), lambda x: x.cast("int"))
        logs = F.coalesce(*[F.when(kind == k, t) for k, t in table.items()])
        start = F.coalesce(*[F.when(kind == k, t) for k, t in prior.items()])
        return let(logs, lambda t: F.aggregate(F.transform(v, lambda x, j: t[j][x + 1]), start, lambda a, x: a + x))


def fit_spans(candidates: DataFrame) -> SpanModel:
    """Learn from ``base`` and ``loose`` of :func:`with_candidates`; at most 6 x 3^5 rows reach the driver."""
    rows = (candidates.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.kind", "s.votes").count()
            .orderBy("kind", "votes").collect())
    return SpanModel([tuple(r) for r in rows])


def accepted(model: SpanModel, accept: float) -> Column:
    """All spans: the base ones, and the loose ones that the classifier accepts; by kind, then start."""
    least = log(accept / (1 - accept))
    check = LABELERS.index("check")
    added = F.filter("loose", lambda s: (F.split(s["votes"], ",")[check] != "-1")
                     & F.coalesce(model.score(s["kind"], s["votes"]) >= least, F.lit(False)))
    return F.array_sort(F.concat("base", added))


def personal_spans(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """(doc_id, base, found): arrays of base spans and of all spans."""
    stored = materialize(with_candidates(docs, F.col("doc_id")), "pii")
    return stored.select("doc_id", "base", accepted(fit_spans(stored), accept).alias("found"))


def personal_data(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """Counts and digest of the base spans and the text of all spans of every document."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_spans(docs, accept).select("doc_id", *map(of, BASE_KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                                               span_text(F.col("found")).alias("spans"))


def redact(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """The documents with every span of personal data replaced by its kind in brackets.

    Spans that overlap are replaced as one, from the first start to the last end, by all their kinds
    (``[IP+CARD]``).  ``n_chars``, where there is one, follows the new text.  The patterns run once: the documents are
    stored with their candidates, from which the model learns and the spans are chosen.
    """
    candidates = materialize(with_candidates(docs, F.struct(*docs.columns).alias("row")), "pii-documents")
    model = fit_spans(candidates)
    found = F.array_sort(F.transform(accepted(model, accept), lambda s: F.struct(
        s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.array(s["kind"]).alias("kinds"))))
    empty = F.array().cast("array<struct<start:int,end:int,kinds:array<string>>>")
    at_end = lambda a: F.try_element_at(a, F.lit(-1))
    last = lambda a: F.coalesce(at_end(a)["end"], F.lit(0))
    joined = lambda a, s: F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
        at_end(a)["start"].alias("start"), F.greatest(last(a), s["end"]).alias("end"),
        F.array_union(at_end(a)["kinds"], s["kinds"]).alias("kinds"))))
    apart = F.aggregate(found, empty, lambda a, s: F.when(s["start"] >= last(a), F.concat(a, F.array(s))).otherwise(joined(a, s)))
    rows = candidates.select("row", F.col("row.text").alias("text"), apart.alias("apart"))
    end = lambda i: F.when(i > 0, F.col("apart")[i - 1]["end"]).otherwise(0)
    pieces = F.transform("apart", lambda s, i: F.concat(
        F.substring(F.col("text"), end(i) + 1, s["start"] - end(i)), F.lit("["), F.upper(F.array_join(s["kinds"], "+")), F.lit("]")))
    rest = F.substring(F.col("text"), last(F.col("apart")) + 1, F.length("text"))
    changed = F.size("apart") > 0
    rows = rows.select("row", changed.alias("changed"), F.when(changed, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")).alias("text"))
    own = lambda c: F.col("row").getField(c)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return rows.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
