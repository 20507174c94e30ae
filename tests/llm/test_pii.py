import hashlib
import random
import re

import pytest

from hitfeed.llm.pii_weak import LABELERS, PSEUDO, SpanModel, personal_data, redact

RND = random.Random(21)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text, out = text or "", []
    add = lambda k, m: out.append((k, m.start(), m.end()))
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        add("email", m)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            add("ip", m)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            add("card", m)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            add("phone", m)
    return out


def expected(rows):
    out = []
    for d, t, *_ in rows:
        b = base(t)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        out.append((d, *(sum(x[0] == k for x in b) for k in ("email", "ip", "card", "phone")), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_texts(n=500):
    bits = ["a.b", "@", "x-y", ".com", ".", "..", " ", "-", "+", "1", "12", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111",
            "+1 (832) 555-8455", "(", ")", "é", "😀", "_", "%", "\n", "10.0.0.1", "555", "0"]
    return ["".join(RND.choice(bits) for _ in range(RND.randrange(1, 16))) for _ in range(n)]


def test_base_spans_equal_brute_force(spark):
    texts = [None, "", *odd_texts(), "7" * 20000, "a@" * 3000, "a.b@c.d" * 500, "+1" + " " * 5000 + "x", "1.2.3.4." * 900]
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = [(i, t, 0) for i, t in enumerate(texts + docs)] + [(None, "a@b.c", 0), (1, "", 0), (1, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = personal_data(df).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == expected(rows)
    spans = {r["doc_id"]: r["spans"].split(",") for r in got if r["doc_id"] is not None}
    for d, t, _ in rows:  # the method adds, base spans stay
        if d is not None and d > 1:
            assert {f"{k}:{s}:{e}" for k, s, e in base(t)} <= set(spans[d])
    assert personal_data(df.limit(0)).count() == 0


CARDS = ["4601134817125505", "4451718024887799"]


def corpus():
    """Prose, ordinary personal data, and what the base patterns lose: a card that follows a phone, and the like."""
    rows = [(i, f"some words here and 47 more, version 4.0 of item {i}.") for i in range(150)]
    rows += [(200 + i, f"please call +1 (832) 555-{1000 + i} or mail me.{i}@mail{i}.example.com from 74.172.43.{i}") for i in range(60)]
    rows += [(300 + i, f"pay by card {CARDS[i % 2]} at once") for i in range(40)]
    rows += [(400, f"call +1 (314) 555-6532 {CARDS[0]} now"), (401, "call (312) 555-0143 today"),
             (402, "write to jane.doe [at] example [dot] com please"), (403, "iban GB82 WEST 1234 5698 7654 32 account"),
             (404, "order 4601134817125506 ships"), (405, "isbn 978-3-16-148410-0 page 100-200-3000"), (406, "model 123-456-7890123")]
    return rows


def test_weak_supervision_adds_what_the_patterns_lose(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data(df).collect()}
    assert got[400] == "card:23:39,phone:5:22"
    assert got[401] == "phone:5:19" and got[402].startswith("email:9:") and got[403] == "iban:5:32"
    assert [got[i] for i in range(150)] == [""] * 150
    assert got[404] == got[405] == got[406] == ""


def test_reliabilities_follow_the_votes():
    rows = [("card", "1,1,1,0,1", 900), ("card", "0,-1,0,-1,0", 300), ("phone", "1,1,0,1,1", 500), ("phone", "0,-1,0,-1,-1", 400)]
    m = SpanModel(rows)
    check = LABELERS.index("check")
    assert m.chance[1][check][2] > 0.95 and m.chance[0][check][0] > 0.9
    assert 0.5 < m.prior < 0.8
    assert SpanModel([]).chance[1][0][2] == pytest.approx(PSEUDO[1][2] / sum(PSEUDO[1]))


def test_redaction(spark):
    rows = [(*r, "x", len(r[1])) for r in corpus()] + [(999, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = redact(df)
    assert got.columns == df.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[400]["text"] == "call [PHONE] [CARD] now" and by[400]["n_chars"] == 23
    assert by[203]["text"] == "please call [PHONE] or mail [EMAIL] from [IP]"
    assert by[5]["text"] == rows[5][1] and by[999]["text"] is None


def test_overlapping_spans_are_redacted_whole(spark):
    iban = "GB08 WEST 1234 5698 7654 06"  # its digits after the letters pass Luhn
    assert luhn("12345698765406") and int("".join(str(int(c, 36)) for c in "WEST12345698765406GB08")) % 97 == 1
    rows = corpus() + [(900, "from 10.0.0.18 4111111111111111 paid"), (901, "to +4915112345678.anna@firma.de, please"),
                       (902, f"iban {iban} account"), (903, "10.0.0.18 and 4111111111111111")]
    by = {r["doc_id"]: r["text"] for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[900] == "from [IP+CARD] paid" and by[901] == "to [PHONE+EMAIL+CARD], please"
    assert by[902] == "iban [IBAN+CARD] account" and by[903] == "[IP] and [CARD]"
