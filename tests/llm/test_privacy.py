import hashlib
import random
import re
import time

import pytest

from folio.llm import privacy

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN:
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def texts(seed, n):
    r = random.Random(seed)
    alphabets = ["a.@-+1 20()9_%\né", "0123456789 -", "1.2.3.25 6+()"]
    out = ["".join(r.choice(a) for _ in range(r.randrange(1, 45))) for a in alphabets for _ in range(n)]
    out += ["4111 1111 1111 1111, a.b+c@x-y.co.uk; +1 (887) 555-2355", "x@y", "@a.b", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "000255.1.1.1", "256.1.1.1"]
    return out


def test_base_spans_equal_the_plain_patterns():
    for t in texts(1, 20_000):
        assert [s[:3] for s in privacy.base_spans(t)] == brute(t), t


@pytest.mark.parametrize("mark", ["a", "1", "1.", "1 ", "@", "a@", "+1 ", "+", "a@b.", "1-", "+1(", "9" * 5000 + ".1.1.1 "])
def test_long_texts_take_linear_time(mark):
    began = time.monotonic()
    privacy.base_spans(mark * (2_000_000 // len(mark)))
    assert time.monotonic() - began < 10


def test_scan_equals_brute_force(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts(2, 60))] + [(None, None, "x"), (1, "", None), (1, "a@b.c", "x"), (1, "a@b.c", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, personal string")
    got = privacy.scan(docs, privacy.disclosing(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r["text"])
        p = r["personal"]
        assert [(s["kind"], s["start"], s["end"]) for s in p["spans"] if s["kind"] in privacy.KINDS] == want
        assert [p[f"n_{k}"] for k in privacy.KINDS] == [sum(s[0] == k for s in want) for k in privacy.KINDS]
        assert p["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()


def planted(seed=3):
    """A person's name beside an address, a street beside a number, and words that say nothing."""
    r = random.Random(seed)
    words = [f"wort{k}é" for k in range(300)]

    def filler(n):
        return " ".join(r.choice(words) for _ in range(n))

    rows = [filler(40) for _ in range(300)]
    rows += [f"{filler(9)} Quimby {filler(2)} q.quimby@mail.example.com {filler(6)}" for _ in range(8)]
    rows += [f"{filler(9)} Zorblatt {filler(2)} +1 (887) 555-2355 {filler(6)}" for _ in range(8)]
    rows += [f"{filler(9)} Zorblatt {filler(9)}" for _ in range(4)]
    copy = f"{filler(9)} Copied {filler(2)} copied@mail.example.com {filler(6)}"
    rows += [copy] * 40  # one window, however often
    rows += [f"{filler(5)} office {filler(3)} write to info@example.org {filler(3)}" for _ in range(150)]  # no secret
    rows += [f"é {filler(20)} quimby says", f"{filler(5)}\nno\nZorblatt"]
    return [(k, t) for k, t in enumerate(rows)]


def test_terms_that_tell_an_entity_are_found_everywhere(spark, monkeypatch):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    told = privacy.disclosing(docs)
    got = {r["doc_id"]: r for r in privacy.scan(docs, told).collect()}
    kinds = {}
    for k, text in rows:
        added = [(s["kind"], text[s["start"] : s["end"]]) for s in got[k]["personal"]["spans"] if s["kind"] not in privacy.KINDS]
        for kind, term in added:
            kinds.setdefault(term.lower(), set()).add(kind)
        assert [t.lower() for _, t in added] == [w.lower() for w in re.findall(r"(?i)(?<![\w.@])(?:quimby|zorblatt)(?![\w@])", text)]
    assert kinds == {"quimby": {privacy.REMOVED}, "zorblatt": {privacy.GENERALISED}}
    for r in told.collect():
        assert abs(r["ic"] - r["pmi"]) <= privacy.DOUBT and r["in_both"] <= r["in_docs"]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(docs, told).collect()}
    assert not re.search(r"(?i)quimby|zorblatt|555-2355|@", " ".join(clean.values()))
    assert all(clean[k] == t for k, t in rows[:300])
    monkeypatch.setattr(privacy, "PASS_TERMS", 100)  # several passes
    again = privacy.disclosing(docs)
    monkeypatch.setattr(privacy, "PASS_TERMS", 1)
    again = privacy.scan(docs, again)
    assert {r["doc_id"]: r["personal"] for r in again.collect()} == {k: r["personal"] for k, r in got.items()}


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n int")
    assert privacy.scan(empty, privacy.disclosing(empty)).collect() == []
    nulls = spark.createDataFrame([(1, None, 2), (2, "", 3)], "doc_id bigint, text string, n int")
    assert [tuple(r) for r in privacy.sanitise(nulls).orderBy("doc_id").collect()] == [(1, None, 2), (2, "", 3)]
