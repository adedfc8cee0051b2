import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from folio.llm import lexical
from folio.llm.words import ALNUM, word_hashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Ünter", "ünter", "A1", "a1", "né"]

    def text(n):
        return " ".join(r.choice(words[: r.choice([20, 100, 405])]) + r.choice(["", ".", "-"]) for _ in range(n))

    docs = [(k, text(r.choice([1, 5, 40, 200]))) for k in range(400)]
    hot = text(12)
    docs += [(1000 + k, text(10) + "\n" + hot) for k in range(200)] + [(2000, "w1 " * 5000), (None, hot), (None, None), (2001, None), (2002, " .,"), (2003, "")]
    docs += [docs[0], docs[0], (7, "w3 w4")]
    items = [(1, hot), (2, text(6)), (3, "w1 w1 w2"), (4, None), (5, ""), (6, "unknown"), (7, "Ünter A1 né"), (7, "w9"), (8, "w5"), (8, "w5"), (9, text(80))]
    return docs, items


@pytest.mark.parametrize("seed, per_pass, bound", [(1, 500, 500_000), (2, 2, 5)])
def test_equals_brute_force(spark, monkeypatch, seed, per_pass, bound):
    monkeypatch.setattr(lexical, "PASS_ITEMS", per_pass)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", bound)
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, score int").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, rank int")
    got = Counter(tuple(r) for r in lexical.search(d, i, 20).select("item_id", "rank", "doc_id", "score").collect())
    assert got == Counter(brute(docs, items, 20))


def test_bounds_are_never_too_low_and_exclude_most():
    docs, items = corpus(5)
    texts = [t or "" for _, t in docs]
    n = sum(bool(terms(t)) for t in texts)
    total = sum(len(terms(t)) for t in texts)
    wanted = [t for _, t in items if t]
    names = np.unique(word_hashes(wanted, ALNUM)[0])
    df = np.array([sum(h in set(word_hashes([t], ALNUM)[0].tolist()) for t in texts) for h in names.tolist()])
    q = lexical.Queries(wanted, names, df, n, total)
    ids = np.arange(len(texts))
    bounds = np.zeros((len(wanted), len(texts)))
    for rows, packed, at, _, lengths in lexical.blocks_of(texts, ids, ids):
        bounds[:, np.frombuffer(at, np.int64)] = lexical.upper_bounds(q, rows, packed, np.frombuffer(lengths, np.int64))
    exact = np.zeros_like(bounds)
    for t, item, score in lexical.exact_scores(q, texts, [np.arange(len(wanted))] * len(texts)):
        exact[item, t] = score
    assert (bounds >= exact).all()
    low = np.sort(exact, axis=1)[:, -20][:, None]
    assert (bounds >= np.maximum(low, 1)).sum() < 0.5 * (bounds > 0).sum()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.withColumn("text", docs.text.substr(9, 1)), items).collect() == []
