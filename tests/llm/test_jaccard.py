import random
import re

import numpy as np
import pytest

from folio.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed: int):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    line = " ".join(r.choice(words) for _ in range(12))
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 6, 20, 60, 120]))]
        for _ in range(r.choice([1, 2, 4, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words).upper() if r.random() < 0.3 else r.choice(words)
            text = " ".join(w)
            rows.append((n, text + " \n\t" + line if r.random() < 0.4 else text))
            n += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # several blocks in a cluster
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_threshold_is_inclusive(spark):
    # 7 shingles in common of 8 + 8 - 7 = 9 do link; 6 of 10 don't; 3 of 4 do (exactly 0.75)
    a = "a b c d e f g h i j k l"
    rows = [(1, a), (2, a[:-1] + "z"), (5, "p q r s t u v w"), (6, "p q r s t u v"), (8, "one two"), (9, "ONE  two"), (10, "one two three")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}
    assert got[2] == 1 and got[6] == 5 and got[9] == 8 and got[10] == 10


def test_nulls_repeats_and_extra_columns(spark):
    long = " ".join(f"x{k}" for k in range(3000))
    rows = [(3, long, 1), (3, long, 1), (4, long + " y", 1), (None, long, 1), (None, None, 1), (5, None, 1), (6, "", 1), (7, " \n", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect())
    assert [(g[0][1], g[1], g[2]) for g in got if not g[0][0]] == [(3, 2996, 3), (3, 2996, 3), (4, 2997, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7)]
    assert sorted((g[1], g[2]) for g in got if g[0][0]) == [(0, None), (2996, None)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 5), (False, 6), (False, 7), (True, 0), (True, 0)]


@pytest.mark.parametrize("least", [1, 1000])
def test_a_line_in_half_of_the_documents(spark, monkeypatch, least):
    """Its shingles are heavy; the components are those of brute force, and no group of a fragment
    has as many entries as there are documents with the line."""
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", least)
    r = random.Random(14)
    line = " ".join(f"license{k}" for k in range(12))
    rows = []
    for k in range(300):
        body = " ".join(f"w{r.randrange(5000)}" for _ in range(r.choice([3, 8, 40])))
        rows.append((k, body + " " + line if k % 2 else body))
    rows += [(400 + k, rows[k][1] + f" extra{k}") for k in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    assert got == brute(rows)
    _, heavy = jaccard.set_stats(docs)
    token, count = jaccard.heavy_shingles(heavy, 400)
    assert len(token) >= 8 if least == 1 else len(token) == 0
    fragments = docs.mapInPandas(jaccard._screen_rows(4), jaccard.SCREEN_ROWS).where("part >= 0").collect()
    entries = {}
    for f in fragments:
        for x in np.frombuffer(f["tokens"], np.uint32):
            entries[(f["part"], int(x))] = entries.get((f["part"], int(x)), 0) + 1
    assert max(entries.values()) <= 8  # slices, not documents


def test_only_rows_whose_own_text_is_a_copy_go(spark):
    """An id that stands for several texts loses only the linked ones."""
    r = random.Random(9)
    a, b, c = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "abc")
    near = a.rsplit(" ", 2)[0]
    rows = [(1, a, "x"), (5, near, "x"), (5, b, "x"), (9, c, "x"), (7, c, "y"), (7, c, "x"), (7, "", "x"), (7, None, "x"), (8, b, "x"), (10, " .", "z"), (11, "", "z")]
    kept = sorted(tuple(x) for x in jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, label string").repartition(3)).fillna("null").collect())
    assert kept == sorted([(1, a, "x"), (5, b, "x"), (7, c, "x"), (7, "", "x"), (7, "null", "x"), (10, " .", "z"), (11, "", "z")])
    same = spark.createDataFrame([(3, a, "x")] * 50 + [(4, near, "x")] * 3, "doc_id bigint, text string, label string")
    assert [tuple(x) for x in jaccard.keep_one(same).collect()] == [(3, a, "x")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.link(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0


def test_rows_follow_the_classes_not_the_fragments(spark, monkeypatch):
    """However many fragments the order has, a class has ``SHARES`` segments at most and no counts of
    a fragment are written (before, both grew with the fragments); components as by brute force."""
    monkeypatch.setattr(jaccard, "FRAGMENTS", 40)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 500)
    written = {}
    keep = jaccard.materialize

    def spy(df, name, *more):
        written[name] = keep(df, name, *more)
        return written[name]

    monkeypatch.setattr(jaccard, "materialize", spy)
    r = random.Random(21)
    base = [f"w{r.randrange(400)}" for _ in range(300)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 24)):
            w[r.randrange(len(w))] = f"x{r.randrange(400)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    assert got == brute(rows)
    held = [x["count"] for x in written["jaccard-segments"].groupBy("cls").count().collect()]
    assert len(held) == 60 and max(held) <= jaccard.SHARES
    assert "jaccard-partial" not in written and set(written["jaccard-cross"].columns) == {"a", "b"}
    blocks = written["jaccard-blocks"].collect()
    assert len(blocks) > 1 and all(sum(m["n"] for m in b["members"]) <= 4 * 500 for b in blocks)
