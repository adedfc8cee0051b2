import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd

from folio.llm import langid, quality

GOOD = ["the of and to in house river walks slowly under green trees".split(), "der die und haus fluss geht langsam unter bäumen".split()]


def text(r, bad):
    words = [r.choice(r.choice(GOOD)) for _ in range(r.randint(20, 80))]
    return " ".join(w + r.choice(["***", "###", "$$$"]) for w in words) if bad else " ".join(words) + "."


def corpus(n=500):
    r = random.Random(5)
    return [(k, text(r, k % 4 == 0), "xx", 0 if k % 4 == 0 else 1) for k in range(n)]


def test_held_out_fold(spark):
    docs = spark.createDataFrame([(k,) for k in range(300)] + [(None,)], "doc_id bigint")
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out("doc_id").alias("h")).collect()}
    assert got.pop(None) is False
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(300)}


def test_quality_learns_from_text_and_ignores_the_held_out_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows] + [(900, None, "a"), (901, "", "a"), (None, "x y", "a"), (1, rows[1][1], "a")], "doc_id bigint, text string, score string")
    truth = {r[0]: r[3] for r in rows}
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in truth.items()] + [(7, 1), (None, 1), (8, None), (9, 5)]
    labels = spark.createDataFrame(flipped, "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) + 4
    scored = [r for r in out if r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in scored]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    nothing = {r["score"] for r in out if not r["text"]}
    assert len(nothing) == 1


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in quality.score(docs, quality.train(docs, empty)).collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), quality.train(docs, empty)).count() == 0


def test_features_count_every_gram():
    texts = ["ab", "", "a a a", "xyz" * 50]
    for k, (bucket, owner) in enumerate(quality.features(texts)):
        single = [len(quality.features([t])[k][0]) if len(quality.features([t])) > k else 0 for t in texts]
        assert np.bincount(owner, minlength=4).tolist() == single
        assert (bucket < quality.BUCKETS).all()


def test_language(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(GOOD[k % 2]) for _ in range(25)), "en" if k % 2 == 0 else "de") for k in range(300)]
    odd = [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (None, "the river", "en"), (1003, "THE RIVER AND THE HOUSE" * 2000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ("de", "en") and (model.weights == 0).mean() > 0.5
    out = {r["doc_id"]: r for r in langid.predict(docs.withColumnRenamed("lang", "score"), model).collect()}
    assert np.mean([out[d]["lang_pred"] == lang for d, _, lang in rows]) == 1
    assert [out[d]["lang_pred"] for d in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[1000]["score"] == 0
    none = langid.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_long_texts_are_counted_in_blocks(monkeypatch):
    t = "Die Häuser und the river " * 40
    whole = langid.counts(t)
    monkeypatch.setattr(langid, "BLOCK", 17)
    assert (langid.counts(t) == whole).all()


def test_quality_scores_many_texts_in_little_memory():
    texts = [text(random.Random(k), k % 4 == 0) * 10 for k in range(800)]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.1)
    tracemalloc.start()
    got = model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 1_500_000 and peak < 30_000_000
    assert got.tolist() == [model.score([t])[0] for t in texts]


def test_quality_counts_of_large_batches_come_in_parts():
    batch = pd.DataFrame({"text": [f"word{k} a" for k in range(450)], "quality": [k % 2 for k in range(450)]})
    parts = list(quality._counted(iter([batch])))
    assert [len(p) for p in parts] == [200, 200, 50]
    assert [q for p in parts for q in p["quality"]] == batch["quality"].tolist()
