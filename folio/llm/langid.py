"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader (elastic net), then temperature-calibrated.

Texts are lower-cased and everything but letters becomes a space; 1-, 2- and 3-grams of
characters are hashed into ``BUCKETS``.  Term weights are ``log(1 + tf) * idf``, scaled to unit
length.  Training reads a bounded sample of about ``TRAIN_DOCS`` labelled rows spread evenly
over the languages (smallest id hash first); a fifth of it is kept for the temperature.
Scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.llm.words import clean

BUCKETS = 1 << 14
SHIFT = np.uint64(64 - 14)
TRAIN_DOCS, LEAST_PER_LANG = 4000, 20
#: Hash lanes in which a language's rows are ranked first.
LANES = 64
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.002, 0.0005, 3
UNKNOWN = "und"
#: Characters that are counted at once.
BLOCK = 2_000_000
#: Documents whose counts are held as one dense matrix.
GROUP = 128


@cache
def _letters() -> np.ndarray:
    """For each code point of the first two planes whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x20000)])


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one space
    and a space at both ends; empty if there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(code, 0x1FFFF)] | (code >= 0x20000) & (code < 0xE0000)
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[keep]
    return np.concatenate([[32], code, [32]]).astype(np.uint64)


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a text, or None without a letter."""
    code = characters(text)
    if not len(code):
        return None
    out = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(code), BLOCK):
        part = code[start : start + BLOCK + 2]
        gram = np.zeros(len(part), np.uint64)
        for n in (1, 2, 3):
            gram = gram[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            first = gram[:BLOCK] * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((first >> SHIFT).astype(np.int64), minlength=BUCKETS)
    return out


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; ``und`` and 0 without letters."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        for start in range(0, len(texts), GROUP):
            rows = [counts(t) for t in texts[start : start + GROUP]]
            known = [k for k, r in enumerate(rows) if r is not None]
            if not known:
                continue
            x = np.log1p(np.stack([rows[k] for k in known]).astype(np.float32)) * self.idf
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            p = softmax((x @ self.weights + self.bias) / self.temperature)
            for k, best, row in zip(known, p.argmax(1), p):
                langs[start + k], scores[start + k] = self.langs[best], row[best]
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, lang, text in zip(batch["doc_id"], batch["lang"], clean(batch["text"])):
            tf = counts(text)
            if tf is not None:
                at = np.flatnonzero(tf)
                rows.append((doc_id, lang, at.astype(np.uint16).tobytes(), tf[at].astype(np.uint32).tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "lang", "bucket", "tf"])


def trainable(doc_id: str = "doc_id"):
    """Rows outside the held-out fold (crc32 of the id as text, modulo 3, is 1)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def sample(docs: DataFrame, total: int = TRAIN_DOCS) -> DataFrame:
    """``(doc_id, lang, text)`` of the training rows: at most ``max(LEAST_PER_LANG, total /
    languages)`` of each language."""
    ids = docs.select("doc_id", "lang").where("doc_id is not null and lang is not null").where(trainable()).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    langs = ids.agg(F.approx_count_distinct("lang", 0.01)).first()[0]
    each = max(LEAST_PER_LANG, total // max(1, langs))
    # first within hash lanes, so that no task sorts all rows of a frequent language
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(LANES))
    first = F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))
    thinned = ids.withColumn("lane", lane).withColumn("rank", first).where(F.col("rank") <= each)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = thinned.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "lang")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # bounded by the sample


def train(docs: DataFrame, total: int = TRAIN_DOCS, seed: int = 5) -> Model:
    """Fit on the bounded sample; without any usable row the model knows no language."""
    got = sample(docs, total).select("doc_id", "lang", "text").mapInPandas(_counted, "doc_id bigint, lang string, bucket binary, tf binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"]))
    langs = tuple(sorted({r["lang"] for r in got}))
    index = {lang: k for k, lang in enumerate(langs)}
    rows = [(index[r["lang"]], np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.log1p(np.frombuffer(r["tf"], np.uint32).astype(np.float32))) for r in got]
    df = np.zeros(BUCKETS)
    for _, at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 0.05
    data = []
    for y, at, tf in rows:
        x = tf * idf[at]
        data.append((y, at, x / max(float(np.linalg.norm(x)), 1e-12)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    check, fit = order[: len(data) // 5], order[len(data) // 5 :]
    k = len(langs)
    z, n = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((BUCKETS + 1, k), np.float32)

    def leader(at: np.ndarray) -> np.ndarray:
        """Weights of some rows, from the accumulated gradients; small ones are exactly 0."""
        over = np.abs(z[at]) - L1
        return np.where(over > 0, -np.sign(z[at]) * over / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0)

    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            y, at, x = data[i]
            at, x = np.append(at, BUCKETS), np.append(x, np.float32(0.1))
            w = leader(at)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    weights = leader(np.arange(BUCKETS + 1)).astype(np.float32) if k else np.zeros((BUCKETS + 1, 0), np.float32)
    weights, bias = weights[:-1], weights[-1] * np.float32(0.1)
    best = (np.inf, 1.0)
    logits = np.array([data[i][2] @ weights[data[i][1]] + bias for i in check]).reshape(len(check), k)
    truth = np.array([data[i][0] for i in check], int)
    for t in np.geomspace(0.02, 5, 60) if len(check) and k else ():
        loss = -np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), truth], 1e-12)).mean()
        best = min(best, (loss, t))
    return Model(langs, idf, weights, bias, float(best[1]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the text alone.

    A null text or one without a letter gives ``und`` and 0.  Columns of these names are
    replaced, all others kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = held.value.predict(clean(batch))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("__lang", of("text")).select(*kept, "__lang.lang_pred", "__lang.score")
