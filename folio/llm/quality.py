"""Quality classifier: averaged hashed subword embeddings, softmax output, numpy SGD.

A document's features are its words, word pairs (a repeated word is one feature of its own)
and the byte 3- and 4-grams of its whole text, hashed into ``BUCKETS``.  Each bucket has a
learned vector; a document is the mean of its features' vectors, and a linear layer with
softmax gives the probability of label 1.  Since the output is linear in the mean, scoring
folds vectors and layer into one number per bucket.

Training reads a bounded sample: of each label the ``PER_LABEL`` rows with the smallest id
hash.  Features are made on the executors; only their (bucket, count) pairs reach the driver.
Scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.words import NOT_WHITE, chain, clean, hash_spans, mix, release, slices, word_spans

BUCKETS = 1 << 17
#: Neutral features that every document has besides its own, so that a few words decide little.
NEUTRAL = 30
DIM = 16
PER_LABEL = 1500
EPOCHS, RATE = 6, 0.5
#: Characters whose features are made at once (about 100 bytes of memory each), and documents whose
#: counts are handed on at once.
SLICE, COUNTED_ROWS = 100_000, 200
#: A document with at least this score is predicted to be of label 1.
THRESHOLD = 0.3
#: The word pair feature of a word that repeats its predecessor.
REPEAT = np.uint64(0xA24BAED4963EE407)


def held_out(doc_id: Column | str, folds: int = 5, fold: int = 0) -> Column:
    """Whether the id's crc32 falls in the held-out fold; such rows are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature groups of a slice of texts: (buckets, owner), owners ascending in each group."""
    buf, starts, ends, owner = word_spans(texts, NOT_WHITE, lower=False)
    words = hash_spans(buf, starts, ends)
    pairs, mask = chain(words, 2), np.uint64(BUCKETS - 1)
    pairs[words[1:] == words[:-1]] = REPEAT
    inside = owner[1:] == owner[:-1]
    groups = [(words & mask, owner), ((pairs & mask)[inside], owner[1:][inside])]
    size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts])
    stop = np.cumsum(size + 1) - 1
    wide = buf.astype(np.uint32)
    for n in (3, 4):
        if len(buf) < n:
            continue
        code = wide[: len(buf) - n + 1].astype(np.uint64)
        for j in range(1, n):
            code = code << np.uint64(8) | wide[j : len(buf) - n + 1 + j]
        grams = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(texts)), grams)
        at = np.arange(int(grams.sum())) + np.repeat(stop - size - (np.cumsum(grams) - grams), grams)
        groups.append((mix(code[at] + np.uint64(n)) & mask, own))
    return groups


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), COUNTED_ROWS):
            batch, rows = whole.iloc[at:at + COUNTED_ROWS], []
            for text, label in zip(clean(batch["text"]), batch["quality"]):
                groups = [g[0] for g in features([text])]
                bucket, count = np.unique(np.concatenate(groups).astype(np.uint32), return_counts=True)
                rows.append((int(label), bucket.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["quality", "bucket", "count"])
    release()


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """``(text, quality)`` of the rows to train on: outside the held-out fold, labelled 0 or 1,
    at most ``per_label`` of each.  Of a repeated label row the greatest label counts."""
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    ids = docs.select("doc_id").where("doc_id is not null").where(~held_out("doc_id")).distinct().join(known, "doc_id")
    picked = [
        ids.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)
    ]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_label ids
    return docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])


@dataclass(frozen=True)
class Model:
    """One weight per bucket (the embeddings folded with the output layer) and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; a text without features has the bias alone."""
        out = np.zeros(len(texts))
        for a, b in slices(texts, SLICE):
            total, count = np.zeros(b - a), np.zeros(b - a)
            for bucket, owner in features(texts[a:b]):
                total += np.bincount(owner, weights=self.weights[bucket], minlength=b - a)
                count += np.bincount(owner, minlength=b - a)
            out[a:b] = total / (count + NEUTRAL)
        return 1 / (1 + np.exp(-(out + self.bias)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: int = 17) -> Model:
    """Fit on the bounded sample.  With fewer than two labels present every score is 0.5 if none
    is, else 0.95 or 0.05 by the only label."""
    rows = sample(docs, labels, per_label).select("doc_id", "text", "quality")
    got = rows.select("text", "quality").mapInPandas(_counted, "quality int, bucket binary, count binary").collect()
    data = sorted((r["quality"], bytes(r["bucket"]), bytes(r["count"])) for r in got)
    seen = {r[0] for r in data}
    if len(seen) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not seen else (2.94 if 1 in seen else -2.94))
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount([r[0] for r in data], minlength=2) / len(data)
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            label, bucket, count = data[k]
            bucket = np.frombuffer(bucket, np.uint32)
            if not len(bucket):
                continue
            part = np.frombuffer(count, np.uint32).astype(np.float32)
            part /= part.sum() + NEUTRAL
            mean = part @ embed[bucket]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= RATE * (1 - done / steps) * 0.5 / share[label]
            back = layer @ p
            layer -= np.outer(mean, p)
            bias -= p * 0.1
            embed[bucket] -= part[:, None] * back * min(len(bucket), 200)
            done += 1
    return Model((embed @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``THRESHOLD``).

    Only the text is read; null and empty texts get the score of no features.  Columns already
    named ``score`` or ``predicted`` are replaced, all others kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(held.value.score(clean(batch)))
        release()

    return docs.withColumn("score", of("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
