"""Benchmark decontamination by latent semantic retrieval and verification.

The benchmark is the query set; it is taken in blocks of about ``BLOCK_ITEMS`` items, whose
passages are cut into latent spaces of at most ``RANK`` passages, so that each space is complete;
``PASS_SPACES`` of them are searched in one pass over all documents.

1. Items are cut into passages of at most ``PASSAGE`` words.  The document frequency of their
   words is counted over all documents.
2. The TF-IDF matrix of the passages is decomposed by a randomised SVD: random directions are
   multiplied by ``A'A`` in power iterations, each one a pass over the partitions of passages
   that returns partial products, with a QR step in between.  A space holds no more passages
   than directions, and one that does not keep ``KEPT`` of each passage is split.
3. Every document is cut into overlapping windows of ``WINDOW`` words.  A window that holds too few
   of the less common words of every passage is left out; the others are folded into the latent
   space.  A passage that the window covers by at least what step 4 needs of it, were its lightest
   words the ones that are left, is a candidate, whatever else stands in the window: a paraphrase
   may have lost the heaviest words (names, numbers).  No window that step 4 accepts is missed.
4. A candidate is verified on the words themselves: in some stretch of text not much longer than the
   passage (``SPREAD``) the longest common subsequence must cover ``COVER`` of the passage, or
   ``ANSWER_COVER`` of it if the passage's end (the answer) stands there word for word.

Words are ASCII letters and digits and non-ASCII characters in runs, lower-cased (A-Z).
Verification happens where the window was read, so no text is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.words import ALNUM, clean, release, slices, word_hashes

BLOCK_ITEMS = 1000
#: Latent spaces that are searched in one pass over the texts.
PASS_SPACES = 4
PASSAGE, STRIDE = 64, 64
RANK, OVERSAMPLE, POWER = 256, 8, 2
#: Least length of a passage in its latent space as a share of its own; a space that keeps less is split.
KEPT = 0.99
#: Words of a text window; a passage with half as many further words between fits in some window.
WINDOW = 160
#: Inverse document frequencies are kept in these bounds, so that no single word decides.
IDF = (2.0, 4.0)
#: Words in at least this share of the documents are common.
COMMON = 0.01
#: Words of a stretch of text that stands for a passage, as a multiple of its own, and some more.
SPREAD, SPREAD_WORDS = 1.5, 4
#: Rounding errors of the latent space, as a share of the window's length.
ROUNDING = 1e-5
COVER, ANSWER_COVER, ANSWER_WORDS = 0.7, 0.5, 8
#: Characters that are read at once, and windows that are folded at once.
SLICE, FOLDED = 1_000_000, 64
#: Passages with fewer words must stand in the text word for word.
SHORT = 8


@dataclass(frozen=True)
class Passage:
    item_id: int
    words: np.ndarray


def passages(item_id: int, text: str | None) -> list[Passage]:
    """The item's words in pieces of at most ``PASSAGE`` (as even as possible)."""
    words = word_hashes([text or ""], ALNUM)[0]
    pieces = max(1, -(-len(words) // PASSAGE))
    return [Passage(item_id, p) for p in np.array_split(words, pieces) if len(p)]


class Lookup:
    """Word hash -> index of a vocabulary, -1 for other words."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        bits = max(16, int(len(vocabulary) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        slot = (vocabulary >> self.shift).astype(np.int64)
        self.table[slot] = np.arange(len(vocabulary))
        # words that lost their slot to another one are searched for
        lost = self.table[slot] != np.arange(len(vocabulary))
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[lost]] = True

    def __call__(self, words: np.ndarray) -> np.ndarray:
        slot = (words >> self.shift).astype(np.int64)
        index = self.table[slot]
        if len(self.vocabulary):
            index = np.where((index >= 0) & (self.vocabulary[index] == words), index, -1)
            again = np.flatnonzero(self.crowded[slot])
            if len(again):
                at = np.minimum(np.searchsorted(self.vocabulary, words[again]), len(self.vocabulary) - 1)
                index[again] = np.where(self.vocabulary[at] == words[again], at, -1)
        return index


def document_frequency(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each vocabulary word occurs, and the number of documents."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # words of one benchmark block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, size = Lookup(held.value), len(held.value)
        count, rows = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            texts = clean(batch["text"])
            rows += len(texts)
            for a, b in slices(texts, SLICE):
                words, owner = word_hashes(texts[a:b], ALNUM)
                index = lookup(words)
                known = index >= 0
                once = np.unique(owner[known].astype(np.int64) * size + index[known]) % max(size, 1)
                count[:size] += np.bincount(once, minlength=size)
        count[size] = rows
        at = np.flatnonzero(count)
        yield pd.DataFrame({"term": at, "n": count[at]})
        release()

    total = docs.select("text").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in total:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def _products(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """``A' (A basis)`` for the sparse rows ``(term array<int>, weight array<float>)``, summed
    from one partial product per partition (at most eight)."""
    held = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        out = np.zeros_like(m)
        for batch in batches:
            for term, weight in zip(batch["term"], batch["weight"]):
                weight = np.asarray(weight, np.float32)
                out[term] += weight[:, None] * (weight @ m[term])
        yield pd.DataFrame({"part": [out.tobytes()]})

    total = np.zeros(basis.shape, np.float64)
    for r in rows.mapInPandas(run, "part binary").toLocalIterator():
        total += np.frombuffer(r["part"], basis.dtype).reshape(basis.shape)
    return total


def latent_basis(rows: DataFrame, terms: int, n: int, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of the passage matrix (terms x at most ``rank``)."""
    width = min(rank + OVERSAMPLE, n, terms)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(_products(rows, q.astype(np.float32)))[0]
    gram = q.T @ _products(rows, q.astype(np.float32))
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = np.argsort(-values)[: min(rank, width)]
    keep = keep[values[keep] > max(values.max(), 0) * 1e-9]
    return (q @ vectors[:, keep]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the positions of ``a`` as bits."""
    where: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        u = row & where.get(w, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def contains(words: np.ndarray, run: np.ndarray) -> bool:
    """Whether ``run`` stands in ``words`` without gaps."""
    if not len(run) or len(run) > len(words):
        return False
    return any((words[k : k + len(run)] == run).all() for k in np.flatnonzero(words[: len(words) - len(run) + 1] == run[0]))


def least_tokens(words: np.ndarray, cover: float = ANSWER_COVER) -> int:
    """Words of a passage that a text must hold at least for ``verify`` to find it, with its end
    (``ANSWER_COVER``) or without it (``COVER``)."""
    n = len(words)
    return n if n < SHORT else int(np.ceil(cover * n - 1e-9))


@dataclass(frozen=True)
class Index:
    """One latent space: passages, vocabulary, word weights and directions; the least share of each
    passage's squared weight that a found text covers, without the passage's end and with it; the
    rarest word of each end (which a text found by its end holds); and what each word counts at most
    towards the words that any passage needs without its end."""

    passages: list[Passage]
    vocabulary: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    length: np.ndarray
    least: np.ndarray
    key: np.ndarray
    share: np.ndarray

    def candidates(self, lookup: Lookup, words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, tuple[int, int], Passage, float]]:
        """``(text, (start, end), passage, cosine)`` of similar windows."""
        if not len(words) or not len(self.passages):
            return
        index = lookup(words)
        mass = np.concatenate([[0], np.cumsum(np.where(index >= 0, self.share[index], 0).astype(np.float64))])
        texts, first = np.unique(owner, return_index=True)
        last = np.append(first[1:], len(words))
        count = np.maximum(1, -(-(last - first - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(texts)), count)
        start = first[text] + STRIDE * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(start + WINDOW, last[text])
        is_key = np.zeros(len(self.vocabulary) + 1, np.int64)
        is_key[self.key] = 1
        is_key[-1] = 0  # words of no passage
        keys = np.concatenate([[0], np.cumsum(is_key[index])])
        heavy = np.flatnonzero((mass[end] - mass[start] >= 1 - 1e-6) | (keys[end] > keys[start]))
        wanted, needed = self.wanted()
        present = np.zeros(len(self.vocabulary) + 1, bool)
        for k in range(0, len(heavy), FOLDED):
            part = heavy[k : k + FOLDED]
            size = end[part] - start[part]
            at = np.repeat(start[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            row = np.repeat(np.arange(len(part)), size)
            known = index[at] >= 0
            held = np.zeros((len(part), len(self.vocabulary)), bool)
            held[row[known], index[at[known]]] = True
            row, term = np.nonzero(held)  # a word counts once in a window, as in a passage
            x = np.zeros((len(part), self.basis.shape[1]), np.float32)
            if len(term):
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                x[row[begin]] = np.add.reduceat(self.basis[term] * self.idf[term, None], begin)
            along = x @ self.latent.T
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            cosine = along / np.maximum(norm, 1e-9)
            ended = held[:, self.key]
            covered = along >= KEPT * np.where(ended, self.least[1], self.least[0]) * self.length - ROUNDING * norm
            bounds = np.searchsorted(row, np.arange(len(part) + 1))
            for i in np.flatnonzero(covered.any(axis=1)):
                here = term[bounds[i] : bounds[i + 1]]
                present[here] = True
                near = np.flatnonzero(covered[i])
                for p in near[present[wanted[near]].sum(axis=1) >= np.where(ended[i, near], needed[1, near], needed[0, near])]:
                    yield int(texts[text[part[i]]]), (int(start[part[i]]), int(end[part[i]])), self.passages[p], float(cosine[i, p])
                present[here] = False

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of each passage, filled up with -1, and how many of them a text must hold."""
        words = np.full((len(self.passages), max(len(p.words) for p in self.passages)), -1)
        for k, p in enumerate(self.passages):
            words[k, : len(p.words)] = np.searchsorted(self.vocabulary, p.words)
        return words, np.array([[least_tokens(p.words, cover) for p in self.passages] for cover in (COVER, ANSWER_COVER)])

    def verify(self, words: np.ndarray, at: tuple[int, int], passage: Passage) -> dict | None:
        return verified(words[at[0] : at[1]], passage)


def verified(window: np.ndarray, passage: Passage) -> dict | None:
    """The best stretch of the window that stands for the passage."""
    wanted = passage.words
    if len(wanted) < SHORT:
        hit = contains(window, wanted)
        return {"item_id": passage.item_id, "common": len(wanted), "coverage": 1.0, "answer": True} if hit else None
    if common_subsequence(wanted, window) < least_tokens(wanted):
        return None
    reach = int(SPREAD * len(wanted)) + SPREAD_WORDS
    step, best = max(1, len(wanted) // 8), None
    for a in range(0, max(1, len(window) - reach + step), step):
        stretch = window[a : a + reach]
        common = common_subsequence(wanted, stretch)
        if common < least_tokens(wanted) or best is not None and common <= best["common"]:
            continue
        answer, coverage = contains(stretch, wanted[-ANSWER_WORDS:]), common / len(wanted)
        if coverage >= COVER or coverage >= ANSWER_COVER and answer:
            best = {"item_id": passage.item_id, "common": common, "coverage": coverage, "answer": answer}
    return best


def least_share(terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, needed: int) -> float:
    """The least share of a passage's squared weight that ``needed`` of its words can have: its
    lightest words, the last one in part."""
    order = np.argsort(np.square(weight) / tf, kind="stable")
    tf, square = tf[order], np.square(weight)[order].astype(np.float64)
    whole = int(np.searchsorted(np.cumsum(tf), needed))
    before = int(tf[:whole].sum())
    part = square[whole] * (needed - before) / tf[whole] if whole < len(tf) else 0.0
    return float((square[:whole].sum() + part) / square.sum())


def leaks_of(spaces: list[Index], texts: list[str]) -> list[list[dict]]:
    """For each text the benchmark items found in it, best passage of each."""
    lookups = [Lookup(space.vocabulary) for space in spaces]
    out: list[list[dict]] = []
    for a, b in slices(texts, SLICE):
        words, owner = word_hashes(texts[a:b], ALNUM)
        found: list[dict[int, dict]] = [{} for _ in range(b - a)]
        for space, lookup in zip(spaces, lookups):
            for text, at, passage, cosine in space.candidates(lookup, words, owner):
                verdict = space.verify(words, at, passage)
                if verdict:
                    held = found[text].get(verdict["item_id"])
                    if held is None or (verdict["coverage"], cosine) > (held["coverage"], held["cosine"]):
                        found[text][verdict["item_id"]] = verdict | {"cosine": cosine}
        out += [[f[i] for i in sorted(f)] for f in found]
    return out


def space_of(spark: SparkSession, held: list[Passage], weights: dict[int, tuple[float, bool, float]]) -> Iterator[Index]:
    """The latent space of at most ``RANK`` passages, or of its halves if it does not keep ``KEPT``
    of each passage's length.  ``weights`` has of every word hash the idf, whether it is common, and in
    how many documents it is."""
    vocabulary = np.unique(np.concatenate([p.words for p in held]))
    idf = np.array([weights[w][0] for w in vocabulary.tolist()], np.float32)
    common = np.array([weights[w][1] for w in vocabulary.tolist()], bool)
    sparse, length, least, key = [], [], [], []
    share = np.zeros(len(vocabulary), np.float32)
    for p in held:
        term, tf = np.unique(np.searchsorted(vocabulary, p.words), return_counts=True)
        w, needed = idf[term], least_tokens(p.words, COVER)
        length.append(float(np.linalg.norm(w)))
        least.append([least_share(term, tf, w, least_tokens(p.words, cover)) for cover in (COVER, ANSWER_COVER)])
        end = np.searchsorted(vocabulary, p.words[-ANSWER_WORDS:])
        key.append(int(end[np.argmin([weights[h][2] for h in p.words[-ANSWER_WORDS:].tolist()])]))
        sparse.append((term.astype(np.int32), (w / np.linalg.norm(w)).astype(np.float32)))
        # a found text holds ``needed`` of the words, so at least ``rare`` of those that are not common
        rare = needed - int(tf[common[term]].sum())
        counts = np.where(common[term], 0, tf) / rare if rare >= 2 else tf / needed
        share[term] = np.maximum(share[term], counts.astype(np.float32))
    # as Arrow, since rows of Python objects start workers of another kind, which live on besides the others
    table = pa.table({"term": pa.array([t for t, _ in sparse], pa.list_(pa.int32())), "weight": pa.array([w for _, w in sparse], pa.list_(pa.float32()))})
    matrix = spark.createDataFrame(table).repartition(min(8, len(sparse)))
    basis = latent_basis(matrix, len(vocabulary), len(sparse))
    latent = np.stack([np.asarray(w, np.float32) @ basis[t] for t, w in sparse])
    kept = np.linalg.norm(latent, axis=1, keepdims=True)
    if kept.min() < KEPT and len(held) > 1:
        yield from space_of(spark, held[: len(held) // 2], weights)
        yield from space_of(spark, held[len(held) // 2 :], weights)
        return
    latent /= np.maximum(kept, 1e-9)
    yield Index(held, vocabulary, idf, basis, latent, np.array(length, np.float32) * kept[:, 0], np.array(least, np.float32).T, np.array(key), share)


def indexes(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> Iterator[list[Index]]:
    """The latent spaces of each pass; an item's passages are all in one pass.  Items without
    words or id are left out."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").distinct()
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_items
        held = [p for r in sorted(rows) for p in passages(r["item_id"], r["text"])]
        if not held:
            continue
        vocabulary = np.unique(np.concatenate([p.words for p in held]))
        df, n = document_frequency(docs, vocabulary)
        idf = np.clip(np.log((n + 1) / (np.minimum(df, n) + 1)), *IDF).astype(np.float32)
        weights = dict(zip(vocabulary.tolist(), zip(idf.tolist(), (df >= COMMON * n).tolist(), df.tolist())))
        part: list[Passage] = []
        for _, group in itertools.groupby(held, key=lambda p: p.item_id):
            more = list(group)
            if part and len(part) + len(more) > PASS_SPACES * RANK:
                yield _spaces(spark, part, weights)
                part = []
            part = part + more
        yield _spaces(spark, part, weights)


def _spaces(spark: SparkSession, held: list[Passage], weights: dict[int, tuple[float, bool, float]]) -> list[Index]:
    pieces = -(-len(held) // RANK)
    cuts = [len(held) * k // pieces for k in range(pieces + 1)]
    return [space for a, b in zip(cuts, cuts[1:]) for space in space_of(spark, held[a:b], weights)]


LEAK = "array<struct<item_id: bigint, cosine: double, common: bigint, coverage: double, answer: boolean>>"


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaks``, the benchmark items found in each text (empty if clean).

    All columns are kept; one named ``leaks`` is replaced.  Null and empty texts, and an empty
    benchmark, give no leaks.  ``PASS_SPACES`` latent spaces are one pass over the texts.
    """
    spark = docs.sparkSession
    out = docs.withColumn("leaks", F.array().cast(LEAK))
    for spaces in indexes(docs, benchmark):
        found = _finder(spark.sparkContext.broadcast(spaces))  # at most about PASS_SPACES * RANK passages
        out = out.withColumn("leaks", F.concat("leaks", found("text")))
    return out


def _finder(held):
    @F.pandas_udf(LEAK)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(leaks_of(held.value, clean(batch)), dtype=object)
        release()

    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id, item_id, cosine, common``
    (words of the common subsequence), ``coverage`` (of the passage) and ``answer``."""
    rows = flag(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("leak"))
    return rows.select("doc_id", "leak.item_id", "leak.cosine", "leak.common", "leak.coverage", "leak.answer")
