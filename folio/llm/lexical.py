"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` cuts the documents into blocks of similar size.  A block's signature is a bit
matrix with a row per hash value and a column per document: a term sets ``HASHES`` rows in its
document's column, and again under a key of its own for each level of its frequency
(``LEVELS``).  Rows are stored whole, so a query reads the rows of its terms only.

``search`` answers a table of items in three steps:

1. For a term the AND of its rows is a bitmap of the documents that may hold it, level by level;
   bits are never missing, so presence and frequency are overestimated.  With a document's exact
   length this bounds the term's part of its score, and the weighted sum of the slices bounds the
   score.  The ``k`` documents of the highest bound of each item are scored exactly; the lowest of
   these scores is the item's threshold.
2. Every document whose bound reaches the threshold is a candidate.  All others are provably
   outside the best ``k``.
3. Candidates are scored exactly from their texts and ranked.

Terms are the maximal runs of ASCII letters and digits and non-ASCII characters, with A-Z
lower-cased, known by a 64-bit hash.  All arithmetic of scores is on integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import bloom
from folio.llm.words import ALNUM, clean, mix, slices, word_hashes
from folio.session import at_most, materialize

TOP = 20
#: Frequencies at which a term sets further bits; the last level is open.
LEVELS = np.array([1, 2, 3, 4, 6, 9, 14, 25, 60])
#: Rows that a key sets, and the share of a column's bits that a block's fullest document sets.
HASHES, DENSITY = 6, 0.4
#: Documents of a block at most, and bits of its matrix at most (one document may exceed it).
BLOCK_DOCS, BLOCK_BITS = 1024, 1 << 25
#: Characters that are read at once; items that are searched in one pass, and their characters.
SLICE = 4_000_000
PASS_ITEMS, PASS_CHARS = 500, 4_000_000
#: Terms whose slices are looked at together.
TILE = 256
#: Candidate documents up to which their keys are broadcast.
BROADCAST_ROWS = 500_000

_SALT = mix(np.arange(1, len(LEVELS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLOCK = "rows bigint, slices binary, docs binary, ids binary, lengths binary"


def _rows_of(keys: np.ndarray, rows: int) -> np.ndarray:
    """The matrix rows of each key, a last axis of ``HASHES``."""
    low, step = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    return ((low[..., None] + step[..., None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(rows)).astype(np.int64)


def frequencies(texts: list[str]):
    """``(text, term, tf)`` of every distinct term of every text, ascending by text and term."""
    h, owner = word_hashes(texts, ALNUM)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def _signature(column: np.ndarray, keys: np.ndarray, docs: int, most: int) -> tuple[int, bytes]:
    """Row count and packed rows of a block whose fullest document has ``most`` keys."""
    rows = max(64, math.ceil(most * HASHES / -math.log(1 - DENSITY)))
    bits = np.zeros((rows, -(-docs // 8) * 8), bool)
    bits[_rows_of(keys, rows), column[:, None]] = True
    return rows, np.packbits(bits, axis=1, bitorder="little").tobytes()


def blocks_of(texts: list[str], docs: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """The index rows of some texts; texts without a term are left out."""
    owner, term, tf = frequencies(texts)
    level = np.searchsorted(LEVELS, tf, side="right")
    at = np.repeat(np.arange(len(term)), level)
    step = np.arange(len(at)) - np.repeat(np.cumsum(level) - level, level)
    keys, of = mix(term[at] ^ _SALT[step]), owner[at]
    many = np.bincount(of, minlength=len(texts))
    length = np.bincount(owner, weights=tf, minlength=len(texts)).astype(np.int64)
    begin = np.cumsum(many) - many
    order = np.argsort(many, kind="stable")
    order = order[many[order] > 0]
    a = 0
    while a < len(order):
        b = a + 1  # documents of less than twice the keys of the first one
        while b < len(order) and b - a < BLOCK_DOCS and many[order[b]] < 2 * many[order[a]] + 16 and (b - a + 1) * many[order[b]] * 12 <= BLOCK_BITS:
            b += 1
        who = order[a:b]
        size = many[who]
        pick = np.repeat(begin[who] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        rows, packed = _signature(np.repeat(np.arange(len(who)), size), keys[pick], len(who), int(size[-1]))
        yield rows, packed, docs[who].tobytes(), ids[who].tobytes(), length[who].tobytes()
        a = b


#: Stands for a null id inside the index; such rows rank behind all others of equal score.
NO_ID = np.iinfo(np.int64).max


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``doc``, a hash of both that names the row."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def build_index(docs: DataFrame) -> DataFrame:
    """The signature blocks of all rows, one pass over the texts without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, doc = clean(batch["text"]), batch["doc"].to_numpy(np.int64)
            ids = batch["doc_id"].fillna(NO_ID).to_numpy(np.int64)
            for a, b in slices(texts, SLICE):
                yield pd.DataFrame(list(blocks_of(texts[a:b], doc[a:b], ids[a:b])), columns=["rows", "slices", "docs", "ids", "lengths"])

    rows = keyed(docs).select("doc", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text")
    return materialize(rows.mapInPandas(run, BLOCK), "signatures")


def _gathered(index: DataFrame) -> tuple[int, int]:
    """Number of indexed documents and of all their terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = total = 0
        for batch in batches:
            for held in batch["lengths"]:
                size = np.frombuffer(held, np.int64)
                n, total = n + len(size), total + int(size.sum())
        yield pd.DataFrame({"n": [n], "total": [total]})

    n, total = index.select("lengths").mapInPandas(run, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    return int(n or 0), int(total or 0)


def document_frequency(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many rows each of the ``terms`` (ascending hashes) occurs; exact, one pass."""
    held = docs.sparkSession.sparkContext.broadcast(terms)  # terms of one pass of items

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        count = np.zeros(len(known), np.int64)
        for batch in batches:
            texts = clean(batch["text"])
            for a, b in slices(texts, SLICE):
                h, owner = word_hashes(texts[a:b], ALNUM)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                once = np.unique(owner[hit].astype(np.int64) * len(known) + at[hit]) % len(known)
                count += np.bincount(once, minlength=len(known))
        at = np.flatnonzero(count)
        yield pd.DataFrame({"at": at, "n": count[at]})

    out = np.zeros(len(terms), np.int64)
    for r in docs.select("text").mapInPandas(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out


class Queries:
    """The items of one pass: terms, their weights per item, and the corpus figures."""

    def __init__(self, texts: list[str], terms: np.ndarray, df: np.ndarray, n: int, total: int) -> None:
        owner, term, tf = frequencies(texts)
        self.terms, self.n, self.total, self.items = terms, n, total, len(texts)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.owner, self.at, self.weight = owner, np.searchsorted(terms, term), tf * weight[np.searchsorted(terms, term)]
        self.bounds = np.searchsorted(owner, np.arange(len(texts) + 1))

    def norm(self, length: np.ndarray) -> np.ndarray:
        """``m`` of documents of these lengths."""
        return 75 + 25 * length * self.n // max(self.total, 1)

    def tile(self, a: int, b: int) -> np.ndarray:
        """Weights of the terms ``a`` to ``b``, a row per item."""
        out = np.zeros((self.items, b - a))
        here = (self.at >= a) & (self.at < b)
        out[self.owner[here], self.at[here] - a] = self.weight[here]
        return out


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def upper_bounds(q: Queries, rows: int, packed: bytes, length: np.ndarray) -> np.ndarray:
    """Items x documents: no document's score exceeds its bound.  Sums are below 2**53, so the
    products of doubles are exact."""
    docs = len(length)
    bits = np.frombuffer(packed, np.uint8).reshape(rows, -1)
    most = np.append(LEVELS[1:] - 1, 0)[:, None]  # the largest frequency of a level, if not the last
    tf = np.minimum(np.where(most > 0, most, length), length)
    part = np.vstack([np.zeros(docs, np.int64), impact(tf, q.norm(length))])
    out = np.zeros((q.items, docs))
    for a in range(0, len(q.terms), TILE):
        terms = q.terms[a : a + TILE]
        level = np.zeros((len(terms), docs), np.int8)
        left = np.arange(len(terms))
        present = np.full((len(terms), bits.shape[1]), 255, np.uint8)
        for step in range(len(LEVELS)):  # a level counts where all lower ones are set, too
            present = present[:, :] & np.bitwise_and.reduce(bits[_rows_of(mix(terms[left] ^ _SALT[step]), rows)], axis=1)
            some = present.any(axis=1)
            left, present = left[some], present[some]
            if not len(left):
                break
            level[left] += np.unpackbits(present, axis=1, bitorder="little", count=docs).view(np.int8)
        out += q.tile(a, a + len(terms)) @ part[level, np.arange(docs)]
    return out


def exact_scores(q: Queries, texts: list[str], items: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """``(text, item, score)`` of each text for its items."""
    owner, term, tf = frequencies(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    length = np.bincount(owner, weights=tf, minlength=len(texts)).astype(np.int64)
    m = q.norm(length)
    at = np.minimum(np.searchsorted(q.terms, term), max(len(q.terms) - 1, 0))
    known = q.terms[at] == term if len(q.terms) else np.zeros(len(term), bool)
    part = np.zeros(len(q.terms), np.int64)
    for t, wanted in enumerate(items):
        here = slice(bounds[t], bounds[t + 1])
        mine = at[here][known[here]]
        part[mine] = impact(tf[here][known[here]], m[t])
        for item in wanted:
            of = slice(q.bounds[item], q.bounds[item + 1])
            yield t, int(item), int((q.weight[of] * part[q.at[of]]).sum())
        part[mine] = 0


FOUND = "item int, doc bigint, doc_id bigint, bound bigint"


def _bounded(index: DataFrame, q, keep) -> DataFrame:
    """The rows ``(item, doc, doc_id, bound)`` that ``keep(bounds) -> mask`` leaves of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, packed, docs, ids, lengths in zip(*(batch[c] for c in ("rows", "slices", "docs", "ids", "lengths"))):
                docs, ids, lengths = (np.frombuffer(x, np.int64) for x in (docs, ids, lengths))
                bound = upper_bounds(q.value, int(rows), packed, lengths)
                item, at = np.nonzero(keep(bound))
                yield pd.DataFrame({"item": item, "doc": docs[at], "doc_id": ids[at], "bound": bound[item, at].astype(np.int64)})

    return index.mapInPandas(run, FOUND)


def _scored(docs: DataFrame, pairs: DataFrame, q) -> DataFrame:
    """Exact ``(item, doc, doc_id, score)`` of the wanted pairs ``(item, doc)``.  Only texts of
    wanted documents leave their tasks."""
    wanted = materialize(pairs.groupBy("doc").agg(F.collect_set("item").alias("items")), "wanted")  # at most PASS_ITEMS each
    rows = keyed(docs)
    if at_most(wanted, BROADCAST_ROWS):
        rows = rows.join(F.broadcast(wanted.select("doc")), "doc", "left_semi")
    else:
        bitmap, bits = bloom.build(wanted.select("doc"), wanted.count())
        rows = rows.where(bloom.maybe_in(docs.sparkSession.sparkContext.broadcast(bitmap), bits)("doc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, doc, ids = clean(batch["text"]), batch["doc"].to_numpy(np.int64), batch["doc_id"].to_numpy(np.int64)
            items = [np.asarray(x) for x in batch["items"]]
            for a, b in slices(texts, SLICE):
                got = list(exact_scores(q.value, texts[a:b], items[a:b]))
                if got:
                    t, item, score = (np.array(x) for x in zip(*got))
                    yield pd.DataFrame({"item": item, "doc": doc[a + t], "doc_id": ids[a + t], "score": score})

    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))))
    return rows.join(wanted, "doc").mapInPandas(run, "item int, doc bigint, doc_id bigint, score bigint").where("score > 0")


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col(by).desc(), "doc_id", "doc")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pass(docs: DataFrame, index: DataFrame, texts: list[str], n: int, total: int, k: int) -> DataFrame:
    """``(item, rank, doc_id, score)`` for the items of one pass, numbered as in ``texts``."""
    sc = docs.sparkSession.sparkContext
    terms = np.unique(word_hashes(texts, ALNUM)[0])
    q = sc.broadcast(Queries(texts, terms, document_frequency(docs, terms), n, total))  # at most PASS_CHARS of terms

    def highest(bound: np.ndarray) -> np.ndarray:
        if bound.shape[1] <= k:
            return bound > 0
        cut = np.partition(bound, bound.shape[1] - k, axis=1)[:, -k][:, None]
        above = bound > cut
        room = k - above.sum(axis=1, keepdims=True)
        level = bound == cut
        return (above | level & (np.cumsum(level, axis=1) <= room)) & (bound > 0)

    seeds = materialize(_best(_bounded(index, q, highest), "bound", k).select("item", "doc"), "seeds")
    known = _best(_scored(docs, seeds, q), "score", k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low")).collect()
    low = np.ones((len(texts), 1))
    for r in known:  # one row per item of the pass
        low[r["item"], 0] = r["low"] if r["n"] >= k else 1
    held = sc.broadcast(low)
    pairs = materialize(_bounded(index, q, lambda bound: bound >= held.value).select("item", "doc"), "candidates")
    return materialize(_best(_scored(docs, pairs, q), "score", k).select("item", "rank", "doc_id", "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best rows of ``docs(doc_id, text)`` with a
    score above 0 for each row of ``items(item_id, text)``, equal scores by ``doc_id``.

    Null and empty texts have no terms: such documents are not counted and never found, such
    items find nothing.  A repeated row is found as often as it stands in ``docs``, a repeated
    item is answered once for each of its rows.  A row without ``doc_id`` is counted and found
    with a null id, behind equal scores.  Further columns of both tables are ignored; empty
    tables give an empty result.  Items are answered in passes of about ``PASS_ITEMS``.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    wanted = items.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    out = None
    count, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    passes = max(1, -(-count // PASS_ITEMS), -(-chars // PASS_CHARS))
    if count:
        index = index if index is not None else build_index(docs)
        n, total = _gathered(index)
        for k_pass in range(passes if n else 0):
            here = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k_pass).groupBy("item_id", "text").count().collect()
            found = _pass(docs, index, [r["text"] for r in here], n, total, k) if here else None
            if found is not None:
                names = spark.createDataFrame([(i, r["item_id"], r["count"]) for i, r in enumerate(here)], "item int, item_id bigint, times bigint")
                found = found.join(F.broadcast(names), "item").select(
                    "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"),
                    "score", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")
                out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
