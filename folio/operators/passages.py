"""Exact passage containment between two text tables, without comparing all pairs.

A passage can only be contained in a document that has every *interior* token of the passage
as a whole token (the first and last tokens may be cut mid-word); one without interior tokens is
found by its runs of characters.  So each passage is keyed by
its rarest interior token (smallest document frequency, ties by the token), candidates come
from an equi-join of that key with the documents' (term, document) pairs, and each candidate
is verified with a substring test.  Work grows with the documents' tokens and the postings of
the chosen keys, never with passages × documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import token_pieces, tokens
from folio.session import bounded_broadcast, materialize, spread

MAX_BROADCAST_CANDIDATES = 1_000_000


def _grams(text, size: int):
    """Distinct runs of ``size`` characters of a text (the empty run for size 0)."""
    if size == 0:
        return F.array(F.lit(""))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    # bound by a one-element array, so that a text is split once and not once per position
    runs = F.transform(F.array(chars), lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(c) - size + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(c, i, F.lit(size)), "")))
    return runs[0]


def _doc_keys(docs: DataFrame, vocabulary: DataFrame, pieces) -> DataFrame:
    """``(doc_id, term)`` of the keys that occur in ``vocabulary``, once per document."""
    split = docs.select("doc_id", pieces.alias("_p"))
    found = split.select("doc_id", F.explode_outer("_p").alias("term")).join(vocabulary, "term", "left_semi")
    return found.distinct()


def _verified(keys: DataFrame, doc_keys: DataFrame, passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs found by each passage's rarest key and confirmed by a substring test."""
    df = doc_keys.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    keyed = keys.join(df, "term").groupBy("passage_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    cands = doc_keys.join(bounded_broadcast(keyed, MAX_BROADCAST_CANDIDATES, bound_by=passages), "term").select(
        "passage_id", "doc_id")
    cands = materialize(cands, "passage-candidates")
    # only the texts of candidates are shuffled
    some = bounded_broadcast(cands.select("doc_id").distinct(), MAX_BROADCAST_CANDIDATES, bound_by=cands)
    few = docs.join(some, "doc_id", "left_semi")
    return cands.join(passages, "passage_id").join(few, "doc_id").where(F.col("_d").contains(F.col("_p"))).select("passage_id", "doc_id")


def containment_pairs(passages: DataFrame, docs: DataFrame, passage_id: str = "item_id",
                      passage_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """``(passage_id, doc_id)`` for every document whose text contains the passage verbatim.

    Document tokens are kept only when they occur in some passage (a size-checked broadcast
    semi-join right after the explode), so document frequencies and candidates come from one
    scan of the documents without building a full index.  Passages with fewer than three
    tokens have no interior token; they are keyed by runs of up to three characters instead, in
    a second scan that is only made when there are such passages.  An empty passage is in every
    document; null texts contain nothing and are contained in nothing.
    """
    p = passages.where(F.col(passage_text).isNotNull()).select(
        F.col(passage_id).alias("passage_id"), F.col(passage_text).alias("_p"))
    def texts(df: DataFrame) -> DataFrame:
        return df.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_d"))

    # dealt out to be split into tokens; candidates are read where they lie
    d, dealt = texts(docs), texts(spread(docs, doc_id))
    toks = p.withColumn("_t", tokens(F.col("_p")))
    keys = toks.where(F.size("_t") >= 3).select(
        "passage_id", F.explode(F.array_distinct(F.slice("_t", 2, F.size("_t") - 2))).alias("term"))
    vocab = bounded_broadcast(keys.select("term").distinct(), MAX_BROADCAST_CANDIDATES, bound_by=keys)
    doc_terms = materialize(_doc_keys(dealt, vocab, token_pieces(F.col("_d"))), "passage-doc-terms")
    out = _verified(keys, doc_terms, p, d)
    short = toks.where(F.size("_t") < 3).select(
        "passage_id", "_p", F.least(F.char_length("_p"), F.lit(3)).alias("size"))
    for row in sorted(short.select("size").distinct().collect()):  # at most the sizes 0 to 3
        size = row["size"]
        own = short.where(F.col("size") == size)
        grams = own.select("passage_id", F.explode(F.array_distinct(_grams(F.col("_p"), size))).alias("term"))
        vocab = bounded_broadcast(grams.select("term").distinct(), MAX_BROADCAST_CANDIDATES, bound_by=grams)
        doc_grams = materialize(_doc_keys(dealt, vocab, _grams(F.col("_d"), size)), "passage-doc-grams")
        out = out.unionByName(_verified(grams, doc_grams, own.select("passage_id", "_p"), d))
    return out.select(F.col("passage_id").alias(passage_id), F.col("doc_id").alias(doc_id))
