"""Derived tables shared by the registered queries: stored pages, indexes, vectors, answers.

Each is built once per Spark application and input folder, written to the shared work folder
(``spark.checkpoint.dir``) and read back, so later queries scan files instead of re-running
tokenisation or embedding, and a lost executor re-reads instead of recomputing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.embed import DEFAULT_DIM, HASHED
from folio.operators import ingest
from folio.operators.bm25 import TextIndex, build_index
from folio.operators.fusion import page_bucket
from folio.operators.passages import containment_pairs
from folio.session import materialize
from folio.sources import fixtures
from folio.sources.tables import table

_CACHE: dict[tuple, object] = {}


def _cached(spark: SparkSession, base: str, what: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, base.rstrip("/"), what)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def validated_pages(spark: SparkSession, base: str) -> DataFrame:
    """All corpus rows as page rows with ``reject_reason`` (no store lookup)."""
    return ingest.ingest(fixtures.corpus(spark, base))


def page_store(spark: SparkSession, base: str) -> DataFrame:
    """The page store: every accepted page row, written once, in folders by ``_bucket``, so that a
    few pages are read without the others (``fusion.rerank``).  Each task writes the buckets of its
    own rows: pages are not shuffled for it, and the tasks follow the size of the corpus."""
    def build():
        pages = ingest.accepted(validated_pages(spark, base)).withColumn("_bucket", page_bucket(F.col("corpus_id")))
        return materialize(pages, "pages", ["_bucket"])

    return _cached(spark, base, "pages", build)


def stored_pages(spark: SparkSession, base: str) -> DataFrame:
    """The columns of the page store."""
    return page_store(spark, base).drop("_bucket")


def page_index(spark: SparkSession, base: str) -> TextIndex:
    """Full-text index over ``text_content`` of the stored pages, with the year companion."""
    return _cached(spark, base, "page-index", lambda: build_index(stored_pages(spark, base)))


def answers(spark: SparkSession, base: str) -> DataFrame:
    """Relevance judgements: ``(query_id, corpus_id, answer)`` for each document containing a
    benchmark passage; the answer is the whole passage."""
    def build():
        bench = table(spark, base, "benchmark")
        pairs = containment_pairs(bench, table(spark, base, "documents"))
        out = pairs.join(bench, "item_id").select(
            F.col("item_id").alias("query_id"), F.col("doc_id").alias("corpus_id"), F.col("text").alias("answer")
        )
        return materialize(out, "answers")

    return _cached(spark, base, "answers", build)


def page_vectors(spark: SparkSession, base: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Vector points of the stored pages: ``(id, v_idx, v_val, years)`` and the other payload
    fields, from the hashed embedder over ``markdown_content``; pages without a token get no
    point."""
    def build():
        pages = ingest.embeddable(stored_pages(spark, base))
        vecs = HASHED.document(pages.select(F.col("corpus_id").alias("id"), "markdown_content"),
                                ["id"], "markdown_content", dim)
        payload = pages.select(F.col("corpus_id").alias("id"), F.col("probable_referenced_years").alias("years"),
                               "doc_id", "page", "exact_filename")
        return materialize(vecs.join(payload, "id"), "page-vectors")

    return _cached(spark, base, f"page-vectors-{dim}", build)
