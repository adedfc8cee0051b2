"""Fixture views: the reference's data model derived from the driver's tables.

Every view is a pure projection/filter of an input table, so its size grows with the input and
the same expression is written in DuckDB SQL for the oracle (``folio.plans.oracle``).
Defects are planted on purpose (bad year suffix, file name without a page, blank page) so that
validation and quarantine have work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import spread
from folio.sources.tables import table

# The fixture rules (see FIXTURES.md).
YEAR_BASE = 2000
YEAR_SPAN = 24
BAD_YEAR_EVERY = 97  # doc key ends in "draft"
NO_PAGE_EVERY = 89  # file name without "_page_"
BLANK_PAGE_EVERY = 83  # no image and no content
STORED_EVERY = 3  # already in the page store
LEVEL3_NULL_EVERY = 5  # third rephrasing missing


def corpus(spark: SparkSession, base: str) -> DataFrame:
    """Corpus rows (id, key with year suffix, image file name, page image, OCR text).

    The page "image" is the UTF-8 text of the document; the OCR stand-in decodes it.
    """
    d = spread(table(spark, base, "documents"), "doc_id")
    year_part = F.when(F.col("doc_id") % BAD_YEAR_EVERY == 0, F.lit("draft")).otherwise(
        (YEAR_BASE + F.col("doc_id") % YEAR_SPAN).cast("string")
    )
    doc_key = F.concat(F.col("source"), F.lit("_"), year_part)
    page_part = (F.col("doc_id") % 300).cast("string")
    file_name = F.when(
        F.col("doc_id") % NO_PAGE_EVERY == 0, F.concat(doc_key, F.lit("_"), page_part, F.lit(".png"))
    ).otherwise(F.concat(doc_key, F.lit("_page_"), page_part, F.lit(".png")))
    blank = F.col("doc_id") % BLANK_PAGE_EVERY == 0
    return d.select(
        F.col("doc_id").alias("corpus_id"),
        doc_key.alias("doc_key"),
        file_name.alias("image_filename"),
        F.when(~blank, F.col("text").cast("binary")).alias("image"),
        F.when(~blank, F.col("text")).alias("markdown_content"),
    )


def stored_ids(spark: SparkSession, base: str) -> DataFrame:
    """Ids already in the page store before an ingest run."""
    return corpus(spark, base).where(F.col("corpus_id") % STORED_EVERY == 0).select("corpus_id")


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """Vector points: ``embeddings`` plus a year list and a per-row query year filter."""
    e = table(spark, base, "embeddings")
    y = YEAR_BASE + F.col("vec_id") % YEAR_SPAN
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.col("label"),
        F.array(y, y - 1, y - 2, y - 3).cast("array<int>").alias("years"),
        F.when(F.col("vec_id") % 2 == 0, (YEAR_BASE + (F.col("vec_id") + 5) % YEAR_SPAN).cast("int")).alias(
            "query_year"
        ),
    )


def questions(spark: SparkSession, base: str) -> DataFrame:
    """Question set from ``benchmark``: original text and three rephrasings, plus a year.

    Two rephrasings mention a report, so the router sends them to retrieval while the other
    two are answered from the dialogue."""
    b = table(spark, base, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("original"),
        F.concat(F.lower("text"), F.lit(" in the annual report")).alias("rephrase_level_1"),
        F.regexp_replace("text", r"[.,;:!?]", "").alias("rephrase_level_2"),
        F.when(F.col("item_id") % LEVEL3_NULL_EVERY != 0, F.concat(F.col("text"), F.lit(" Which report says so?"))).alias(
            "rephrase_level_3"
        ),
        F.when(F.col("item_id") % 2 == 0, (YEAR_BASE + F.col("item_id") % YEAR_SPAN).cast("int")).alias("year"),
    )


def turns(spark: SparkSession, base: str) -> DataFrame:
    """Conversation turns; user turns get a phrase that sets, shifts or clears the year."""
    c = table(spark, base, "conversations")
    h = F.col("conv_id") * 7 + F.col("turn") * 3
    action = (
        F.when(F.col("role") != "user", F.lit(None))
        .when(h % 5 == 0, F.lit("SET"))
        .when(h % 5 == 1, F.lit("RELATIVE"))
        .when(h % 11 == 2, F.lit("CLEAR"))
        .otherwise(F.lit("KEEP"))
    )
    set_year = (YEAR_BASE + (F.col("conv_id") + F.col("turn")) % YEAR_SPAN).cast("string")
    text = (
        F.when(action == "SET", F.concat(F.col("text"), F.lit(" What was the revenue in "), set_year, F.lit("?")))
        .when(action == "RELATIVE", F.concat(F.col("text"), F.lit(" And the year before?")))
        .when(action == "CLEAR", F.concat(F.col("text"), F.lit(" On another subject: who leads the board?")))
        .otherwise(F.col("text"))
    )
    return c.select(
        F.col("conv_id").alias("thread_id"),
        F.col("turn").cast("int").alias("turn"),
        F.col("role"),
        text.alias("content"),
    )


def judge_raw(spark: SparkSession, base: str) -> DataFrame:
    """Raw judge outputs from ``labels``: valid JSON, malformed JSON and off-scale ratings."""
    lab = table(spark, base, "labels")
    rating = F.when(F.col("toxic") == 1, F.lit(2)).otherwise(F.col("quality") * 4)
    raw = (
        F.when(F.col("doc_id") % 13 == 0, F.lit('{"reasoning": "cut off'))
        .when(F.col("doc_id") % 17 == 0, F.lit('{"reasoning": "off scale", "answer_accuracy": 3}'))
        .otherwise(
            F.concat(
                F.lit('{"reasoning": "label '),
                F.col("quality").cast("string"),
                F.lit("/"),
                F.col("toxic").cast("string"),
                F.lit('", "answer_accuracy": '),
                rating.cast("string"),
                F.lit("}"),
            )
        )
    )
    return lab.select(F.col("doc_id").alias("row_id"), raw.alias("raw"))
