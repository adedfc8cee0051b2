"""Page ingestion: derived fields, validation, skip-existing, insert-if-absent, first-n.

One lazy plan per run: ``scan → derive → anti-join with the store → (OCR) → clean →
validate → append``.  Nothing is batched by hand; the anti-join takes the whole store at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import clean_text, page_number, referenced_years
from folio.session import bounded_broadcast, materialize

PAGE_COLUMNS = [
    "corpus_id",
    "doc_id",
    "page",
    "exact_filename",
    "probable_referenced_years",
    "markdown_content",
    "text_content",
]


def derive_years(corpus: DataFrame, key_col: str = "doc_key") -> DataFrame:
    """Adds ``probable_referenced_years`` = [y, y-1, y-2, y-3] from the key's 4-digit suffix."""
    return corpus.withColumn("probable_referenced_years", referenced_years(F.col(key_col)))


def derive_page(corpus: DataFrame, file_col: str = "image_filename") -> DataFrame:
    """Adds ``page`` = first ``_page_<n>`` of the file name (null when absent)."""
    return corpus.withColumn("page", page_number(F.col(file_col)))


def first_n(df: DataFrame, n: int | None, order_by: str | list[str] = "corpus_id") -> DataFrame:
    """The first ``n`` rows in a stable order (all rows when ``n`` is None).

    Call it before costly columns are added: Spark evaluates projections below an ordered limit
    on every row.
    """
    if n is None:
        return df
    return df.orderBy(order_by).limit(n)


def to_page_rows(corpus: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Corpus rows with OCR text → page rows in the stored layout (not yet validated), with the
    columns to ``keep`` besides."""
    with_fields = derive_page(derive_years(corpus))
    return with_fields.select(
        F.col("corpus_id").try_cast("bigint").alias("corpus_id"),
        F.col("doc_key").alias("doc_id"),
        F.col("page"),
        F.col("image_filename").alias("exact_filename"),
        F.col("probable_referenced_years"),
        F.col("markdown_content"),
        clean_text(F.col("markdown_content")).alias("text_content"),
        *keep,
    )


def _reasons(df: DataFrame) -> Column:
    checks = [
        (F.col("corpus_id").isNull(), "null_id"),
        (F.col("doc_id").isNull(), "null_doc_id"),
        (F.col("probable_referenced_years").isNull(), "bad_year"),
        (F.col("page").isNull(), "no_page"),
        (F.col("exact_filename").isNull(), "null_filename"),
        (F.col("markdown_content").isNull(), "null_content"),
    ]
    reasons = [F.when(cond, F.lit(name)) for cond, name in checks]
    if "ocr_error" in df.columns:  # why there is no content
        reasons.append(F.when(F.col("ocr_error").isNotNull(), F.concat(F.lit("ocr: "), F.col("ocr_error"))))
    return F.concat_ws(";", *reasons)


def validate_pages(rows: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (``''`` when the row fits the page schema)."""
    return rows.withColumn("reject_reason", _reasons(rows))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason") == "").select(*PAGE_COLUMNS)


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason") != "")


#: Ids that are broadcast at most; beyond it the join is one of exchanges.
MAX_BROADCAST_IDS = 2_000_000


def skip_existing(incoming: DataFrame, existing_ids: DataFrame, key: str = "corpus_id",
                  tie_break: str = "image_filename") -> DataFrame:
    """Incoming rows whose id is not in the store, one row per id (lowest ``tie_break`` wins).

    Only ids are shuffled to find out which ones are stored or come more than once.  Rows of all
    other ids stay where they are read, whole images included; rows of repeated ids alone go
    through the dedupe window.  Rows without an id are nobody's duplicate: all of them are kept,
    for validation to reject.
    """
    counted = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    stored = existing_ids.select(key).distinct().withColumn("_stored", F.lit(True))
    doubtful = counted.join(stored, key, "left").where((F.col("_n") > 1) | F.col("_stored"))
    doubtful = materialize(doubtful.select(key, F.coalesce("_stored", F.lit(False)).alias("_stored")), "known-ids")
    marked = bounded_broadcast(doubtful, MAX_BROADCAST_IDS)
    fresh = incoming.join(marked.select(key), key, "left_anti").select(*incoming.columns)  # also rows without an id
    again = incoming.join(marked.where("not _stored").select(key), key, "left_semi").select(*incoming.columns)
    w = Window.partitionBy(key).orderBy(F.col(tie_break).asc_nulls_last())
    return fresh.unionByName(again.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def insert_if_absent(new: DataFrame, target: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of ``new`` with no identical row (all columns, nulls equal) in ``target``.

    ``key`` (the first column by default) and a hash of the row decide which rows can have a twin,
    in ``target`` or in ``new``; all others are passed on.  Only rows that can are compared whole,
    so equal hashes of different rows are told apart.
    """
    cols = new.columns
    key = key or cols[0]
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*cols))
    left, right = hashed(new), hashed(target.select(*cols))
    mine = left.select(F.col(key).alias("_k"), "_h").groupBy("_k", "_h").agg(F.count(F.lit(1)).alias("_n"))
    there = right.select(F.col(key).alias("_tk"), F.col("_h").alias("_th")).distinct()
    twins = mine.join(there, mine["_k"].eqNullSafe(there["_tk"]) & (mine["_h"] == there["_th"]), "left")
    twins = materialize(twins.where("_n > 1 or _th is not null").select("_k", F.col("_h").alias("_hk")), "twins")
    near = bounded_broadcast(twins, MAX_BROADCAST_IDS)
    met = lambda df: df[key].eqNullSafe(near["_k"]) & (df["_h"] == near["_hk"])
    alone = left.join(near, met(left), "left_anti").select(*cols)
    few = left.join(near, met(left), "left_semi").dropDuplicates(cols)
    held = right.join(near, met(right), "left_semi").select(F.col(key).alias("_tk"), F.col("_h").alias("_th"), F.struct(*cols).alias("_row"))
    same = few[key].eqNullSafe(held["_tk"]) & (few["_h"] == held["_th"]) & F.struct(*[few[c] for c in cols]).eqNullSafe(held["_row"])
    return alone.unionByName(few.join(held, same, "left_anti").select(*cols))


def embeddable(pages: DataFrame) -> DataFrame:
    """Pages that can be embedded: content and id both present (pushed to the scan)."""
    return pages.where(F.col("markdown_content").isNotNull() & F.col("corpus_id").isNotNull())


def ingest(corpus: DataFrame, existing_ids: DataFrame | None = None) -> DataFrame:
    """Corpus with OCR text → validated page rows (with ``reject_reason``), store ids skipped."""
    if existing_ids is not None:
        corpus = skip_existing(corpus, existing_ids)
    return validate_pages(to_page_rows(corpus))


def append(df: DataFrame, path: str) -> None:
    """Append rows to a parquet table; an empty frame writes no file."""
    df.write.mode("append").parquet(path)
