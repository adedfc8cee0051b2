"""A corpus cleaning job: five stages from the raw documents to token digests.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame.  ``run`` applies them to ``documents``; every stage's result is written as
Parquet to the shared work folder and read back as the next one's ``docs``.  All stages but the
last return the columns they were given.

Rows with null texts pass every filter on the same terms as empty texts; rows without an id are
kept by the near-duplicate stage, since nothing can be said to be a copy of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, decontam, jaccard, quality, queries, secret_scan
from folio.session import materialize, ship_package
from folio.sources.tables import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, trained on the labels of this input."""
    ship_package(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    kept = quality.score(docs.withColumns({f"__in_{c}": F.col(c) for c in docs.columns}), model).where("predicted = 1")
    return kept.select(*(F.col(f"__in_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id."""
    ship_package(spark)
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found, copied or paraphrased."""
    ship_package(spark)
    flagged = decontam.flag(docs.withColumns({f"__in_{c}": F.col(c) for c in docs.columns}), table(spark, sf_dir, "benchmark"))
    return flagged.where(F.size("leaks") == 0).select(*(F.col(f"__in_{c}").alias(c) for c in docs.columns))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every found secret replaced by a mark and ``n_chars`` counted anew."""
    ship_package(spark)
    found = secret_scan.scan(docs.withColumns({f"__in_{c}": F.col(c) for c in docs.columns}), secret_scan.train(docs))
    clean = F.col("secrets.redacted")
    new = {"text": F.coalesce(clean, F.col("__in_text")), "n_chars": F.when(clean.isNull(), F.col("__in_n_chars")).otherwise(F.char_length(clean))} if "n_chars" in docs.columns else {"text": F.coalesce(clean, F.col("__in_text"))}
    return found.select(*(new.get(c, F.col(f"__in_{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each remaining document."""
    ship_package(spark)
    return bpe.round_trip(docs, queries.vocabulary())


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("bpe_encoding", encode),
]

#: Training and linkage cannot be written as SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
