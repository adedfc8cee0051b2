"""Evaluation: answer every phrasing of every question, judge it, validate and store it."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio import schemas
from folio.operators import answers as A
from folio.operators.bm25 import TextIndex
from folio.operators.ingest import first_n
from folio.operators.testset import PHRASINGS
from folio.session import at_most, materialize

log = logging.getLogger(__name__)

ANSWER_FIELDS = ["logic_steps", "generated_response", "summary_sources", "sources"]


def generate_answers(testset: DataFrame, index: TextIndex, points: DataFrame, pages: DataFrame,
                     top_k: int = 3, limit: int | None = None) -> DataFrame:
    """Testset rows ``(query_id, difficulty, query_text, answer)`` plus the four answer fields.

    Each distinct question text is answered once (a fresh thread per question) and joined back
    to its rows; a row without a question text gets the error answer.  ``limit`` keeps the
    first rows by (query_id, difficulty) — None answers everything.
    """
    rows = first_n(testset, limit, ["query_id", "difficulty", "answer"])
    # One numeric key per distinct question text: the smallest (question, phrasing) row key
    # carrying it, so searches join on short keys, not on the text.
    labels = F.array(*[F.lit(label) for _, label in PHRASINGS])
    row_key = F.col("query_id") * (len(PHRASINGS) + 1) + F.array_position(labels, F.col("difficulty"))
    texts = rows.where(F.col("query_text").isNotNull()).groupBy("query_text").agg(
        F.min(row_key).alias("qkey")).select("qkey", F.col("query_text").alias("text"))
    answered = A.answer_questions(texts, index, points, pages, "qkey", "text", top_k).join(
        texts, "qkey").select("text", "answer")
    j = rows.join(answered, rows["query_text"] == answered["text"], "left")
    ans = F.coalesce(answered["answer"], A._error_answer())
    return j.select("query_id", "difficulty", "query_text", rows["answer"],
                    *[ans[f].alias(f) for f in ANSWER_FIELDS])


def judge_answers(answered: DataFrame, model: str = A.JUDGE_MODEL) -> DataFrame:
    """Adds ``reasoning``, ``answer_accuracy`` (0/2/4), ``model`` and ``time``."""
    raw = A.judge_stand_in(F.col("answer"), F.col("generated_response"))
    return answered.withColumn("_j", A.parse_judgement(raw)).select(
        "*", F.col("_j.reasoning").alias("reasoning"), F.col("_j.answer_accuracy").alias("answer_accuracy"),
        F.lit(model).alias("model"), F.current_timestamp().alias("time")).drop("_j")


def validate_evaluations(records: DataFrame) -> DataFrame:
    """Records cast to the 12-field schema, with ``reject_reason`` ('' when valid)."""
    cols = []
    checks = []
    for f in schemas.EVALUATION.fields:
        c = F.col(f.name).try_cast(f.dataType) if f.name in records.columns else F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
        checks.append(F.when(F.col(f.name).isNull(), F.lit(f"null_{f.name}")))
    checks.append(F.when(~F.col("answer_accuracy").isin(*schemas.RATINGS), F.lit("rating_out_of_scale")))
    typed = records.select(*cols)
    return typed.withColumn("reject_reason", F.concat_ws(";", *checks))


def store_evaluation(records: DataFrame, path: str, on_error: str = "quarantine") -> DataFrame | None:
    """Validate and append records to the evaluation table at ``path``; returns the table.

    ``on_error='fail'`` stops before writing anything when a record is invalid (the reference
    behaviour); ``'quarantine'`` writes valid rows and puts the others, with their reason,
    under ``path/_rejected``.  No record at all: a warning and nothing written.
    """
    spark = records.sparkSession
    # Written once: both outputs below read the file, not the (model-calling) lineage.
    checked = materialize(validate_evaluations(records), "evaluations-checked")
    if at_most(checked, 0):
        log.warning("no evaluation record to store")
        return None
    bad = checked.where(F.col("reject_reason") != "")
    if on_error == "fail":
        if not at_most(bad, 0):
            raise ValueError("evaluation records do not fit the schema: " + bad.first()["reject_reason"])
    elif on_error == "quarantine":
        bad.write.mode("append").parquet(f"{path}/_rejected")
    else:
        raise ValueError(f"on_error must be fail or quarantine, not {on_error!r}")
    good = checked.where(F.col("reject_reason") == "").drop("reject_reason")
    good.write.mode("append").parquet(f"{path}/records")
    return spark.read.parquet(f"{path}/records")
