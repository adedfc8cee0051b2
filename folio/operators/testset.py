"""Question set: answers joined with questions, then the four phrasings unpivoted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrasing columns and their difficulty labels, in this order.
PHRASINGS = [
    ("original", "original"),
    ("rephrase_level_1", "level_1"),
    ("rephrase_level_2", "level_2"),
    ("rephrase_level_3", "level_3"),
]


def testset_join(answers: DataFrame, questions: DataFrame, key: str = "query_id") -> DataFrame:
    """Inner equi-join on the question id; several answers per question fan out."""
    q = questions.select(key, *[c for c, _ in PHRASINGS])
    return answers.select(key, "corpus_id", "answer").join(q, key, "inner")


def testset_unpivot(joined: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per (answer, phrasing): ``(query_id, difficulty, query_text, answer)``.

    A single ``Expand`` over one scan of the join; null phrasings are kept.
    """
    renamed = joined.select(key, "answer", *[F.col(c).alias(label) for c, label in PHRASINGS])
    return renamed.unpivot(
        [key, "answer"], [label for _, label in PHRASINGS], "difficulty", "query_text"
    ).select(key, "difficulty", "query_text", "answer")
