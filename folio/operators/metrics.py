"""Figures over stored evaluations and over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio import schemas

ALL = "all"


def score_rollup(records: DataFrame) -> DataFrame:
    """``(difficulty, n, mean_accuracy, share_<rating>...)`` for each difficulty and, as ``all``, for
    the whole: one partial aggregation with grouping sets."""
    shares = [F.avg((F.col("answer_accuracy") == r).cast("int")).alias(f"share_{r}") for r in sorted(schemas.RATINGS)]
    rolled = records.rollup("difficulty").agg(
        F.grouping("difficulty").alias("_whole"), F.count(F.lit(1)).alias("n"), F.avg("answer_accuracy").alias("mean_accuracy"), *shares)
    names = F.when(F.col("_whole") == 1, ALL).otherwise(F.col("difficulty"))
    return rolled.select(names.alias("difficulty"), *(c for c in rolled.columns if c not in ("difficulty", "_whole")))


def ranked_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5), key: str = "query_id", id_col: str = "corpus_id") -> DataFrame:
    """``(k, n_queries, recall, hit_rate, mrr)`` of the first ``k`` hits, for each ``k``.

    ``hits`` has ``rank`` from 1, ``relevant`` the relevant ids of each query (repeated rows count
    once).  Every query with a relevant id counts, also one without any hit; others do not.  Hits
    are summed per query before the ``ks`` are applied, so a query with many relevant pages is no
    larger than its hits.
    """
    wanted = relevant.select(key, id_col).where(F.col(key).isNotNull() & F.col(id_col).isNotNull()).distinct()
    size = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("_relevant"))
    top = hits.where(F.col("rank") <= max(ks)).select(key, id_col, "rank")
    found = top.join(wanted, [key, id_col]).groupBy(key).agg(
        *(F.count_if(F.col("rank") <= k).alias(f"_found_{k}") for k in ks), F.min("rank").alias("_first"))
    each = size.join(found, key, "left")
    per_k = F.explode(F.array(*(F.struct(
        F.lit(k).alias("k"), F.coalesce(F.col(f"_found_{k}") / F.col("_relevant"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.when(F.col("_first") <= k, 1.0 / F.col("_first")), F.lit(0.0)).alias("rr")) for k in ks))).alias("m")
    rows = each.select(per_k).select("m.*")
    return rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"), F.avg((F.col("rr") > 0).cast("int")).alias("hit_rate"), F.avg("rr").alias("mrr"))
