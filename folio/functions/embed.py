"""Hashed bag-of-words embedder: the deterministic stand-in for an embedding model.

A page or query becomes a sparse, L2-normalised vector: each token adds its count to bucket
``md5(token)[:8] mod dim``.  It is computed with JVM-side functions and two exchanges of counts;
cosine similarity of two such vectors is the dot product of their sparse entries.

Embedding models treat documents and questions differently.  An ``Embedder`` is the pair of both
modes; ``model_embedder`` makes one from a client (through :func:`folio.functions.enrich.enrich`)
that is told the mode with each row and returns dense vectors.  ``HASHED`` is the same in both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.enrich import enrich
from folio.functions.text import hash_bucket, token_pieces

DEFAULT_DIM = 64


def hashed_embedding(rows: DataFrame, keys: list[str], text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """``(keys..., v_idx array<int>, v_val array<double>)``: sparse L2-normalised vectors.

    Rows without a token get no vector.  Two shuffles: counts per (row, bucket), partially
    aggregated in the tokenising task, then at most ``dim`` entries per row are gathered.
    """
    pieces = token_pieces(F.col(text_col))
    counts = (
        rows.select(*keys, F.explode_outer(pieces).alias("term"))
        .where(F.col("term") != "")
        .select(*keys, hash_bucket(F.col("term"), dim).alias("bucket"))
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    gathered = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "c"))).alias("e"),
        F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"),
    )
    return gathered.select(
        *keys,
        F.transform("e", lambda x: x["bucket"]).alias("v_idx"),
        F.transform("e", lambda x: x["c"] / F.col("norm")).alias("v_val"),
    )


@dataclass(frozen=True)
class Embedder:
    """Functions ``(rows, keys, text_col, dim) -> keys and vector columns`` for stored texts and for
    questions; both must give vectors of one space."""

    document: Callable[..., DataFrame]
    query: Callable[..., DataFrame]


HASHED = Embedder(hashed_embedding, hashed_embedding)
DOCUMENT, QUERY = "document", "query"


def model_embedder(make_client, **options) -> Embedder:
    """An embedder of dense vectors from a model client.

    The client gets frames with ``text`` and ``mode`` (``document`` or ``query``) and returns frames
    with ``vector``.  Texts that fail under ``on_error="drop"``, and vectors of a length other than
    ``dim``, give no row and an error respectively.  ``options`` are those of ``enrich``.
    """
    def embed(mode: str, rows: DataFrame, keys: list[str], text_col: str, dim: int) -> DataFrame:
        schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("vector", T.ArrayType(T.DoubleType()))])
        asked = rows.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("text"), F.lit(mode).alias("mode"))
        out = enrich(asked, make_client, schema, **options)
        wrong = F.raise_error(F.lit(f"the model's vectors do not have {dim} dimensions")).cast("array<double>")
        return out.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(wrong))

    return Embedder(partial(embed, DOCUMENT), partial(embed, QUERY))


def sparse_entries(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Explode sparse vectors to ``(keys..., bucket, w)``."""
    return vectors.select(*keys, F.posexplode("v_idx").alias("_i", "bucket"), "v_val").select(
        *keys, "bucket", F.element_at("v_val", F.col("_i") + 1).alias("w"))
