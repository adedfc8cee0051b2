"""Schemas of the data model: corpus rows, stored pages, vector points, evaluation records."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType(
    [
        T.StructField("corpus_id", T.LongType()),
        T.StructField("doc_key", T.StringType()),
        T.StructField("image_filename", T.StringType()),
        T.StructField("image", T.BinaryType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("corpus_id", T.LongType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("exact_filename", T.StringType(), False),
        T.StructField("probable_referenced_years", T.ArrayType(T.IntegerType()), False),
        T.StructField("markdown_content", T.StringType(), False),
        T.StructField("text_content", T.StringType(), False),
    ]
)

PAYLOAD = T.StructType([f for f in PAGE.fields if f.name != "text_content"])

SPARSE_VECTOR = T.ArrayType(
    T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("w", T.DoubleType())])
)

EVALUATION = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("difficulty", T.StringType(), False),
        T.StructField("query_text", T.StringType(), False),
        T.StructField("answer", T.StringType(), False),
        T.StructField("generated_response", T.StringType(), False),
        T.StructField("time", T.TimestampType(), False),
        T.StructField("reasoning", T.StringType(), False),
        T.StructField("answer_accuracy", T.IntegerType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("logic_steps", T.StringType(), False),
        T.StructField("summary_sources", T.StringType(), False),
        T.StructField("sources", T.ArrayType(T.StringType()), False),
    ]
)

JUDGE = T.StructType(
    [T.StructField("reasoning", T.StringType()), T.StructField("answer_accuracy", T.IntegerType())]
)

# The rating scale of the judge.
RATINGS = (0, 2, 4)
