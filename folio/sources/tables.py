"""Reading the input tables and the corpus by name and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schemas

INPUT_TABLES = (
    "documents",
    "benchmark",
    "embeddings",
    "pages",
    "conversations",
    "labels",
)

SPLITS = ("train", "validation", "test")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One input table stored as ``{base}/{name}.parquet``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_corpus(spark: SparkSession, base: str, name: str = "corpus", split: str = "test") -> DataFrame:
    """A named dataset split stored as ``{base}/{name}/{split}``, read with the corpus schema.

    An unknown split is an error, as for the hosted datasets the corpus comes from.
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; expected one of {SPLITS}")
    return spark.read.schema(schemas.CORPUS).parquet(f"{base.rstrip('/')}/{name}/{split}")


#: What Spark's file source gives for a file.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def image_files(spark: SparkSession, folder: str, pattern: str = "*", streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """``(image_filename, image, path)`` of the files under ``folder`` and its subfolders whose names
    fit ``pattern``; with ``streaming``, of the new files of each trigger (at most ``max_files``)."""
    if streaming:
        reader = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", max_files)
    else:
        reader = spark.read.format("binaryFile")
    files = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("image_filename"), F.col("content").alias("image"), "path")


def corpus_of_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Corpus rows from image files and a ``listing(corpus_id, doc_key, image_filename)``.

    A batch keeps every row of the listing, without an image where the file is missing, so that
    validation can name it; a stream has the rows of the files that came.  Images are not shuffled
    where the listing is small enough to broadcast; Spark decides that from its size."""
    names = listing.select("corpus_id", "doc_key", "image_filename")
    if files.isStreaming:
        return files.join(names, "image_filename").select([f.name for f in schemas.CORPUS.fields])
    return names.join(files, "image_filename", "left").select([f.name for f in schemas.CORPUS.fields])
