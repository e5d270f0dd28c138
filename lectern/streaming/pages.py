"""An extension: cleaning of pages as they arrive, without the book-level steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def stream_clean(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files with doc_id and text -> doc_id, lines that are no noise, words."""
    pages = spark.readStream.schema(schema).parquet(path)
    lines = F.filter(F.split("text", "\n"), lambda x: (T.strip(x) != "") & ~T.is_noise(x))
    return pages.select("doc_id", F.array_join(F.transform(lines, T.norm_line), "\n").alias("text"), T.word_count(F.col("text")).alias("words"))
