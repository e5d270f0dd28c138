"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage works on all that the stage before it kept, and returns the columns of
documents; the last returns the packed pieces. A document is dropped if it is scored
toxic, if line dedup takes all its lines, if it is a near copy of a document with a
smaller doc_id, or if it holds a benchmark item. Near copies are those of five-word
shingles with a similarity of 0.8 or more, as stages take them unless a contract says
otherwise.

Defined cases: null texts are empty and stay (line dedup takes nothing from them); where a
doc_id is repeated, a decision about it holds for all its rows, and line dedup's text is
that of each row; a row with a null doc_id is named by no decision, so it is not dropped
but by line dedup; empty tables pass through; further columns of documents are carried on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import shared_dir
from lectern.llm.decontamination import decontaminate
from lectern.llm.line_dedup import line_dedup
from lectern.llm.near_dedup import near_dedup
from lectern.llm.packing import best_fit_packing
from lectern.llm.toxicity import toxicity


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows of the rejected ids; what the ids are dealt or sent for is left to Spark, by their size."""
    return docs.join(ids.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").select(docs.columns)


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.where("predicted = 1"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs, carry=True).withColumn("n_chars", F.length("text").cast("long"))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_dedup(docs).where("not kept"))


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", _toxicity), ("line dedup", _lines), ("near dedup", _near), ("decontamination", _decontaminate), ("packing", _pack)]
#: models and tokenizers are beyond SQL; tests/llm holds the stages against plain restatements
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/lectern-stage{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
