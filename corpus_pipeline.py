"""A corpus pipeline over the text operators: from raw documents to ids of clean, unique ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import dart, decontaminate, pieces, quality, suffix
from voltide.llm.common import written


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject, each by its own text. A null text counts as an empty one, repeated rows are judged alike,
    an empty table gives an empty one; without labels of both kinds all rows have one score."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the row of its least doc_id (of several such rows, of the least text digest). Null and empty
    texts are one class; rows without a doc_id stay."""
    return dart.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the strings of 100 bytes that start earlier; n_chars follows the text. Null texts and rows without a doc_id stay as they
    are; rows that repeat a doc_id with different texts lose each their own repeats."""
    out = suffix.clean(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark, each by its own text. Null and empty texts stay; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every remaining text, and whether they decode to it; null for a null text, no ids for an empty one. Repeated rows stay."""
    return pieces.round_trip(docs, pieces.model_bytes(pieces.MODEL))


STAGES = [
    ("quality classifier", accept_quality),
    ("near duplicates", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the encoding; the operators are tested against brute force or held-out labels instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
