"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bands, chat, collocations, dart, decontaminate, langid, mixing, passages, pieces, quality, search, suffix

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), pieces.model_bytes(pieces.MODEL))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from each participant's perspective."""
    return chat.digest(chat.perspectives(_table(spark, sf_dir, "conversations")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates that each document is in."""
    return dart.classes(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents nearly repeat."""
    return passages.passages(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(_table(spark, sf_dir, "documents"), pieces.model_bytes(pieces.MODEL))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.rules(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.removed(_table(spark, sf_dir, "documents")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose parts keep together most."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix of the sources takes each document, in words."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_chat_format,
        op3_quality_classifier,
        op4_minhash_dedup,
        op5_decontaminate,
        op6_language_id,
        op7_substring_dedup,
        op8_token_counts,
        op9_quality_rules,
        op10_suffix_array_dedup,
        op11_phrase_collocations,
        op12_source_mix,
        op13_ranked_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat.SQL, "op11_phrase_collocations": collocations.SQL, "op13_ranked_search": search.SQL}
