"""Reading and writing of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.surface import require


def scan_years(df: DataFrame) -> DataFrame:
    """Distinct years; only the date column is read."""
    return df.select(F.year("date").alias("year")).distinct()


def scan_year(df: DataFrame, year: int, columns: Sequence[str]) -> DataFrame:
    """One year's rows. The condition is a range of dates, which reaches the Parquet scan."""
    cond = F.col("date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))
    if "year" in df.columns:
        cond = cond & (F.col("year") == year)
    return df.where(cond).select(*(c for c in columns if c in df.columns))


def scan_splits(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """train, val and test, with the required columns only."""
    rows = require(df, [*columns, "split"]).select(*dict.fromkeys([*columns, "split"]))
    return {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}


def write_years(df: DataFrame, path: str) -> None:
    """One folder for each year; a year's rows are put together first, so that it gets few files."""
    df.withColumn("year", F.year("date")).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def consolidate(spark: SparkSession, path: str, out: str) -> int:
    """The year folders as one table, and its number of rows."""
    df = spark.read.parquet(path)
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def write_with_meta(df: DataFrame, path: str, meta: dict) -> None:
    """Key-value metadata on the first column, which Spark keeps in the Parquet schema."""
    first = df.columns[0]
    df.withMetadata(first, {**df.schema[first].metadata, "benchmark": meta}).write.mode("overwrite").parquet(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    schema = spark.read.parquet(path).schema
    return dict(schema[0].metadata.get("benchmark", {}))


def write_csv(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str]) -> DataFrame:
    """The columns asked for of a CSV with a header; only these are parsed."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*columns)


def write_sweep(df: DataFrame, path: str) -> None:
    """Long sweep tables by regime, zstd."""
    df.withColumns({"rung_index": F.col("rung_index").cast("smallint"), "intensity": F.col("intensity").cast("float")}).write.mode("overwrite").option("compression", "zstd").partitionBy("regime").parquet(path)


def parquet_summary(df: DataFrame) -> DataFrame:
    types = ", ".join(f"{n}: {t}" for n, t in df.dtypes)
    return df.agg(F.count("*").alias("n_rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date")).withColumns({"n_columns": F.lit(len(df.columns)), "types": F.lit(types)})
