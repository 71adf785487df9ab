"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .surface import small


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints. Where no such folder is set, a temporary one will do in local mode only, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="voltide-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """``df`` written and read again: what follows may use it several times, and a lost executor costs no more than the work since.

    Files have ``rows_a_file`` rows at most, if that is given: a reader takes in a whole row group, which counts rows and not their size when it is cut.
    """
    path = scratch(df.sparkSession, "staged")
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equal in all the columns, nulls too, between two aliased tables."""
    return reduce(and_, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns), F.lit(True))


def ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` of some ``rows`` rows of ``left`` and all rows of ``right`` that have the same keys (nulls are equal).

    The left rows of a key are dealt over tasks by their place (_x, _y), and the right rows go to each of them: so a key may have any number of left
    rows, while its right rows have to have a bound.
    """
    keys = list(keys)
    many = left.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("_chunks"))
    many = staged(many)
    part = F.pmod(F.xxhash64("_x", "_y"), F.col("_chunks")).cast("int").alias("_chunk")
    le = left.alias("l").join(small(many).alias("m"), same("l", "m", keys)).select("l.*", part)
    ri = right.alias("l").join(small(many).alias("m"), same("l", "m", keys)).select(*(F.col(f"l.{c}").alias(c) for c in right.columns), F.explode(F.expr("sequence(0, _chunks - 1)")).alias("_chunk"))  # new columns, where both sides come from one table
    both = [*keys, "_chunk"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = f(a.drop(columns="_chunk"), b)
        return out if len(out) else pd.DataFrame({c: pd.Series(dtype=object) for c in out.columns})  # no rows of any type

    return le.groupBy(*both).cogroup(ri.groupBy(*both)).applyInPandas(run, schema)
