"""How queries are registered: a name, a function of (spark, sf_dir), SQL for DuckDB, and the columns to round in both."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import BASE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def query(name: str, sql: str | None = None, r: str = "", digits: int = 6, base: bool = True) -> Callable[[Query], Query]:
    """Registers a query. ``r`` names its columns of floating point, which both sides round; ``sql`` may use the views of ``adapters``."""
    columns = r.split()

    def add(f: Query) -> Query:
        QUERIES[name] = (lambda s, d: rounded(f(s, d), columns, digits)) if columns else f
        if sql is not None:
            body = f"{BASE}\n{sql.strip()}" if base else sql.strip()
            if columns:
                swap = ", ".join(f"round(cast({c} as double), {digits}) + 0E0 as {c}" for c in columns)
                body = f"select * replace ({swap}) from ({body})"
            ORACLE_SQL[name] = body
        return f

    return add
