"""Vendor payloads as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields of a contract in a payload, all strings there.
DOUBLES = ("strike", "last", "mark", "bid", "ask", "implied_volatility", "delta", "gamma", "theta", "vega", "rho")
LONGS = ("bid_size", "ask_size", "volume", "open_interest")
NAMES = ("contractID", "symbol", "expiration", "type", "date")
PAYLOAD = "data array<struct<" + ", ".join(f"`{n}`: string" for n in (*NAMES, *DOUBLES, *LONGS)) + ">>"
CHAIN = ", ".join(["contract_id string", "symbol string", "expiration date", "type string", "date date", *(f"{n} double" for n in DOUBLES), *(f"{n} bigint" for n in LONGS)])
# The message fields of a payload that holds no data, and what they say where access was refused.
ERROR_FIELDS = ("Information", "Note", "Error Message")
REFUSED = "premium|api key|invalid|unauthor"


def to_double(c: Column) -> Column:
    """Null for what is no number; infinities stay."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def to_long(c: Column) -> Column:
    """Truncated by way of a double; 0 for what is no number."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def chain_from_json(df: DataFrame, body: str = "body") -> DataFrame:
    """One typed row for each contract of the payloads; payloads without contracts, and broken ones, give none."""
    rows = df.select(F.from_json(F.col(body), PAYLOAD).alias("p")).select(F.inline("p.data"))
    day = lambda n: F.col(n).try_cast("date").alias(n)
    return rows.select(
        F.col("contractID").alias("contract_id"), "symbol", day("expiration"), F.lower("type").alias("type"), day("date"),
        *(to_double(F.col(n)).alias(n) for n in DOUBLES), *(to_long(F.col(n)).alias(n) for n in LONGS),
    )


def empty_chain(spark) -> DataFrame:
    return spark.createDataFrame([], CHAIN)


def error_payload(body: Column) -> Column:
    """Whether a payload says that access was refused."""
    said = [F.lower(F.get_json_object(body, f"$['{f}']")) for f in ERROR_FIELDS]
    out = F.lit(False)
    for s in said:
        out = out | F.coalesce(s.rlike(REFUSED), F.lit(False))
    return out


def routed(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Payloads to read and payloads to set aside."""
    bad = error_payload(F.col(body))
    return df.where(~bad), df.where(bad)


def underlying_normalise(df: DataFrame, symbol: str) -> DataFrame:
    """Vendor names to ours, a plain date, and the symbol."""
    names = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adjusted_close", "Volume": "volume"}
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return out.withColumns({"date": F.to_date("date"), "symbol": F.lit(symbol)})


# Optional columns of an underlying.
OPTIONAL = ("open", "high", "low", "adjusted_close", "volume", "dividend_amount", "split_coefficient")


def underlying_load(df: DataFrame, *order: str) -> DataFrame:
    """date, close and the optional columns that are there; of a date's rows the first by ``order``."""
    missing = {"date", "close"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    cols = ["date", "close", *(c for c in OPTIONAL if c in df.columns)]
    w = Window.partitionBy("date").orderBy(*(order or ("close",)))
    return df.where(F.col("date").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*cols)
