"""Profiles, summaries and exploratory queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key_uniform
from .order import quantiles
from .surface import clean_condition, finite, strict_condition, true


def _long(one: DataFrame, names: Sequence[str], *fields: str) -> DataFrame:
    """A one-row table of columns name_field as one row for each name."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), *(F.col(f"`{n}_{f}`").alias(f) for f in fields)) for n in names))).alias("r")
    return one.select(rows).select("r.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """dtype, non-null rows and percent of nulls of every column, in one pass."""
    n = F.count("*")
    one = df.agg(*(x for c in df.columns for x in (F.count(F.col(f"`{c}`")).alias(f"{c}_non_null"), (100.0 * (n - F.count(F.col(f"`{c}`"))) / F.nullif(n, F.lit(0))).alias(f"{c}_null_pct"))))
    types = F.create_map(*(F.lit(x) for c, t in df.dtypes for x in (c, t)))
    return _long(one, df.columns, "non_null", "null_pct").withColumn("dtype", types[F.col("name")])


def profile_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*(x for c in columns for x in (F.min(c).cast("string").alias(f"{c}_min_value"), F.max(c).cast("string").alias(f"{c}_max_value"))))
    return _long(one, columns, "min_value", "max_value")


def option_types(df: DataFrame) -> DataFrame:
    return df.agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def suspicious(df: DataFrame) -> DataFrame:
    """Rows, and percent of all, that each check finds."""
    c = F.col
    checks = {"bid < 0": c("bid") < 0, "ask < 0": c("ask") < 0, "ask < bid": c("ask") < c("bid"), "IV <= 0": c("implied_volatility") <= 0, "IV > 5.0": c("implied_volatility") > 5.0}
    checks |= {f"{n} is null": c(n).isNull() for n in ("date", "expiration", "strike", "type")}
    names = list(checks)
    one = df.agg(F.count("*").alias("n"), *(F.count_if(true(k)).alias(f"c{i}") for i, k in enumerate(checks.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("check"), F.col(f"c{i}").alias("n_rows")) for i, x in enumerate(names)))).alias("r")
    return one.select("n", rows).select("r.check", "r.n_rows", F.coalesce(F.try_divide(F.col("r.n_rows") * 100.0, F.col("n")), F.lit(0.0)).alias("pct"))


def build_report(derived: DataFrame) -> DataFrame:
    """Rows in, kept, dropped and strict, and the strict share in percent, by year; from derived rows before cleaning."""
    clean = clean_condition()
    return derived.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("rows_in"), F.count_if(clean).alias("rows_kept"), F.count_if(~clean).alias("rows_dropped"), F.count_if(clean & strict_condition()).alias("rows_strict"),
        (100.0 * F.count_if(clean & strict_condition()) / F.greatest(F.count_if(clean), F.lit(1))).alias("retention_pct"),
    )


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of rows and the sum of 32-bit slices of the rows' digests: the same whatever the order of rows."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")).alias("digest"))


def missing_business_days(dates: DataFrame) -> DataFrame:
    """Monday to Friday between the first and the last date that are not among the dates."""
    ends = dates.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.dayofweek("date").between(2, 6))
    return days.join(dates.select("date").distinct(), "date", "left_anti")


def ingest_summary(requested: DataFrame, got: DataFrame) -> DataFrame:
    one = got.agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("dates_returned"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    return one.crossJoin(requested.agg(F.countDistinct("date").alias("dates_requested")))


def distinct_dates(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (f.select("date") for f in frames)).where(F.col("date").isNotNull()).distinct()


def cap_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n dates."""
    first = df.select("date").distinct().orderBy("date").limit(n)
    return df.join(F.broadcast(first), "date", "left_semi")  # n dates


def spaced_dates(df: DataFrame) -> DataFrame:
    """Rows of the dates at n/4, n/2, 3n/4 and n - 1 among the n distinct ones."""
    d = df.select("date").distinct()
    at = d.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1).crossJoin(F.broadcast(d.agg(F.count("*").alias("_n"))))
    picks = at.where((F.col("_i") == F.floor(F.col("_n") / 4)) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.floor(F.col("_n") * 3 / 4)) | (F.col("_i") == F.col("_n") - 1))
    return df.join(F.broadcast(picks.select("date")), "date", "left_semi")  # four dates


def busiest_date(df: DataFrame) -> DataFrame:
    """Rows of the date with most, the first of equal ones."""
    top = df.groupBy("date").count().orderBy(F.col("count").desc(), "date").limit(1).select("date")
    return df.join(F.broadcast(top), "date", "left_semi")  # one date


def sample_dates(df: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """Rows of n dates drawn by hash."""
    d = df.select("date").distinct().orderBy(key_uniform(F.col("date"), f"dates{seed}"), "date").limit(n)
    return df.join(F.broadcast(d), "date", "left_semi")  # n dates


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, clip: bool = False) -> DataFrame:
    """Counts in ``bins`` equal bins of [low, high], the last one closed; values outside are left out, or moved to the ends with ``clip``."""
    x = F.col(column).cast("double")
    x = F.when(finite(x), F.least(F.greatest(x, F.lit(low)), F.lit(high))) if clip else x  # greatest would take a null for low
    rows = df.select(x.alias("x")).where(finite(F.col("x")) & F.col("x").between(low, high))
    b = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1))
    return rows.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    p = quantiles(df, x, (0.25, 0.5, 0.75)).agg(F.first("quantiles").alias("p"))
    one = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).crossJoin(p)  # one row each
    return one.select("n", "mean", "std", "min", *(F.col("p")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))), "max")


def flag_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    one = df.agg(*(x for f in flags for x in (F.count_if(F.col(f)).alias(f"{f}_n_rows"), F.avg(F.col(f).cast("double")).alias(f"{f}_share"))))
    return _long(one, flags, "n_rows", "share")


def null_rates(df: DataFrame) -> DataFrame:
    """Percent of nulls of the columns that have any, the highest first."""
    return profile_columns(df).where("null_pct > 0").select("name", "null_pct").orderBy(F.col("null_pct").desc(), "name")


def strict_summary(clean: DataFrame) -> DataFrame:
    s = strict_condition()
    v = lambda c: F.when(s, F.col(c))
    return clean.agg(
        F.avg(s.cast("double")).alias("strict_share"), F.min(v("date")).alias("min_date"), F.max(v("date")).alias("max_date"), F.countDistinct(v("date")).alias("n_dates"),
        *(x for c, n in (("implied_volatility", "iv"), ("tau", "tau")) for x in (F.min(v(c)).alias(f"{n}_min"), F.max(v(c)).alias(f"{n}_max"))),
    )


def rich_cheap(df: DataFrame, diff: Column, n: int = 6) -> DataFrame:
    """The n largest and n smallest differences of quotes with volume."""
    rows = df.where("volume > 0").withColumn("diff", diff)
    rich = rows.orderBy(F.col("diff").desc(), "row_key").limit(n).withColumn("side", F.lit("rich"))
    return rich.unionByName(rows.orderBy("diff", "row_key").limit(n).withColumn("side", F.lit("cheap")))


def all_known(*columns: str) -> Column:
    return reduce(and_, (F.col(c).isNotNull() for c in columns))


def attach(df: DataFrame, other: DataFrame, key: str = "row_key") -> DataFrame:
    """Inner join on the key; an error if the two don't hold the same keys once each."""
    sides = df.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(other.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odd = sides.where(f"a <> 1 or b <> 1 or `{key}` is null").select(key, "a", "b").limit(3).collect()
    if odd:
        raise ValueError(f"tables don't hold the same values of {key} once each: " + ", ".join(f"{r[0]} {r['a']} and {r['b']} times" for r in odd))
    return df.join(other, key)


def diff_summary(df: DataFrame, error: str = "abs_error") -> DataFrame:
    """One row: mean, median and ninth decile of a difference."""
    q = quantiles(df, F.col(error), (0.5, 0.9)).agg(F.first("quantiles").alias("q"))
    return df.agg(F.avg(error).alias("mean_diff")).crossJoin(q).select("mean_diff", F.col("q")[0].alias("median_diff"), F.col("q")[1].alias("p90_diff"))  # one row each


def call_put_split(df: DataFrame) -> DataFrame:
    """One row: quotes of calls and of puts, and calls for each put."""
    n = lambda t: F.count_if(F.lower("type") == t)
    return df.agg(n("call").alias("n_call"), n("put").alias("n_put"), F.try_divide(n("call"), n("put")).alias("ratio"))
