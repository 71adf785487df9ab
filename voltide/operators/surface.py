"""From quotes to surface points: joins, derived columns, cleaning, flags, and the single-valued surface."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("date", "expiration", "strike", "type", "implied_volatility", "bid", "ask", "volume", "open_interest")
SMALL = 1e-8
WIDE_SPREAD = 0.5
ATM_BAND = 0.0025
KEY_DECIMALS = 10
#: Rows of the underlying up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame itself, or an error that names the columns which are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def finite(c: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def true(cond: Column) -> Column:
    """The condition, false where it is unknown."""
    return F.coalesce(cond, F.lit(False))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows, which one pruned pass finds out."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_underlying(quotes: DataFrame, und: DataFrame, hint: bool = True) -> DataFrame:
    """Inner join on date; columns of the underlying that clash get the suffix _und."""
    require(quotes, ["date"]), require(und, ["date", "close"])
    clash = {c: f"{c}_und" for c in und.columns if c != "date" and c in quotes.columns}
    und = und.withColumnsRenamed(clash)
    return quotes.join(small(und) if hint else und, "date")


def unmatched(quotes: DataFrame, und: DataFrame) -> DataFrame:
    """Rows of the quotes, and of those how many have no underlying."""
    known = und.select("date", F.lit(1).alias("known")).distinct()
    return quotes.select("date").join(known, "date", "left").agg(F.count("*").alias("n_rows"), F.count_if(F.col("known").isNull()).alias("n_unmatched"))


def derive(df: DataFrame) -> DataFrame:
    days = F.datediff("expiration", "date")
    return df.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2.0, "days_to_expiry": days, "tau": days.cast("double") / 365.0, "spot": F.col("close"), "log_moneyness": F.ln(F.col("strike") / F.col("close"))})


def clean_condition() -> Column:
    c = F.col
    known = reduce(and_, (c(n).isNotNull() for n in ("date", "expiration", "strike", "type", "implied_volatility", "close")))
    return true(known & (c("bid") >= 0) & (c("ask") >= 0) & (c("ask") >= c("bid")) & (c("implied_volatility") > 0) & (c("implied_volatility") <= 5.0) & (c("tau") > 0) & (c("tau") <= 3.0))


def hard_clean(df: DataFrame) -> DataFrame:
    return df.where(clean_condition())


def hard_clean_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows_before"), F.count_if(clean_condition()).alias("rows_after"), F.count_if(~clean_condition()).alias("rows_dropped"))


def relative_spread(eps: float = SMALL, mid: Column | None = None) -> Column:
    mid = F.col("mid") if mid is None else mid
    return F.when(mid.isNotNull(), (F.col("ask") - F.col("bid")) / F.greatest(mid, F.lit(eps)))


def quality_flags(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {"flag_zero_bid": true(c("bid") == 0), "flag_zero_volume": true(c("volume") == 0), "flag_zero_oi": true(c("open_interest") == 0), "flag_wide_spread": true(relative_spread() > WIDE_SPREAD)}
    )


def strict_condition() -> Column:
    c = F.col
    return true((c("bid") > 0) & (c("ask") > 0) & (c("mid") > 0) & c("implied_volatility").between(0.01, 3.0) & c("tau").between(1 / 365.0, 2.0) & c("log_moneyness").between(-1.0, 1.0))


def strict_subset(df: DataFrame) -> DataFrame:
    return df.where(strict_condition())


def micro_features(df: DataFrame) -> DataFrame:
    """relative_spread with the floor 1e-4 and put_call_indicator (+1 call, -1 put); another type is an error."""
    kind = F.lower("type")
    sign = F.when(kind == "call", 1.0).when(kind == "put", -1.0).otherwise(F.raise_error(F.concat(F.lit("unknown option type: "), F.coalesce(F.col("type"), F.lit("null")))).cast("double"))
    return df.withColumns({"relative_spread": relative_spread(1e-4), "put_call_indicator": sign})


# The named sets of context features, in order.
FEATURE_SETS = {"minimal": ("log_moneyness", "tau", "implied_volatility"), "micro_v1": ("log_moneyness", "tau", "implied_volatility", "bid", "ask", "relative_spread", "volume", "open_interest", "put_call_indicator")}


def context_features(df: DataFrame, feature_set: str) -> DataFrame:
    """The key, the date and the array of the named set's features."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set: {feature_set}")
    cols = FEATURE_SETS[feature_set]
    if feature_set == "micro_v1":
        df = micro_features(df)
    return require(df, cols).select("row_key", "date", *(F.col(c).cast("double").alias(c) for c in cols), F.array(*(F.col(c).cast("double") for c in cols)).alias("features"))


def context_query_sets(df: DataFrame, target: str = "iv_clean") -> DataFrame:
    """For each date all points as query set and the observed ones as context; a date without an observed point is an error."""
    point = F.struct("row_key", "log_moneyness", "tau", F.col("implied_volatility").alias("iv"), F.col(target).alias("target"), "observed")
    sets = df.groupBy("date").agg(F.array_sort(F.collect_list(point)).alias("query")).withColumn("context", F.filter("query", lambda p: p["observed"]))
    return sets.withColumn("n_context", F.when(F.size("context") == 0, F.raise_error(F.concat(F.lit("no observed row on "), F.col("date").cast("string"))).cast("int")).otherwise(F.size("context"))).withColumn("n_query", F.size("query"))


def fourier_encode(df: DataFrame, columns: Sequence[str] = ("log_moneyness", "tau"), n_freq: int = 4, max_freq: float = 16.0, passthrough: bool = True) -> DataFrame:
    """Sine and cosine of 2 pi f x for log-spaced f in [1, max_freq], as the array ``encoded``."""
    import math

    freqs = [max_freq ** (i / max(n_freq - 1, 1)) for i in range(n_freq)]
    parts = [F.array(*map(F.col, columns))] if passthrough else []
    for c in columns:
        angle = [F.lit(2.0 * math.pi * f) * F.col(c) for f in freqs]
        parts += [F.array(*map(F.sin, angle)), F.array(*map(F.cos, angle))]
    return df.withColumn("encoded", F.flatten(F.array(*parts)))


def encode_coords(df: DataFrame, kind: str = "raw") -> DataFrame:
    if kind == "raw":
        return df.withColumn("encoded", F.array("log_moneyness", "tau"))
    if kind == "fourier":
        return fourier_encode(df)
    raise ValueError(f"unknown encoding: {kind}")


def key_head(key: Column) -> Column:
    """The first seven bytes of a string as a number, in the strings' order. A least string would be found by sorting all rows, a least number is not."""
    return F.conv(F.substring(F.rpad(F.hex(F.substring(key, 1, 7)), 14, "0"), 1, 14), 16, 10).cast("bigint")


def rounded_key(decimals: int = KEY_DECIMALS) -> tuple[Column, Column]:
    """log_moneyness and tau rounded, with no negative zero."""
    return (F.round("log_moneyness", decimals) + 0.0).alias("lm_key"), (F.round("tau", decimals) + 0.0).alias("tau_key")


# ---- the single-valued surface


def otm_side(df: DataFrame, band: float = ATM_BAND) -> DataFrame:
    """Outside the band: puts below, calls above."""
    lm, kind = F.col("log_moneyness"), F.lower("type")
    return df.where(((lm < -band) & (kind == "put")) | ((lm > band) & (kind == "call")))


_GROUP = ("date", "expiration", "strike")


def _by_spread() -> Window:
    return Window.partitionBy(*_GROUP).orderBy(F.col("spread").asc_nulls_last(), (F.lower("type") == "put").desc(), "row_key")


def otm_atm(df: DataFrame, band: float = ATM_BAND) -> DataFrame:
    """Inside the band: the tightest spread of each contract, puts winning ties."""
    inside = df.where(F.abs("log_moneyness") <= band).withColumn("spread", relative_spread())
    return inside.withColumn("_r", F.row_number().over(_by_spread())).where("_r = 1").drop("_r", "spread")


def otm_select(df: DataFrame, band: float = ATM_BAND) -> DataFrame:
    """Both sides in one pass: rows outside the band by type, those inside by rank."""
    lm, kind = F.col("log_moneyness"), F.lower("type")
    inside = F.abs(lm) <= band
    keep = true(inside | ((lm < -band) & (kind == "put")) | ((lm > band) & (kind == "call")))
    rows = df.where(keep).withColumns({"spread": relative_spread(), "_in": inside})
    w = Window.partitionBy(*_GROUP, "_in").orderBy(F.col("spread").asc_nulls_last(), (F.lower("type") == "put").desc(), "row_key")
    return rows.withColumn("_r", F.row_number().over(w)).where("not _in or _r = 1").drop("_r", "_in", "spread")


def otm_fallback_count(df: DataFrame, band: float = ATM_BAND) -> DataFrame:
    """Contracts in the band, and those whose winner has no spread or shares it."""
    inside = df.where(F.abs("log_moneyness") <= band).withColumn("spread", relative_spread())
    groups = inside.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min("spread").alias("least"), F.collect_list("spread").alias("all"))
    tied = F.size(F.filter("all", lambda s: s == F.col("least"))) > 1
    return groups.agg(F.count("*").alias("atm_groups"), F.count_if((F.col("n") > 1) & (F.col("least").isNull() | tied)).alias("atm_fallback_count"))


def band_sensitivity(df: DataFrame, bands: Sequence[float] = (1e-12, 0.001, 0.0025, 0.005)) -> DataFrame:
    return df.agg(*(F.count_if(F.abs("log_moneyness") <= b).alias(f"rows_in_band_{i}") for i, b in enumerate(bands)))


_EQUIVALENT = ("bid", "ask", "mid", "implied_volatility", "volume", "open_interest")


def residual_ranked(df: DataFrame, decimals: int = KEY_DECIMALS) -> DataFrame:
    """The rows with n_key (rows of the same date and rounded coordinates), equivalent, and rank 1 for the one to keep."""
    lm, tau = rounded_key(decimals)
    rows = df.withColumns({"lm_key": lm, "tau_key": tau, "spread": relative_spread()})
    key = ("date", "lm_key", "tau_key")
    by_key = Window.partitionBy(*key)
    first = by_key.orderBy("row_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = None
    for c in _EQUIVALENT:
        x = F.col(c).cast("double")
        known = F.count(x).over(by_key)
        rows = rows.withColumn(f"_first_{c}", F.first(x).over(first))
        ok = (known == 0) | ((known == F.count("*").over(by_key)) & (F.max(F.abs(x - F.col(f"_first_{c}"))).over(by_key) <= SMALL))
        same = ok if same is None else same & ok
    rows = rows.withColumns({"n_key": F.count("*").over(by_key), "equivalent": same})
    by_type = by_key.orderBy("type", "row_key")
    by_quality = by_key.orderBy(F.col("spread").asc_nulls_last(), F.col("open_interest").desc_nulls_last(), F.col("volume").desc_nulls_last(), "row_key")
    rank = F.when(F.col("equivalent"), F.row_number().over(by_type)).otherwise(F.row_number().over(by_quality))
    return rows.withColumn("rank", rank).drop(*(f"_first_{c}" for c in _EQUIVALENT))


def resolve_residuals(df: DataFrame) -> DataFrame:
    """One row for each date and rounded coordinates."""
    return residual_ranked(df).where("rank = 1").select(df.columns)


def residual_groups(df: DataFrame) -> DataFrame:
    """The rows that share a key, for audit."""
    return residual_ranked(df).where("n_key > 1")


def otm_build(df: DataFrame) -> DataFrame:
    """Rule by side, tie-break in the band, then one row for each rounded coordinate; columns stay in order."""
    return resolve_residuals(otm_select(df)).select(df.columns)


def build_manifest(df: DataFrame) -> DataFrame:
    """One row of counts about a build."""
    lm, kind = F.col("log_moneyness"), F.lower("type")
    outside = F.abs(lm) > ATM_BAND
    wrong = outside & ~(((lm < 0) & (kind == "put")) | ((lm > 0) & (kind == "call")))
    seen = df.agg(F.count("*").alias("rows_in"), F.count_if(wrong).alias("dropped_wrong_type"), F.count_if(~outside).alias("atm_rows_seen"), F.countDistinct("date").alias("dates_processed"))
    kept = residual_ranked(otm_select(df))
    out = kept.agg(
        F.count_if(F.col("rank") == 1).alias("rows_out"),
        F.count_if((F.col("n_key") > 1) & (F.col("rank") == 1)).alias("residual_groups"),
        F.count_if(F.col("n_key") > 1).alias("residual_rows_in"),
        F.count_if((F.col("n_key") > 1) & F.col("equivalent") & (F.col("rank") > 1)).alias("dropped_equivalent"),
        F.count_if((F.col("n_key") > 1) & ~F.col("equivalent") & (F.col("rank") == 1)).alias("quality_picked"),
    )
    return seen.crossJoin(out)  # one row each


def single_valued(df: DataFrame) -> DataFrame:
    """Largest number of rows at one date and rounded coordinates: 1 for a single-valued surface."""
    lm, tau = rounded_key()
    return df.groupBy("date", lm, tau).count().agg(F.max("count").alias("largest_group"))
