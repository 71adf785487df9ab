"""Static no-arbitrage checks of a surface, by date, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import TOLERANCE, black_call
from .surface import finite


def _usable(df: DataFrame, iv: str) -> DataFrame:
    return df.where(finite(F.col("log_moneyness")) & finite(F.col("tau")) & finite(F.col(iv)))


def _pair(rows: DataFrame, w, drop: Column, name: str) -> DataFrame:
    """``drop`` is what the pair (row before, row) breaks by; both its points are marked."""
    rows = rows.withColumn("_d", drop).withColumn("_v", F.coalesce(F.col("_d") > TOLERANCE, F.lit(False)))
    return rows.withColumns(
        {f"{name}_eval": F.col("_d").isNotNull(), f"{name}_violation": F.col("_v"), f"{name}_severity": F.when(F.col("_v"), F.col("_d")).otherwise(0.0), f"{name}_point": F.col("_v") | F.coalesce(F.lead("_v").over(w), F.lit(False))}
    ).drop("_d", "_v")


def calendar_check(df: DataFrame, iv: str = "implied_volatility") -> DataFrame:
    """Total variance iv^2 tau must not fall with tau at equal log_moneyness."""
    w = Window.partitionBy("date", "log_moneyness").orderBy("tau", "row_key")
    rows = _usable(df, iv).withColumn("_w", F.col(iv) * F.col(iv) * F.col("tau"))
    return _pair(rows, w, F.lag("_w").over(w) - F.col("_w"), "calendar").drop("_w")


def priced(df: DataFrame, iv: str) -> DataFrame:
    return _usable(df, iv).withColumn("call_price", black_call(F.col("log_moneyness"), F.col("tau"), F.col(iv)))


def _by_strike():
    return Window.partitionBy("date", "tau").orderBy("log_moneyness", "row_key")


def monotonicity_check(df: DataFrame, iv: str = "implied_volatility") -> DataFrame:
    """Call prices must not rise with the strike at equal tau."""
    w = _by_strike()
    return _pair(priced(df, iv), w, F.col("call_price") - F.lag("call_price").over(w), "monotonicity").drop("call_price")


def convexity_check(df: DataFrame, iv: str = "implied_volatility") -> DataFrame:
    """Call prices must be convex in the strike at equal tau; the middle row of a triple holds the check.

    Points of equal strike leave a divided difference undefined; such triples count as evaluated and not broken.
    """
    w = _by_strike()
    rows = priced(df, iv).withColumn("_k", F.exp("log_moneyness"))
    c, k = F.col("call_price"), F.col("_k")
    c0, k0, c1, k1 = F.lag(c).over(w), F.lag(k).over(w), F.lead(c).over(w), F.lead(k).over(w)
    left, right = F.try_divide(c - c0, k - k0), F.try_divide(c1 - c, k1 - k)
    second = F.try_divide(right - left, 0.5 * (k1 - k0))
    rows = rows.withColumns({"_e": c0.isNotNull() & c1.isNotNull(), "_s": second}).withColumn("_v", F.coalesce(F.col("_s") < -TOLERANCE, F.lit(False)))
    near = F.col("_v") | F.coalesce(F.lag("_v").over(w), F.lit(False)) | F.coalesce(F.lead("_v").over(w), F.lit(False))
    return rows.withColumns({"convexity_eval": F.col("_e"), "convexity_violation": F.col("_v"), "convexity_severity": F.when(F.col("_v"), -F.col("_s")).otherwise(0.0), "convexity_point": near}).drop("_e", "_s", "_v", "_k", "call_price")


CHECKS = ("calendar", "monotonicity", "convexity")


def all_checks(df: DataFrame, iv: str = "implied_volatility") -> DataFrame:
    """All three on the usable rows: two sorts, as the two checks by strike share theirs."""
    return convexity_check(monotonicity_check(calendar_check(df, iv), iv), iv)


def point_flags(df: DataFrame, iv: str = "implied_volatility") -> DataFrame:
    """Every row with a flag for each check; rows that are not usable have none set."""
    found = all_checks(df, iv).select("row_key", *(F.col(f"{c}_point").alias(f"{c}_violation") for c in CHECKS))
    return df.select("row_key", "date", "log_moneyness", "tau").join(found, "row_key", "left").select("row_key", "date", "log_moneyness", "tau", *(F.coalesce(f"{c}_violation", F.lit(False)).alias(f"{c}_violation") for c in CHECKS))


def places(df: DataFrame, iv: str, by: tuple[str, ...]) -> DataFrame:
    """The usable rows of a table whose ``iv`` is the same for all rows of a place, as three rows a place at most, with ``weight`` and a row_key.

    Of rows that stand at one place only the first meets the place before, and only the last the one behind; those between meet their likes. So the
    first and the last count once and one between counts for the others, and ``summary`` by that weight is that of all rows.
    """
    n = _usable(df, iv).groupBy(*by, "log_moneyness", "tau").agg(F.first(iv).alias(iv), F.count("*").alias("_n"))
    copies = n.withColumn("row_key", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(3)).cast("int"))))
    return copies.withColumn("weight", F.when(F.col("row_key") == 2, F.greatest(F.col("_n") - 2, F.lit(1))).otherwise(F.lit(1)).cast("bigint")).drop("_n")


def summary(df: DataFrame, iv: str = "implied_volatility", by: tuple[str, ...] = ("date",), weight: str | None = None) -> DataFrame:
    """n_eval, n_viol, rate and severity of each check, and in total, for each date; a row counts ``weight`` times, if that is given."""
    rows = all_checks(df, iv)
    n = lambda c: F.count_if(c) if weight is None else F.coalesce(F.sum(F.when(F.col(c), F.col(weight))), F.lit(0))
    total = lambda c: F.sum(c) if weight is None else F.sum(F.col(c) * F.col(weight))
    parts = [x for c in CHECKS for x in (n(f"{c}_eval").alias(f"{c}_n_eval"), n(f"{c}_violation").alias(f"{c}_n_viol"), total(f"{c}_severity").alias(f"{c}_severity"))]
    out = rows.groupBy(*by).agg(*parts)
    total = lambda what: sum((F.col(f"{c}_{what}") for c in CHECKS[1:]), F.col(f"{CHECKS[0]}_{what}"))
    out = out.withColumns({f"{c}_rate": F.coalesce(F.try_divide(F.col(f"{c}_n_viol"), F.col(f"{c}_n_eval")), F.lit(0.0)) for c in CHECKS})
    return out.withColumns({"total_n_eval": total("n_eval"), "total_n_viol": total("n_viol"), "total_severity": total("severity")}).withColumn("total_rate", F.coalesce(F.try_divide(F.col("total_n_viol"), F.col("total_n_eval")), F.lit(0.0)))


def risk_flags(flags: DataFrame, instability: str | None = None, threshold: float = float("inf"), weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """struct_count, risk_score and risk_flag of each row, from its check flags and, if given, its instability."""
    count = sum((F.col(f"{c}_violation").cast("int") for c in CHECKS[1:]), F.col(f"{CHECKS[0]}_violation").cast("int"))
    out = flags.withColumn("struct_count", count)
    norm, flag = F.lit(0.0), F.lit(False)
    if instability:
        x = F.col(instability)
        known = F.when(finite(x), x)
        most = F.max(known).over(Window.partitionBy("date"))
        norm = F.when(most > 0, F.coalesce(known, F.lit(0.0)) / most).otherwise(0.0)
        flag = F.coalesce(known > threshold, F.lit(False))
    return out.withColumns({"risk_score": weights[0] * F.col("struct_count") / 3.0 + weights[1] * norm, "risk_flag": (F.col("struct_count") > 0) | flag})
