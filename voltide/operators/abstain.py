"""Selective prediction: risk against coverage, its area, confidence buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import fixed, quantiles, sketch
from .surface import finite


def _known(df: DataFrame, error: str, confidence: str) -> DataFrame:
    return df.where(finite(F.col(error)) & finite(F.col(confidence)))


#: Ranges of confidence that the global order is cut into; ranks in a range come from a window, those before it from sums.
RANGES = 64


def ranked(df: DataFrame, by: Sequence[str] = (), error: str = "abs_error", confidence: str = "confidence", key: str = "row_key") -> DataFrame:
    """(by, k, n, cum_error): rows from the most confident on, ties by key, with the running sum of the error.

    In two phases, so that no group's rows have to meet in one task: rows are dealt into ranges of confidence with about as many rows
    each, each range is summed, and ranks and sums within a range start from those of the ranges above it. A confidence
    at which a range ends is a range of its own, which the first characters of the key cut further, as most rows may have it.
    """
    return _ranked(df, by, error, confidence, key)[0]


def _above() -> str:
    """SQL of the number of cuts above c: of every eighth one, then of those of one eighth; they ascend."""
    last = RANGES // 8 - 1
    coarse = f"{last} - size(filter(coarse, x -> x > c))"
    fine = f"transform(array({coarse}), e -> size(filter(slice(cuts, 8 * e + 1, 8), x -> x > c)) + greatest(0, {RANGES - 1} - 8 * (e + 1)))"
    return f"{fine}[0]"


def _ranked(df: DataFrame, by: Sequence[str], error: str = "abs_error", confidence: str = "confidence", key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """The ranked rows, and a literal table (by, cuts, coarse, n). A sketch depends on the order in which its parts meet, so one that each use made
    for itself would cut the rows in several ways."""
    rows = _known(df, error, confidence).select(*by, F.col(error).cast("double").alias("e"), F.col(confidence).cast("double").alias("c"), F.col(key).alias("key"))
    cuts = fixed(rows.groupBy(*by).agg(sketch("c", [i / RANGES for i in range(1, RANGES)], 10000).alias("cuts"), F.count("*").alias("n")).where("n > 0"))
    cuts = cuts.withColumn("coarse", F.array(*(F.col("cuts")[8 * j + 7] for j in range(RANGES // 8 - 1))))
    joined = rows.join(F.broadcast(cuts), list(by)) if by else rows.crossJoin(F.broadcast(cuts))  # one row a group
    over = joined.withColumn("over", F.expr(_above()))
    at = F.coalesce(F.try_element_at("cuts", F.nullif(F.lit(RANGES - 1) - F.col("over"), F.lit(0))) == F.col("c"), F.lit(False))
    # Neither is null: a join by them would else filter by what they come from, with the confidence's expression once for each use of it.
    cell, sub = F.col("over") * 2 + at.cast("int"), F.when(F.col("cell") % 2 == 1, F.substring(F.col("key").cast("string"), 1, 2))
    cut = over.withColumn("cell", F.coalesce(cell, F.lit(0))).withColumn("sub", F.coalesce(sub, F.lit(""))).drop("cuts", "coarse", "over")
    cells = cut.groupBy(*by, "cell", "sub").agg(F.count("*").alias("m"), F.sum("e").alias("s"))
    above = Window.partitionBy(*by).orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*by, "cell", "sub", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("k0"), F.coalesce(F.sum("s").over(above), F.lit(0.0)).alias("s0"))
    inside = Window.partitionBy(*by, "cell", "sub").orderBy(F.col("c").desc(), F.col("key").cast("string")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.withColumns({"r": F.count("*").over(inside), "t": F.sum("e").over(inside)}).join(F.broadcast(starts), [*by, "cell", "sub"])
    return out.select(*by, "key", "e", "c", (F.col("k0") + F.col("r")).alias("k"), "n", (F.col("s0") + F.col("t")).alias("cum_error")), cuts


def risk_coverage(df: DataFrame, by: Sequence[str] = (), n_points: int = 20, **names) -> DataFrame:
    """(by, n_retained, coverage, retained_mae) at up to ``n_points`` evenly spaced numbers of retained rows."""
    if n_points < 1:
        raise ValueError(f"a curve needs at least one point, not {n_points}")
    r, sizes = _ranked(df, by, **names)
    # k is on the grid round(linspace(1, n, n_points)) if some i gives it; half to even.
    step = F.transform(F.sequence(F.lit(0), F.lit(n_points - 1)), lambda i: F.greatest(F.least(F.bround(F.lit(1.0) + i.cast("double") * (F.col("n") - 1).cast("double") / float(max(n_points - 1, 1))).cast("bigint"), F.col("n")), F.lit(1).cast("bigint")))
    points = r.join(F.broadcast(sizes.select(*by, F.explode(F.array_distinct(step)).alias("k"))), [*by, "k"])  # some points a group
    return points.select(*by, F.col("k").alias("n_retained"), (F.col("k") / F.col("n")).alias("coverage"), (F.col("cum_error") / F.col("k")).alias("retained_mae"))


def aurc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the curve; a single point gives its error."""
    w = Window.partitionBy(*by).orderBy("n_retained")
    part = (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("retained_mae") + F.lag("retained_mae").over(w)) / 2.0
    return curve.withColumn("part", part).groupBy(*by).agg(F.when(F.count("*") == 1, F.first("retained_mae")).otherwise(F.sum("part")).alias("aurc"))


def confidence_buckets(df: DataFrame, n_buckets: int = 10, error: str = "abs_error", confidence: str = "confidence") -> DataFrame:
    """Mean error by quantile bucket of confidence, 0 the lowest; buckets without rows are left out."""
    if n_buckets < 1:
        raise ValueError(f"at least one bucket is needed, not {n_buckets}")
    rows = _known(df, error, confidence).select(F.col(error).alias("e"), F.col(confidence).alias("c"))
    edges = quantiles(rows, F.col("c"), [i / n_buckets for i in range(n_buckets + 1)]).select(F.col("quantiles").alias("edges"))
    b = F.size(F.filter(F.slice("edges", 2, n_buckets - 1), lambda x: x <= F.col("c"))) if n_buckets > 1 else F.lit(0)
    out = rows.crossJoin(F.broadcast(edges)).withColumn("bucket", b).groupBy("bucket").agg(F.avg("e").alias("mae"), F.count("*").alias("n"), F.first("edges").alias("edges"))
    return out.select("bucket", F.element_at("edges", F.col("bucket") + 1).alias("conf_lo"), F.element_at("edges", F.col("bucket") + 2).alias("conf_hi"), "mae", "n")


def kept(fraction: float, n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(fraction) * n).cast("bigint"))


def high_confidence_mae(df: DataFrame, fraction: float = 0.5, by: Sequence[str] = (), **names) -> DataFrame:
    """Mean error of the most confident ``fraction`` of the rows, one row at least."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"the fraction of rows to keep is over 0 and at most 1, not {fraction}")
    r = ranked(df, by, **names).where(F.col("k") == kept(fraction, F.col("n")))
    return r.select(*by, (F.col("cum_error") / F.col("k")).alias("high_conf_mae"), F.col("k").alias("n_kept"))


def top_confidence(df: DataFrame, k: int, confidence: str = "confidence", key: str = "row_key") -> DataFrame:
    return df.orderBy(F.col(confidence).desc(), key).limit(k)
