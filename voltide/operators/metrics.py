"""Error, interval and calibration metrics of prediction tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import MATURITY, MONEYNESS, maturity, moneyness
from .surface import finite


def gaussian_z(alpha: float) -> float:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must be in (0, 1), got {alpha}")
    return NormalDist().inv_cdf(0.5 + alpha / 2.0)


def error_columns(pred: Column, target: Column, when: Column | None = None, suffix: str = "") -> list[Column]:
    """mae, rmse and mape (in percent, denominators of 1e-6 at least) as aggregates, over rows where ``when`` holds."""
    err = pred - target
    err = err if when is None else F.when(when, err)
    base = F.greatest(F.abs(target), F.lit(1e-6))
    return [F.avg(F.abs(err)).alias(f"mae{suffix}"), F.sqrt(F.avg(err * err)).alias(f"rmse{suffix}"), (F.avg(F.abs(err) / base) * 100.0).alias(f"mape{suffix}")]


def error_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "iv_pred", target: str = "iv_clean") -> DataFrame:
    return df.groupBy(*by).agg(*error_columns(F.col(pred), F.col(target)), F.count("*").alias("n"))


def overall_groups(df: DataFrame, pred: str = "iv_pred", target: str = "iv_clean") -> DataFrame:
    """Metrics of all, observed and unobserved rows, one row each."""
    group = F.explode(F.array(F.lit("overall"), F.when(F.col("observed"), "observed").otherwise("unobserved")))
    return error_metrics(df.withColumn("group", group), ["group"], pred, target)


def _spine(df: DataFrame, **edges) -> DataFrame:
    """All combinations of bucket names: a literal table of a dozen rows."""
    from itertools import product

    names = list(edges)
    rows = list(product(*([e[0] for e in edges[n]] for n in names)))
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def marginals(df: DataFrame, pred: str = "iv_pred", target: str = "iv_clean") -> DataFrame:
    """Metrics by maturity and by moneyness in one pass; empty buckets appear with n 0."""
    rows = df.select(maturity().alias("maturity"), moneyness().alias("moneyness"), F.col(pred).alias("p"), F.col(target).alias("t"))
    both = rows.select(F.explode(F.array(F.struct(F.lit("maturity").alias("axis"), F.col("maturity").alias("bucket")), F.struct(F.lit("moneyness").alias("axis"), F.col("moneyness").alias("bucket")))).alias("g"), "p", "t")
    found = both.groupBy("g.axis", "g.bucket").agg(*error_columns(F.col("p"), F.col("t")), F.count("*").alias("n"))
    spine = _spine(df, bucket=MATURITY).withColumn("axis", F.lit("maturity")).unionByName(_spine(df, bucket=MONEYNESS).withColumn("axis", F.lit("moneyness")))
    return spine.join(found, ["axis", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grid(df: DataFrame, metric: str = "mae", pred: str = "iv_pred", target: str = "iv_clean") -> DataFrame:
    """The metric of each maturity and moneyness cell, empty cells null."""
    err = F.col(pred) - F.col(target)
    value = F.avg(F.abs(err)) if metric == "mae" else F.sqrt(F.avg(err * err))
    found = df.groupBy(maturity().alias("maturity"), moneyness().alias("moneyness")).agg(value.alias(metric), F.count("*").alias("n"))
    return _spine(df, maturity=MATURITY, moneyness=MONEYNESS).join(found, ["maturity", "moneyness"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grid_counts(df: DataFrame) -> DataFrame:
    return grid(df.withColumns({"iv_pred": F.lit(0.0), "iv_clean": F.lit(0.0)})).select("maturity", "moneyness", "n")


def metrics_wide(df: DataFrame, pred: str = "iv_pred", target: str = "iv_clean") -> DataFrame:
    p, t = F.col(pred), F.col(target)
    groups = {"": None, "_observed": F.col("observed"), "_unobserved": ~F.col("observed")}
    groups |= {f"_{b[0]}": maturity() == b[0] for b in MATURITY} | {f"_{b[0]}": moneyness() == b[0] for b in MONEYNESS}
    return df.agg(*(c for suffix, when in groups.items() for c in error_columns(p, t, when, suffix)[:2]))


def mae_block(df: DataFrame, targets: Sequence[str], pred: str = "iv_pred") -> DataFrame:
    """MAE against each target, over rows where both are finite."""
    return df.agg(*(F.avg(F.when(finite(F.col(pred)) & finite(F.col(t)), F.abs(F.col(pred) - F.col(t)))).alias(f"mae_vs_{t}") for t in targets))


def coverage(target: str = "iv_clean") -> Column:
    known = finite(F.col(target)) & finite(F.col("lower")) & finite(F.col("upper"))
    return F.avg(F.when(known, F.col(target).between(F.col("lower"), F.col("upper")).cast("double")))


def width() -> Column:
    return F.avg(F.when(finite(F.col("lower")) & finite(F.col("upper")), F.col("upper") - F.col("lower")))


def average_rank(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the average rank of each value within ``by``: from counts of distinct values, so rows of equal value share one pass."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = counts.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, [*by, column])


def correlations(df: DataFrame, a: str = "abs_error", b: str = "uncertainty", by: Sequence[str] = ()) -> DataFrame:
    """Pearson's and Spearman's correlation, null for fewer than two rows or a constant column."""
    rows = df.where(finite(F.col(a)) & finite(F.col(b))).select(*by, a, b)
    ranked = average_rank(average_rank(rows, a, "_ra", by), b, "_rb", by)
    fine = (F.count("*") >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return ranked.groupBy(*by).agg(F.when(fine, F.corr(a, b)).alias("pearson"), F.when(fine, F.corr("_ra", "_rb")).alias("spearman"), F.count("*").alias("n"))


def gaussian_nll(mu: Column, sigma: Column, y: Column) -> Column:
    s = F.greatest(sigma, F.lit(1e-12))
    return F.avg(0.5 * (math.log(2.0 * math.pi) + 2.0 * F.log(s) + F.pow((y - mu) / s, 2.0)))


def gaussian_nll_masked(mu: Column, sigma: Column, y: Column, mask: Column) -> Column:
    s = F.greatest(sigma, F.lit(1e-6))
    return F.coalesce(F.avg(F.when(mask, F.log(s) + 0.5 * F.pow((y - mu) / s, 2.0))), F.lit(0.0))


def pinball(y: Column, quantiles: Sequence[tuple[float, Column]]) -> Column:
    """Mean over rows and quantiles of the pinball loss."""
    parts = F.array(*(F.greatest(q * (y - p), (q - 1.0) * (y - p)) for q, p in quantiles))
    return F.avg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / float(len(quantiles)))


def masked_losses(df: DataFrame, mask: Column, alpha: float = 0.5, pred: str = "iv_pred", target: str = "iv_clean") -> DataFrame:
    err = F.when(mask, F.col(pred) - F.col(target))
    mse, mae = F.coalesce(F.avg(err * err), F.lit(0.0)), F.coalesce(F.avg(F.abs(err)), F.lit(0.0))
    return df.agg(mse.alias("masked_mse"), mae.alias("masked_mae"), (alpha * mse + (1 - alpha) * mae).alias("masked_mix"))


def calibration_curve(df: DataFrame, alphas: Sequence[float] = (0.5, 0.68, 0.8, 0.9, 0.95, 0.99), by: Sequence[str] = ()) -> DataFrame:
    """Empirical coverage at each nominal level, from one pass: an aggregate for each level, then unpivoted."""
    r = F.abs(F.col("iv_clean") - F.col("iv_pred"))
    one = df.groupBy(*by).agg(*(F.avg((r <= gaussian_z(a) * F.col("sigma")).cast("double")).alias(f"c{i}") for i, a in enumerate(alphas)), F.count("*").alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(a).alias("nominal_coverage"), F.col(f"c{i}").alias("empirical_coverage")) for i, a in enumerate(alphas)))).alias("l")
    return one.select(*by, levels, "n").select(*by, "l.nominal_coverage", "l.empirical_coverage", "n")


def metrics_row(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """One row for each group: errors, coverage, width and correlations."""
    base = df.groupBy(*by).agg(*error_columns(F.col("iv_pred"), F.col("iv_clean")), coverage().alias("coverage"), width().alias("mean_width"), gaussian_nll(F.col("iv_pred"), F.col("sigma"), F.col("iv_clean")).alias("nll"), F.count("*").alias("n"))
    return base.join(correlations(df, by=by).drop("n"), list(by), "left")


def region_bin(df: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """Mean, sum, max or fraction (of rows with a true or nonzero value) of each cell; non-finite values count for fraction only."""
    v = F.col(value).cast("double")
    known = F.when(finite(v), v)
    agg = {"mean": F.avg(known), "sum": F.coalesce(F.sum(known), F.lit(0.0)), "max": F.max(known), "fraction": F.avg(F.coalesce(v != 0, F.lit(False)).cast("double"))}
    if how not in agg:
        raise ValueError(f"unknown aggregate: {how}")
    found = df.groupBy(maturity().alias("maturity"), moneyness().alias("moneyness")).agg(agg[how].alias("value"), F.count("*").alias("n"))
    return _spine(df, maturity=MATURITY, moneyness=MONEYNESS).join(found, ["maturity", "moneyness"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def region_pivot(table: DataFrame, value: str = "value") -> DataFrame:
    """Long to wide in the canonical order of the columns."""
    return table.groupBy("maturity").pivot("moneyness", [b[0] for b in MONEYNESS]).agg(F.first(value))


def zscore_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation (1e-8 at least) of each column over the training rows."""
    t = df.where("split = 'train'")
    return t.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.greatest(F.stddev_pop(c), F.lit(1e-8)).alias(f"{c}_std"))))


def zscore_apply(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({f"{c}_z": (F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*(f"{c}_{x}" for c in columns for x in ("mean", "std")))


def max_abs_z(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy("split").agg(*(F.max(F.abs(f"{c}_z")).alias(f"{c}_max_abs_z") for c in columns))


def ensemble_reduce(df: DataFrame, members: Sequence[str]) -> DataFrame:
    """Adds ``mu`` and ``disagreement_std``, mean and population deviation over the members, without reshaping the table."""
    a = F.array(*members)
    n = float(len(members))
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    out = df.withColumn("mu", mean)
    return out.withColumn("disagreement_std", F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - F.col("mu")) * (x - F.col("mu"))) / n))
