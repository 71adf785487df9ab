"""Calibration of bands and confidences, fitted on one split and applied to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import correlations, coverage, gaussian_z, width
from .order import fixed, order_statistics, quantiles
from .stage import staged
from .surface import finite

VERSION = 2


def gaussian_band(df: DataFrame, alpha: float = 0.9, mu: str = "iv_pred", sigma: str = "sigma") -> DataFrame:
    z = gaussian_z(alpha)
    return df.withColumns({"lower": F.col(mu) - F.lit(z) * F.col(sigma), "upper": F.col(mu) + F.lit(z) * F.col(sigma)})


def fit_temperature(df: DataFrame, alpha: float = 0.9, mu: str = "iv_pred", sigma: str = "sigma", y: str = "iv_clean") -> DataFrame:
    """One row with ``temperature``: the least factor of sigma at which the band covers ``alpha``, within [1e-3, 1e3]."""
    rows = df.where(finite(F.col(y)) & finite(F.col(mu)) & finite(F.col(sigma)) & (F.col(sigma) > 0))
    s = order_statistics(rows, F.abs(F.col(y) - F.col(mu)) / F.col(sigma), [F.greatest(F.ceil(F.lit(alpha) * F.col("n")), F.lit(1))]).withColumn("value", F.col("values")[0])
    t = F.least(F.greatest(F.col("value") / gaussian_z(alpha), F.lit(1e-3)), F.lit(1e3))
    return s.select(F.when(F.col("n") >= 2, t).otherwise(F.raise_error(F.lit("temperature fit needs two finite rows")).cast("double")).alias("temperature"), F.col("n").alias("n_fit"))


def fit_conformal(df: DataFrame, alpha: float = 0.9, lower: str = "lower", upper: str = "upper", y: str = "iv_clean") -> DataFrame:
    """One row with ``delta``, the widening of split conformal prediction."""
    rows = df.where(finite(F.col(y)) & finite(F.col(lower)) & finite(F.col(upper)))
    n = F.col("n").cast("double")
    level = F.least(F.lit(1.0), F.ceil((n + 1.0) * alpha) / n)
    rank = F.ceil(level * (n - 1.0)) + 1
    s = order_statistics(rows, F.greatest(F.col(lower) - F.col(y), F.col(y) - F.col(upper)), [rank]).withColumn("value", F.col("values")[0])
    return s.select(F.when(F.col("n") >= 2, F.col("value")).otherwise(F.raise_error(F.lit("conformal fit needs two finite rows")).cast("double")).alias("delta"), F.col("n").alias("n_fit"))


def fit_scaling(df: DataFrame, source: str, error: str = "abs_error") -> DataFrame:
    """One row with ``slope`` (0 at least) and ``intercept`` of error on source."""
    rows = df.where(finite(F.col(source)) & finite(F.col(error)))
    a = F.when((F.count("*") >= 2) & (F.var_pop(source) > 0), F.greatest(F.lit(0.0), F.covar_pop(source, error) / F.nullif(F.var_pop(source), F.lit(0.0)))).otherwise(0.0)
    return rows.agg(a.alias("slope"), F.avg(source).alias("_m"), F.coalesce(F.avg(error), F.lit(0.0)).alias("_e")).select("slope", (F.col("_e") - F.col("slope") * F.coalesce("_m", F.lit(0.0))).alias("intercept"))


def scaled(source: Column, slope: Column, intercept: Column) -> Column:
    return F.greatest(F.lit(0.0), slope * source + intercept)


def fuse(primary: Column, *others: Column) -> Column:
    """Root of the sum of squares; what is missing of the others counts as nothing."""
    total = primary * primary
    for o in others:
        total = total + F.when(finite(o), o * o).otherwise(0.0)
    return F.sqrt(total)


def _median(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row with the median, null without rows."""
    return quantiles(df, value, [0.5]).agg(F.first(F.col("quantiles")[0]).alias(name))


def fit_confidence(df: DataFrame, u: str) -> DataFrame:
    """One row with ``centre`` and ``scale``: median and scaled median deviation (the deviation where that is 0)."""
    rows = staged(df.where(finite(F.col(u))).select(F.col(u).alias("u")))
    first = fixed(rows.agg(F.stddev_pop("u").alias("_sd"), F.count("*").alias("_n")).crossJoin(_median(rows, F.col("u"), "centre")))
    far = first.crossJoin(_median(rows.crossJoin(F.broadcast(first)), F.abs(F.col("u") - F.col("centre")), "_mad"))  # one row each
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    scale = F.greatest(F.when(F.col("_mad") > 0, F.col("_mad") / 0.6745).otherwise(sd), F.lit(1e-12))
    few = F.coalesce(F.col("_n") < 2, F.lit(True))
    return far.select(F.when(few, 0.0).otherwise(F.col("centre")).alias("centre"), F.when(few, 1.0).otherwise(scale).alias("scale"))


def confidence(u: Column, centre: Column, scale: Column) -> Column:
    z = -(u - centre) / scale
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def fit(df: DataFrame, alpha: float = 0.9, head: str = "gaussian", disagreement: str = "disagreement_std") -> DataFrame:
    """The calibrator as a one-row table, fitted on the rows given (with iv_pred, sigma or lower and upper, iv_clean, disagreement)."""
    z = gaussian_z(alpha)
    if head not in ("gaussian", "quantile"):
        raise ValueError(f"unknown head: {head}")
    df = staged(df.select("iv_pred", "iv_clean", *(["sigma"] if head == "gaussian" else ["lower", "upper"]), disagreement))  # many passes follow
    if head == "gaussian":
        main = fit_temperature(df, alpha).select(F.col("temperature"), F.lit(0.0).alias("delta"), "n_fit")
        sigma = F.col("sigma") * F.col("temperature")
    else:
        main = fit_conformal(df, alpha).select(F.lit(1.0).alias("temperature"), F.col("delta"), "n_fit")
        sigma = F.greatest((F.col("upper") - F.col("lower")) / 2.0 + F.col("delta"), F.lit(0.0)) / z
    rows = df.withColumn("abs_error", F.abs(F.col("iv_pred") - F.col("iv_clean")))
    params = fixed(main.crossJoin(fit_scaling(rows, disagreement)))
    fused = rows.crossJoin(F.broadcast(params)).withColumn("u", fuse(sigma, scaled(F.col(disagreement), F.col("slope"), F.col("intercept"))))
    done = params.crossJoin(fixed(fit_confidence(fused, "u")))
    return done.withColumns({"alpha": F.lit(alpha), "z": F.lit(z), "head": F.lit(head), "version": F.lit(VERSION)})


def apply(df: DataFrame, params: DataFrame, disagreement: str = "disagreement_std") -> DataFrame:
    """Adds calibrated lower, upper, uncertainty and confidence_score, and the two components of the uncertainty; bands are for the alpha fitted."""
    p = F.broadcast(params.withColumnsRenamed({c: f"_p_{c}" for c in params.columns}))  # one row
    z = F.col("_p_z")
    half = F.greatest((F.col("upper") - F.col("lower")) / 2.0 + F.col("_p_delta"), F.lit(0.0)) / z if {"lower", "upper"} <= set(df.columns) else F.col("sigma") * F.col("_p_temperature")
    sigma = F.when(F.col("_p_head") == "gaussian", F.col("sigma") * F.col("_p_temperature")).otherwise(half)
    out = df.crossJoin(p).withColumns({"u_primary": sigma, "u_ensemble": scaled(F.col(disagreement), F.col("_p_slope"), F.col("_p_intercept"))})
    out = out.withColumn("uncertainty", fuse(F.col("u_primary"), F.col("u_ensemble")))
    out = out.withColumns({"lower": F.col("iv_pred") - z * F.col("u_primary"), "upper": F.col("iv_pred") + z * F.col("u_primary"), "confidence_score": confidence(F.col("uncertainty"), F.col("_p_centre"), F.col("_p_scale"))})
    return out.drop(*(f"_p_{c}" for c in params.columns))


def save(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").json(path)


def load(spark, path: str) -> DataFrame:
    """The saved parameters; another version is an error."""
    schema = "temperature double, delta double, n_fit bigint, slope double, intercept double, centre double, scale double, alpha double, z double, head string, version int"
    p = spark.read.schema(schema).json(path)
    return p.withColumn("version", F.when(F.col("version") == VERSION, F.col("version")).otherwise(F.raise_error(F.lit("calibrator version not supported")).cast("int")))


def report(applied: DataFrame, alpha: float = 0.9, tolerance: float = 0.03) -> DataFrame:
    """Coverage, width, correlations, and whether coverage is within ``tolerance`` of ``alpha``."""
    rows = applied.withColumn("abs_error", F.abs(F.col("iv_pred") - F.col("iv_clean")))
    one = rows.agg(coverage().alias("coverage"), width().alias("mean_width"), F.count("*").alias("n_rows"))
    both = one.crossJoin(correlations(rows).drop("n"))
    return both.withColumn("within_tolerance", F.abs(F.col("coverage") - alpha) <= tolerance)
