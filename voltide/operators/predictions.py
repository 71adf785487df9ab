"""Small steps on tables of predictions: targets, gates, and what confidence to use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .surface import finite


def residual_target(df: DataFrame, prior: str = "rbf_pred", target: str = "iv_clean", mode: str = "residual", out: str = "target") -> DataFrame:
    """Adds what a model is to learn: the target less the prior, or in mode ``absolute`` the target itself."""
    if mode not in ("residual", "absolute"):
        raise ValueError(f"unknown mode: {mode}")
    return df.withColumn(out, F.col(target) - F.col(prior) if mode == "residual" else F.col(target))


def nonfinite_gate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, rows in which one of ``columns`` is null, NaN or infinite, and whether there are any."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.coalesce(finite(F.col(c)), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_nonfinite")).withColumn("blocked", F.col("n_nonfinite") > 0)


def confidence_inject(df: DataFrame, pred: str = "iv_pred") -> DataFrame:
    """lower, upper and confidence_score where a predictor has none: a band of no width around the prediction, and full confidence."""
    given = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    return df.withColumns({"lower": F.coalesce(given("lower"), F.col(pred)), "upper": F.coalesce(given("upper"), F.col(pred)), "confidence_score": F.coalesce(given("confidence_score"), F.lit(1.0))})


def confidence_source(df: DataFrame, uncertainty: str = "uncertainty", error: str = "abs_error") -> DataFrame:
    """Adds confidence and source: less uncertainty where it is known, else less error, which is the oracle's order."""
    u: Column = F.col(uncertainty)
    return df.withColumns({"confidence": F.coalesce(-u, -F.col(error)), "source": F.when(u.isNotNull(), "uncertainty").otherwise("oracle")})


def validation_errors(df: DataFrame, error: str = "abs_error") -> DataFrame:
    """One row: errors at observed and at hidden rows, and how many there are of each."""
    o, e = F.col("observed"), F.col(error)
    return df.agg(F.avg(F.when(o, e * e)).alias("mse_observed"), F.avg(F.when(o, e)).alias("mae_observed"), F.avg(F.when(~o, e)).alias("mae_unobserved"), F.count_if(o).alias("n_observed"), F.count_if(~o).alias("n_unobserved"))
