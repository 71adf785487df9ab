"""Structure and stability of several models side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .noarb import CHECKS, places, summary
from .reconstruct import NEEDED, Predictor, drawn, mask_draws, predicted
from .stage import staged


def _instability(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The mean over rows of the deviation of their predictions over the draws; rows of the same ``keys`` have the same predictions (_n of them)."""
    std = rows.groupBy(*by, *keys).agg(F.stddev_pop(F.nanvl("iv_pred", F.lit(None).cast("double"))).alias("std"), F.first("_n").alias("_n"))
    known = F.when(F.col("std").isNotNull(), F.col("_n"))
    return std.groupBy(*by).agg(F.try_divide(F.sum(F.col("std") * F.col("_n")), F.sum(known)).alias("value"))


def rollup(df: DataFrame, models: Mapping[str, str | Predictor], draws: int = 4, fraction: float = 0.8, seed: int = 7, by: Sequence[str] = ("split",)) -> DataFrame:
    """(by, metric, one column for each model): the mean over dates of each check's rate on the surfaces that a model reconstructs, and the mean
    deviation of its predictions over ``draws`` resampled masks (``instability``).

    ``df`` has the columns of a benchmark table; dates without a pair to check don't count for a rate. One table is written, of the columns needed
    and the masks. A named model's values are the same for all rows of a place, so its rows are counted by place before they are shuffled; those of
    a function, and of dates that ``by`` cuts, go row by row.
    """
    base = mask_draws(df.select(*dict.fromkeys(["date", *by, *NEEDED])), draws, fraction, seed)
    rows, copies, place = base.drop("_kept"), drawn(base), ["date", "log_moneyness", "tau"]
    cut = base.select("date", *by).distinct().groupBy("date").count().agg(F.max("count")).first()[0]
    parts = []
    for name, how in models.items():
        alike = isinstance(how, str) and (cut or 0) <= 1
        values = predicted(rows, how).drop("implied_volatility").withColumnRenamed("iv_pred", "implied_volatility")
        dates = summary(staged(places(values, "implied_volatility", (*by, "date"))), by=(*by, "date"), weight="weight") if alike else summary(values, by=(*by, "date"))
        rates = dates.groupBy(*by).agg(*(F.avg(F.try_divide(F.col(f"{c}_n_viol"), F.col(f"{c}_n_eval"))).alias(c) for c in CHECKS))
        parts += [rates.select(*by, F.lit(f"{c}_rate").alias("metric"), F.lit(name).alias("model"), F.col(c).alias("value")) for c in CHECKS]
        each = predicted(copies, how, ("date", "draw"))
        if alike:
            each = each.groupBy(*by, *place, "draw").agg(F.first("iv_pred").alias("iv_pred"), F.count("*").alias("_n"))
        sens = _instability(each if alike else each.withColumn("_n", F.lit(1)), place if alike else ["row_key"], by)
        parts.append(sens.select(*by, F.lit("instability").alias("metric"), F.lit(name).alias("model"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return staged(out).groupBy(*by, "metric").pivot("model", list(models)).agg(F.first("value"))
