"""Sparsity ladders: ever fewer observed points, by regime and rung."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key_uniform
from .reconstruct import Predictor, predicted
from .stage import staged
from .surface import small

REGIMES = ("fewer_quotes", "thin_wings", "missing_maturities", "combined_quotes_wings")
INTENSITIES = (0.0, 0.2, 0.4, 0.6, 0.8)


def _ladder(intensities: Sequence[float]) -> tuple[float, ...]:
    out = tuple(map(float, intensities))
    if not out or out[0] != 0.0 or list(out) != sorted(out) or not all(0 <= x < 1 for x in out):
        raise ValueError("intensities must start at 0, ascend and be below 1")
    return out


def _limits(df: DataFrame, steps: Sequence[float]) -> DataFrame:
    """(date, _limit): for each rung the quantile 1 - intensity of the observed points' distance from the money.

    A date's distinct distances with their numbers of points are ranked, once for all rungs.
    """
    w = Window.partitionBy("date").orderBy("_a")
    whole = Window.partitionBy("date")
    held = df.where("observed").groupBy("date", F.abs("log_moneyness").alias("_a")).agg(F.count("*").alias("_m"))
    upto = held.withColumns({"_upto": F.sum("_m").over(w), "_n": F.sum("_m").over(whole)})
    at = [(F.col("_n") - 1) * (1.0 - x) for x in steps]
    reach = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct(F.col("_upto"), F.col("_a"))))["_a"]
    ends = upto.groupBy("date").agg(F.first("_n").alias("_n"), *(reach(F.floor(p)).alias(f"a{i}") for i, p in enumerate(at)), *(reach(F.ceil(p)).alias(f"b{i}") for i, p in enumerate(at)))
    return ends.select("date", F.array(*(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (p - F.floor(p)) for i, p in enumerate(at))).alias("_limit"))


def _dropped_maturities(df: DataFrame, steps: Sequence[float], seed: int) -> DataFrame:
    """(date, tau, _gone): for each rung whether the maturity is dropped: round(intensity * m) of m, in an order that the rungs share."""
    m = df.where("observed").select("date", "tau").distinct()
    u = key_uniform(F.concat_ws("|", F.col("date").cast("string"), F.round(F.col("tau") * 365.0).cast("int").cast("string")), f"maturity{seed}")
    w = Window.partitionBy("date")
    ranked = m.withColumns({"_r": F.row_number().over(w.orderBy(u, "tau")), "_n": F.count("*").over(w)})
    return ranked.select("date", "tau", F.array(*(F.col("_r") <= F.bround(F.lit(x) * F.col("_n")) for x in steps)).alias("_gone"))


def sweep(df: DataFrame, intensities: Sequence[float] = INTENSITIES, seed: int = 11, regimes: Sequence[str] = REGIMES, carry: Sequence[str] = ()) -> DataFrame:
    """(regime, rung_index, intensity, row, retained): the long table of all regimes; rungs are nested, as each row has one random number.

    is_query_fixed marks the points that no rung observes: those not observed at the dense end. What a row needs to know of its date is joined
    before it becomes a row for each rung and regime, so that no shuffle holds these; ``carry`` are further columns to keep.
    """
    steps = _ladder(intensities)
    cols = list(dict.fromkeys(["row_key", "date", "log_moneyness", "tau", "observed", "implied_volatility", *(c for c in ("iv_clean",) if c in df.columns), *carry]))
    base = df.select(*cols)
    rows = base.join(small(_limits(base, steps)), "date", "left").join(small(_dropped_maturities(base, steps, seed)), ["date", "tau"], "left")
    rows = rows.select(*cols, "_limit", "_gone", key_uniform("row_key", f"quotes{seed}").alias("_u"))

    def keep(i: int, x: float) -> dict[str, Column]:
        quotes = F.col("_u") < 1.0 - x
        wings = F.coalesce(F.abs("log_moneyness") <= F.col("_limit")[i], F.lit(False))
        return {"fewer_quotes": quotes, "thin_wings": wings, "missing_maturities": ~F.coalesce(F.col("_gone")[i], F.lit(False)), "combined_quotes_wings": quotes & wings}

    each = [F.struct(F.lit(r).alias("regime"), F.lit(i).alias("rung_index"), F.lit(x).alias("intensity"), (F.col("observed") & keep(i, x)[r]).alias("retained")) for i, x in enumerate(steps) for r in regimes]
    out = rows.select(*cols, F.explode(F.array(*each)).alias("_x"))
    return out.select("_x.regime", "_x.rung_index", "_x.intensity", *cols, "_x.retained", (~F.col("observed")).alias("is_query_fixed"))


def manifest(swept: DataFrame) -> DataFrame:
    return swept.groupBy("regime", "rung_index").agg(F.first("intensity").alias("intensity"), F.count_if("retained").alias("n_retained"), F.count_if("observed").alias("n_base"), F.coalesce(F.try_divide(F.count_if("retained"), F.count_if("observed")), F.lit(0.0)).alias("retained_fraction"))


def reconstruct(swept: DataFrame, how: str | Predictor = "rbf") -> DataFrame:
    """Adds iv_pred for each date, regime and rung. For a predictor by name all rungs are surfaces of one pass, whose values return to the rows by
    their coordinates; a function is given the dense rung once, as it is the same in all regimes."""
    rows = swept.withColumnRenamed("observed", "observed_base").withColumn("observed", F.col("retained"))
    if isinstance(how, str):
        return predicted(rows, how, ("date", "regime", "rung_index"))
    first = rows.agg(F.min("regime")).first()[0]  # a name
    dense = predicted(rows.where((F.col("rung_index") == 0) & (F.col("regime") == first)).select("date", "row_key", "log_moneyness", "tau", "observed", "implied_volatility"), how).select("row_key", "iv_pred")
    sparse = predicted(rows.where("rung_index > 0"), how, ("date", "regime", "rung_index"))
    return rows.where("rung_index = 0").join(dense, "row_key").unionByName(sparse.select(*rows.columns, "iv_pred"))


def compared(swept: DataFrame, model: str | Predictor, base: str | Predictor) -> DataFrame:
    """The swept table with the predictions of both at each rung (mu_hybrid, rbf_pred), as ``infer.trajectory`` takes it."""
    if isinstance(model, str) and isinstance(base, str):  # both add a column to the rows
        rows = swept.withColumnRenamed("observed", "observed_base").withColumn("observed", F.col("retained"))
        by = ("date", "regime", "rung_index")
        return predicted(predicted(rows, model, by).withColumnRenamed("iv_pred", "mu_hybrid"), base, by).withColumnRenamed("iv_pred", "rbf_pred")
    table = staged(swept.repartition("date"))
    a, b = reconstruct(table, model).withColumnRenamed("iv_pred", "mu_hybrid"), reconstruct(table, base).select("regime", "rung_index", "row_key", F.col("iv_pred").alias("rbf_pred"))
    return a.join(b, ["regime", "rung_index", "row_key"])


def accumulate(pred: DataFrame, target: str = "iv_clean") -> DataFrame:
    """Errors by regime and rung: sums skip predictions that are not finite, counts don't."""
    e = F.col("iv_pred") - F.col(target)
    ok = e.isNotNull() & ~F.isnan(e)
    n = F.count("*")
    return pred.groupBy("regime", "rung_index").agg(
        (F.sum(F.when(ok, F.abs(e)).otherwise(0.0)) / n).alias("mae"),
        F.sqrt(F.sum(F.when(ok, e * e).otherwise(0.0)) / n).alias("rmse"),
        F.try_divide(F.sum(F.when(ok & F.col("is_query_fixed"), F.abs(e)).otherwise(0.0)), F.count_if("is_query_fixed")).alias("mae_query"),
        F.count_if("retained").alias("n_retained"),
        F.count_if(~ok).alias("n_nonfinite"),
        n.alias("n"),
    )


def monotone(acc: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Whether each regime's error does not fall along the ladder."""
    w = Window.partitionBy("regime").orderBy("rung_index")
    step = F.col("mae") - F.lag("mae").over(w)
    return acc.withColumn("_s", step).groupBy("regime").agg(F.coalesce(F.min("_s") >= -tolerance, F.lit(True)).alias("monotone"), F.min_by("mae", "rung_index").alias("dense_mae"))
