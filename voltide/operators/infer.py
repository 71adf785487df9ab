"""Date-clustered bootstrap, sparsity trajectories, the gate, and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key_uniform
from .stage import staged

# The gate's thresholds and the regimes that it looks at.
DENSE_BAND_PCT, SURVIVE_PCT, GROWTH_PP = 2.0, 5.0, 1.0
WING_REGIMES = ("thin_wings", "combined_quotes_wings")


def bootstrap_delta(df: DataFrame, delta: Column, by: Sequence[str] = (), n_boot: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean of ``delta`` with an interval from resampling whole dates.

    Rows are first summed by date, so that a draw costs one row for each date whatever the number of rows. Draws pick
    dates by hashing, at slots 0 to n_dates - 1. What is broadcast is a sum and a count for each date of each group.
    """
    dates = df.groupBy(*by, "date").agg(F.sum(delta).alias("s"), F.count(delta).alias("n"))
    return _bootstrap(dates, by, n_boot, seed, level)


def _bootstrap(dates: DataFrame, by: Sequence[str], n_boot: int, seed: int, level: float = 0.95) -> DataFrame:
    """``bootstrap_delta`` from (by, date, s, n)."""
    w = Window.partitionBy(*by)
    slots = dates.withColumns({"slot": F.row_number().over(w.orderBy("date")) - 1, "n_groups": F.count("*").over(w)})
    # One row a group with its dates' sums in order of slot: thousands of dates at most.
    arrays = slots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slot", "s", "n"))).alias("d"), F.first("n_groups").alias("n_groups"), (F.sum("s") / F.sum("n")).alias("mean_delta"))
    # The draws are spread over the cluster; each task has the groups' arrays once, and sums a draw's picks in place.
    spark = dates.sparkSession
    draws = spark.range(0, n_boot, 1, max(1, min(n_boot // 16, 4 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "b")

    def add(acc: Column, i: Column) -> Column:
        u = key_uniform(F.concat_ws("|", F.col("b").cast("string"), i.cast("string")), f"boot{seed}")
        pick = F.element_at("d", F.floor(u * F.col("n_groups")).cast("int") + 1)
        return F.struct((acc["s"] + F.coalesce(pick["s"], F.lit(0.0))).alias("s"), (acc["n"] + pick["n"]).alias("n"))

    nothing = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    total = F.aggregate(F.sequence(F.lit(0), F.col("n_groups").cast("int") - 1), nothing, add, lambda acc: F.try_divide(acc["s"], acc["n"]))
    means = draws.crossJoin(F.broadcast(arrays)).select(*by, "b", "n_groups", "mean_delta", total.alias("m"))
    tail = (1.0 - level) / 2.0
    out = means.groupBy(*by).agg(F.first("mean_delta").alias("mean_delta"), F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1.0 - tail)).alias("ci_high"), F.first("n_groups").alias("n_groups"))
    return out.withColumn("significant", F.col("ci_high") < 0)


def trajectory(df: DataFrame, model: str = "mu_hybrid", base: str = "rbf_pred", target: str = "iv_clean", n_boot: int = 200, seed: int = 0) -> DataFrame:
    """For each regime and rung: errors of both predictors, the relative edge in percent with its interval, and the same on fixed query points."""
    em, eb = F.abs(F.col(model) - F.col(target)), F.abs(F.col(base) - F.col(target))
    by = ("regime", "rung_index")
    q = lambda e: F.when(F.col("is_query_fixed"), e)
    parts = {"b": eb, "m": em, "bq": q(eb), "mq": q(em), "": em - eb}
    sums = [x for k, e in parts.items() for x in (F.sum(e).alias(f"s{k}"), F.count(e).alias(f"n{k}"))]
    # The rows are read once: what follows is from a row for each date, regime and rung.
    dates = staged(df.groupBy(*by, "date").agg(*sums, F.first("intensity").alias("intensity"), F.count("*").alias("rows")))
    mean = lambda k: F.try_divide(F.sum(f"s{k}"), F.sum(f"n{k}"))
    main = dates.groupBy(*by).agg(F.first("intensity").alias("intensity"), mean("b").alias("rbf_mae"), mean("m").alias("hybrid_mae"), mean("bq").alias("rbf_mae_query"), mean("mq").alias("hybrid_mae_query"), F.sum("rows").alias("n_rows"))
    edge = lambda b, m: F.try_divide(F.col(b) - F.col(m), F.col(b)) * 100.0
    main = main.withColumns({"abs_delta": F.col("hybrid_mae") - F.col("rbf_mae"), "rel_edge_pct": edge("rbf_mae", "hybrid_mae"), "rel_edge_pct_query": edge("rbf_mae_query", "hybrid_mae_query")})
    ci = _bootstrap(dates, by, n_boot, seed).select(*by, "ci_low", "ci_high", "significant", F.col("n_groups").alias("n_dates"))
    return main.join(ci, list(by))


def per_regime(traj: DataFrame) -> DataFrame:
    e = F.col("rel_edge_pct")
    dense, sparse = F.min_by(e, "rung_index"), F.max_by(e, "rung_index")
    return traj.groupBy("regime").agg(
        dense.alias("edge_dense_pct"),
        sparse.alias("edge_sparse_pct"),
        (sparse - dense >= GROWTH_PP).alias("grows"),
        F.max_by("significant", "rung_index").alias("sparse_significant"),
        (sparse >= SURVIVE_PCT).alias("sparse_material"),
        F.max(e).alias("max_edge_pct"),
    )


def adjudicate(traj: DataFrame) -> DataFrame:
    """One row: true if the edge survives in every wing regime, false if it never leaves the dense band, else ambiguous."""
    p = per_regime(traj)
    wing = F.col("regime").isin(*WING_REGIMES)
    one = p.agg(F.coalesce(F.bool_and(F.when(wing, F.col("grows") & F.col("sparse_significant") & F.col("sparse_material"))), F.lit(False)).alias("survives"), (F.max("max_edge_pct") <= DENSE_BAND_PCT).alias("retired"))
    return one.select("survives", "retired", F.when(F.col("survives"), "true").when(F.col("retired"), "false").otherwise("ambiguous").alias("verdict"))


def resolve(traj: DataFrame, dense_edge_pct: float) -> DataFrame:
    """The verdict over retrained rungs with the dense anchor put in as rung 0."""
    sparse = traj.where("rung_index > 0").select("regime", "rung_index", "rel_edge_pct", "significant")
    anchor = sparse.select("regime").distinct().select("regime", F.lit(0).cast(traj.schema["rung_index"].dataType).alias("rung_index"), F.lit(dense_edge_pct).alias("rel_edge_pct"), F.lit(True).alias("significant"))
    return adjudicate(sparse.unionByName(anchor))


def compare_trajectories(a: DataFrame, b: DataFrame) -> DataFrame:
    """The edges of both by regime and rung; what ``b`` lacks is null."""
    return a.select("regime", "rung_index", F.col("rel_edge_pct").alias("edge_a")).join(b.select("regime", "rung_index", F.col("rel_edge_pct").alias("edge_b")), ["regime", "rung_index"], "left")


def comparison_long(metrics: DataFrame, family: str, head: str, source: str, names: Sequence[str]) -> DataFrame:
    """Metric columns of a table by split as (family, head, split, metric, value, source, n)."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))).alias("v")
    return metrics.select("split", "n", values).select(F.lit(family).alias("family"), F.lit(head).alias("head"), "split", "v.metric", "v.value", F.lit(source).alias("source"), "n")


def comparison_wide(long: DataFrame, a: str, b: str) -> DataFrame:
    """Two sources side by side, with delta and ratio."""
    w = long.groupBy("head", "split", "metric").pivot("source", [a, b]).agg(F.first("value"))
    return w.select("head", "split", "metric", F.col(a).alias("value_a"), F.col(b).alias("value_b"), (F.col(b) - F.col(a)).alias("delta"), F.try_divide(F.col(b), F.col(a)).alias("ratio"))
