"""Audits of duplicate coordinates and of leakage from observed twins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import MATURITY, WINGS, bucket
from .order import quantiles
from .reconstruct import site_distances
from .stage import staged

DECIMALS = (8, 10, 12)


def audit_bucket() -> Column:
    return F.concat_ws("/", bucket(F.col("log_moneyness"), WINGS, "unknown"), bucket(F.col("tau"), MATURITY, "unknown"))


def keyed(df: DataFrame, decimals: Sequence[int] = DECIMALS) -> DataFrame:
    """Each row under the contract key and under the coordinates rounded to each number of decimals."""
    r = lambda c, d: (F.round(c, d) + 0.0).cast("string")
    keys = [F.struct(F.lit("contract").alias("key_name"), F.concat_ws("|", F.col("expiration").cast("string"), F.col("strike").cast("string")).alias("key"))]
    keys += [F.struct(F.lit(f"coord{d}").alias("key_name"), F.concat_ws("|", r("log_moneyness", d), r("tau", d)).alias("key")) for d in decimals]
    return df.select("date", "type", "implied_volatility", F.explode(F.array(*keys)).alias("k")).select("date", "type", "implied_volatility", "k.key_name", "k.key")


def duplicate_groups(df: DataFrame, decimals: Sequence[int] = DECIMALS) -> DataFrame:
    kind = F.lower("type")
    groups = keyed(df, decimals).groupBy("key_name", "date", "key").agg(F.count("*").alias("size"), (F.max("implied_volatility") - F.min("implied_volatility")).alias("iv_range"), (F.max((kind == "call").cast("int")) + F.max((kind == "put").cast("int")) == 2).alias("mixed"))
    return groups


def duplicate_summary(df: DataFrame, decimals: Sequence[int] = DECIMALS) -> DataFrame:
    return summarised(duplicate_groups(df, decimals))


def summarised(groups: DataFrame) -> DataFrame:
    """``duplicate_summary`` of groups that are made already."""
    dup = F.col("size") >= 2
    return groups.groupBy("key_name").agg(
        F.sum("size").alias("total_rows"),
        F.sum(F.when(dup, F.col("size")).otherwise(0)).alias("rows_in_dup_groups"),
        F.count_if(dup).alias("n_dup_groups"),
        F.count_if(F.col("size") == 2).alias("size_2"),
        F.count_if(F.col("size") == 3).alias("size_3"),
        F.count_if(F.col("size") >= 4).alias("size_4_plus"),
        F.count_if(dup & F.col("mixed")).alias("n_mixed"),
        F.count_if(dup & ~F.col("mixed")).alias("n_same_type"),
    )


def duplicate_dispersion(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distribution of the volatility range within duplicate groups; ``exact`` False uses sketches."""
    groups = duplicate_groups(df)
    return dispersed(staged(groups) if exact else groups, exact)  # exact order statistics read the groups several times


def dispersed(groups: DataFrame, exact: bool = True) -> DataFrame:
    """``duplicate_dispersion`` of groups that are made already."""
    levels, by = (0.5, 0.9, 0.95, 0.99), ["key_name", "kind"]
    groups = groups.where("size >= 2").withColumn("kind", F.when(F.col("mixed"), "mixed").otherwise("same_type"))
    sketch = [] if exact else [F.percentile_approx("iv_range", F.array(*map(F.lit, levels)), 100000).alias("p")]
    out = groups.groupBy(*by).agg(F.count("iv_range").alias("n"), F.avg("iv_range").alias("mean"), *sketch, F.max("iv_range").alias("max"))
    if exact:
        out = out.join(quantiles(groups, F.col("iv_range"), levels, by).select(*by, F.col("quantiles").alias("p")), by, "left")
    return out.select("key_name", "kind", "n", "mean", *(F.col("p")[i].alias(x) for i, x in enumerate(("p50", "p90", "p95", "p99"))), "max")


def twins(df: DataFrame, decimals: int = 10) -> DataFrame:
    """Hidden rows with the mean observed value at their rounded coordinates, the twin's error and the range of true values there."""
    lm, tau = (F.round("log_moneyness", decimals) + 0.0).alias("lm_key"), (F.round("tau", decimals) + 0.0).alias("tau_key")
    at = df.groupBy("date", lm, tau).agg(F.avg(F.when(F.col("observed"), F.col("implied_volatility"))).alias("twin_iv"), F.count_if("observed").alias("n_twins"), (F.max("iv_clean") - F.min("iv_clean")).alias("iv_range"))
    hidden = df.where(~F.col("observed")).select("*", lm, tau)
    return hidden.join(at, ["date", "lm_key", "tau_key"], "left").withColumn("twin_error", F.abs(F.col("twin_iv") - F.col("iv_clean")))


def leakage_table(df: DataFrame, decimals: Sequence[int] = (10,)) -> DataFrame:
    """For each rounding, split and cell: hidden rows, those with an observed twin, the twin's mean error and the mean range of true values there.

    All roundings come from one pass: a row goes to its key at each of them, and what a key's rows have in common stands beside each in the same shuffle.
    """
    r = lambda c, d: (F.round(c, d) + 0.0)
    keys = F.explode(F.array(*(F.struct(F.lit(d).alias("decimals"), r("log_moneyness", d).alias("lm"), r("tau", d).alias("tau")) for d in decimals))).alias("k")
    rows = df.select("date", "split", audit_bucket().alias("cell"), "observed", "implied_volatility", "iv_clean", keys)
    w = Window.partitionBy("date", "k")
    seen = F.when(F.col("observed"), F.col("implied_volatility"))
    at = rows.withColumns({"twin": F.avg(seen).over(w), "n_twins": F.count_if("observed").over(w), "range": F.max("iv_clean").over(w) - F.min("iv_clean").over(w)}).where(~F.col("observed"))
    out = at.groupBy("split", "cell", F.col("k.decimals").alias("decimals")).agg(F.count("*").alias("n_hidden"), F.count_if(F.col("n_twins") > 0).alias("n_with_twin"), F.avg(F.abs(F.col("twin") - F.col("iv_clean"))).alias("twin_mae"), F.avg("range").alias("iv_range_mean"))
    return out.select("split", "cell", "n_hidden", "n_with_twin", "twin_mae", "iv_range_mean", "decimals")


def strict(df: DataFrame, decimals: Sequence[int] = DECIMALS) -> DataFrame:
    """The summary of duplicates and the distribution of their ranges, for groups of both types, side by side; groups are made once."""
    groups = staged(duplicate_groups(df, decimals))
    return summarised(groups).join(dispersed(groups).where("kind = 'mixed'").drop("kind"), "key_name", "left")


def density_table(df: DataFrame) -> DataFrame:
    """For each mode of ``nearest_observed``: hidden rows, share at distance 0 and quartiles of the distance."""
    near = staged(site_distances(df).where("not observed").select("distance", "distance_other"))
    d = {"naive": "distance", "dedup": "distance", "exclude_same_key": "distance_other"}
    each = near.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(c).alias("distance")) for m, c in d.items()))).alias("x")).select("x.*")
    counts = each.groupBy("mode").agg(F.count("*").alias("n_hidden"), F.avg((F.col("distance") == 0).cast("double")).alias("zero_share"))
    q = quantiles(each, F.when(F.col("distance") < float("inf"), F.col("distance")), (0.25, 0.5, 0.75), ["mode"])
    return counts.join(q, "mode", "left").select("mode", "n_hidden", "zero_share", *(F.col("quantiles")[i].alias(x) for i, x in enumerate(("q25", "q50", "q75"))))


def gate(df: DataFrame, threshold_pct: float = 0.5) -> DataFrame:
    """PASS where contract and coordinate duplicates and the worst split's share of hidden rows with a twin are all within the threshold."""
    s = duplicate_summary(df, (10,)).groupBy().pivot("key_name", ["contract", "coord10"]).agg(F.first(100.0 * F.col("rows_in_dup_groups") / F.col("total_rows")))
    worst = twins(df).groupBy("split").agg((100.0 * F.avg((F.col("n_twins") > 0).cast("double"))).alias("pct")).agg(F.max("pct").alias("max_split_twin_pct"))
    row = s.select(F.col("contract").alias("contract_dup_pct"), F.col("coord10").alias("coord10_dup_pct")).crossJoin(worst)
    fine = (F.col("contract_dup_pct") <= threshold_pct) & (F.col("coord10_dup_pct") <= threshold_pct) & (F.coalesce("max_split_twin_pct", F.lit(0.0)) <= threshold_pct)
    return row.withColumn("verdict", F.when(fine, "PASS").otherwise("FAIL"))
