"""Benchmark tables: masks, noise and splits by date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.rng import key_normal, key_uniform
from .stage import same, staged
from .surface import key_head, rounded_key, small

# Standard deviations of the noise regimes, in volatility units, and their short names.
NOISE = {"none": 0.0, "low": 0.01, "medium": 0.03, "high": 0.05}
SHORT = {"none": "0", "low": "low", "medium": "med", "high": "high"}
STRATEGIES = ("random", "realistic", "drop_wings", "drop_atm", "drop_short_maturity", "drop_long_maturity", "random_slice")


@dataclass(frozen=True)
class Variant:
    strategy: str
    keep_frac: float
    noise: str
    heteroscedastic: bool = False
    seed: int = 42

    @property
    def name(self) -> str:
        return benchmark_name(self.strategy, self.keep_frac, self.noise, self.heteroscedastic)


# The configured variants.
VARIANTS = (
    Variant("random", 0.2, "none"),
    Variant("random", 0.4, "none"),
    Variant("random", 0.6, "none"),
    Variant("random", 0.2, "low"),
    Variant("random", 0.4, "low"),
    Variant("random", 0.4, "medium"),
    Variant("random", 0.4, "high"),
    Variant("realistic", 0.4, "low"),
    Variant("realistic", 0.4, "medium", True),
    Variant("drop_wings", 1.0, "none"),
    Variant("drop_short_maturity", 1.0, "none"),
)


def benchmark_name(strategy: str, keep_frac: float, noise: str, heteroscedastic: bool = False) -> str:
    return f"spy_phase1_{strategy}{round(keep_frac * 100)}_noise{SHORT.get(noise, noise)}" + "_hetero" * heteroscedastic


def name_column(strategy: str, keep_frac: str, noise: str, heteroscedastic: str) -> Column:
    """The same name from columns."""
    short = F.coalesce(F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv))[F.col(noise)], F.col(noise))
    pct = F.bround(F.col(keep_frac) * 100).cast("int").cast("string")
    return F.concat(F.lit("spy_phase1_"), F.col(strategy), pct, F.lit("_noise"), short, F.when(F.col(heteroscedastic), "_hetero").otherwise(""))


def _fraction(x: float) -> float:
    if not 0 < x <= 1:
        raise ValueError(f"keep_frac must be in (0, 1], got {x}")
    return x


def random_mask(keep_frac: float, seed: int = 42, key: str = "row_key") -> Column:
    return key_uniform(key, f"mask{seed}") < _fraction(keep_frac)


def maturity_mask(region: str, short: float = 30 / 365, long: float = 1.0) -> Column:
    if region == "short":
        return ~(F.col("tau") < short)
    if region == "long":
        return ~(F.col("tau") > long)
    raise ValueError(f"unknown region: {region}")


def maturity_slice(df: DataFrame, seed: int = 42, bins: int = 10) -> DataFrame:
    """Adds ``observed``, false in one of ten equal slices of tau, which the seed picks."""
    edge = df.agg(F.min("tau").alias("_lo"), F.max("tau").alias("_hi"))
    return df.crossJoin(F.broadcast(edge)).withColumn("observed", _outside_slice(seed, bins)).drop("_lo", "_hi")  # edge is one row


def _outside_slice(seed: int, bins: int = 10) -> Column:
    slot = F.least(F.greatest(F.coalesce(F.floor((F.col("tau") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(0)), F.lit(0)), F.lit(bins - 1))
    return slot != F.floor(key_uniform(F.lit("slice"), str(seed)) * bins)


def moneyness_mask(region: str, wing: float = 0.3, atm: float = 0.05) -> Column:
    lm = F.col("log_moneyness")
    drops = {"wings": F.abs(lm) > wing, "atm": F.abs(lm) < atm, "left_wing": lm < -wing, "right_wing": lm > wing}
    if region not in drops:
        raise ValueError(f"unknown region: {region}")
    return ~drops[region]


REGIONS = {
    "drop_wings": lambda: moneyness_mask("wings"),
    "drop_atm": lambda: moneyness_mask("atm"),
    "drop_short_maturity": lambda: maturity_mask("short"),
    "drop_long_maturity": lambda: maturity_mask("long"),
}


def realistic_mask(df: DataFrame, keep_frac: float, seed: int = 42) -> DataFrame:
    """Adds ``observed``: likelier near the money and about sixty days, ``keep_frac`` on average."""
    scored = df.withColumn("_score", _score())
    mean = F.broadcast(scored.agg(F.avg("_score").alias("_mean")))  # one row
    return scored.crossJoin(mean).withColumn("observed", key_uniform("row_key", f"mask{seed}") < _likely(keep_frac)).drop("_score", "_mean")


def _score() -> Column:
    return F.exp(-0.5 * F.pow(F.col("log_moneyness") / 0.2, 2.0)) * F.exp(-0.5 * F.pow((F.col("tau") * 365.0 - 60.0) / 90.0, 2.0))


def _likely(keep_frac: float) -> Column:
    p = F.when(F.col("_mean") > 0, F.col("_score") / F.col("_mean") * _fraction(keep_frac)).otherwise(keep_frac)
    return F.least(F.greatest(p, F.lit(0.02)), F.lit(1.0))


def apply_mask(df: DataFrame, strategy: str, keep_frac: float = 1.0, seed: int = 42) -> DataFrame:
    """Adds ``observed`` by the named strategy."""
    if strategy == "random":
        return df.withColumn("observed", random_mask(keep_frac, seed))
    if strategy == "realistic":
        return realistic_mask(df, keep_frac, seed)
    if strategy == "random_slice":
        return maturity_slice(df, seed)
    if strategy not in REGIONS:
        raise ValueError(f"unknown strategy: {strategy}")
    return df.withColumn("observed", REGIONS[strategy]())


def paired(df: DataFrame, decimals: int = 10) -> DataFrame:
    """Gives all rows of one date and rounded coordinates the flag of the first."""
    lm, tau = rounded_key(decimals)
    on, key = ["date", "_lm", "_tau"], F.col("row_key")
    rows = df.withColumns({"_lm": lm, "_tau": tau})
    head = F.coalesce(key_head(key), F.lit(-1).cast("bigint")) if isinstance(df.schema["row_key"].dataType, StringType) else key
    seen = rows.select(*on, key, "observed", head.alias("_head"))
    least = staged(seen.groupBy(*on).agg(F.min("_head").alias("_least")))
    few = seen.alias("l").join(small(least).alias("r"), same("l", "r", on) & F.col("l._head").eqNullSafe(F.col("r._least"))).select("l.*")
    first = few.groupBy(*on).agg(F.coalesce(F.first(F.when(key.isNull(), F.struct("observed")), True), F.struct(F.min_by("observed", "row_key").alias("observed"))).alias("_first"))
    return rows.drop("observed").alias("l").join(small(staged(first)).alias("r"), same("l", "r", on)).select(*(F.col("r._first.observed").alias(c) if c == "observed" else F.col(f"l.{c}") for c in df.columns))


def gaussian(iv: Column, sigma: float, seed: int = 42) -> Column:
    return iv if sigma <= 0 else _noisy(iv, F.lit(sigma), key_normal("row_key", f"noise{seed}"))


def _noisy(iv: Column, scale: Column, normal: Column) -> Column:
    return F.when(iv.isNotNull(), F.greatest(iv + scale * normal, F.lit(1e-4)))


def _spread(sigma: float) -> Column:
    return F.lit(sigma) * ((1.0 + 2.0 * F.abs("log_moneyness") / 0.3) * (1.0 + 0.5 / F.greatest(F.col("tau") * 365.0, F.lit(1.0))))


def heteroscedastic(iv: Column, sigma: float, seed: int = 42) -> Column:
    return iv if sigma <= 0 else _noisy(iv, _spread(sigma), key_normal("row_key", f"noise{seed}"))


def inject_noise(df: DataFrame, regime: str, hetero: bool = False, seed: int = 42) -> DataFrame:
    """Noise on observed rows only; iv_clean keeps the value, noise_sigma the regime's."""
    sigma = NOISE[regime]
    iv = F.col("implied_volatility")
    noisy = heteroscedastic(iv, sigma, seed) if hetero else gaussian(iv, sigma, seed)
    return df.withColumns({"iv_clean": iv, "implied_volatility": F.when(F.col("observed"), noisy).otherwise(iv), "noise_sigma": F.lit(sigma)})


def date_split_map(dates: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Distinct dates in order: the first 70 % train, the next 15 % val, the rest test. A window over dates only: thousands of rows."""
    d = dates.select("date").where(F.col("date").isNotNull()).distinct()
    w = Window.orderBy("date")
    ranked = d.select("date", F.row_number().over(w).alias("rn")).crossJoin(d.agg(F.count("*").alias("n")))
    n_train, n_val = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return ranked.select("date", F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test").alias("split"))


def time_split(df: DataFrame, split_map: DataFrame) -> DataFrame:
    """Adds ``split``; dates that are not in the map are test."""
    m = split_map.select(F.col("date").alias("_d"), F.col("split").alias("_s"))
    return df.join(small(m), df["date"] == m["_d"], "left").withColumn("split", F.coalesce("_s", F.lit("test"))).drop("_d", "_s")


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.countDistinct("date").alias("n_dates"), F.count("*").alias("n_rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def build_benchmark(df: DataFrame, variant: Variant, split_map: DataFrame) -> DataFrame:
    """Mask, noise and split of one variant, with its name in ``variant``."""
    masked = apply_mask(df, variant.strategy, variant.keep_frac, variant.seed)
    noisy = inject_noise(masked, variant.noise, variant.heteroscedastic, variant.seed)
    return time_split(noisy, split_map).withColumn("variant", F.lit(variant.name))


def build_all(df: DataFrame, variants=VARIANTS) -> DataFrame:
    """All variants as one table, from one pass over ``df``: a row's random numbers and score are made once for each seed, what a mask needs of the
    whole table is one row, and each row becomes one for each variant."""
    whole = df.agg(F.avg(_score()).alias("_mean"), F.min("tau").alias("_lo"), F.max("tau").alias("_hi"))
    seeds = {v.seed for v in variants}
    drawn = {f"_u{s}": key_uniform("row_key", f"mask{s}") for s in seeds} | {f"_z{s}": key_normal("row_key", f"noise{s}") for s in seeds if any(NOISE[v.noise] > 0 and v.seed == s for v in variants)}
    rows = time_split(df, date_split_map(df)).crossJoin(F.broadcast(whole)).withColumns({"_score": _score(), **drawn})  # one row
    iv = F.col("implied_volatility")

    def one(v: Variant) -> Column:
        masks = {"random": lambda: F.col(f"_u{v.seed}") < _fraction(v.keep_frac), "realistic": lambda: F.col(f"_u{v.seed}") < _likely(v.keep_frac), "random_slice": lambda: _outside_slice(v.seed)} | REGIONS
        if v.strategy not in masks:
            raise ValueError(f"unknown strategy: {v.strategy}")
        observed, sigma = masks[v.strategy](), NOISE[v.noise]
        noisy = _noisy(iv, _spread(sigma) if v.heteroscedastic else F.lit(sigma), F.col(f"_z{v.seed}")) if sigma > 0 else iv
        return F.struct(F.lit(v.name).alias("variant"), observed.alias("observed"), F.when(observed, noisy).otherwise(iv).alias("value"), F.lit(sigma).alias("noise_sigma"))

    each = rows.select(*df.drop("observed", "iv_clean", "noise_sigma", "split", "variant").columns, "split", F.explode(F.array(*map(one, variants))).alias("_v"))
    return each.withColumns({"iv_clean": iv, "implied_volatility": F.col("_v.value"), "observed": F.col("_v.observed"), "noise_sigma": F.col("_v.noise_sigma"), "variant": F.col("_v.variant")}).drop("_v")


def manifest(benchmarks: DataFrame) -> DataFrame:
    s = lambda name: F.count_if(F.col("split") == name).alias(f"n_{name}")
    return benchmarks.groupBy("variant").agg(F.count("*").alias("n_rows"), F.count_if("observed").alias("n_observed"), s("train"), s("val"), s("test"))
