"""The decision layer: abstain or trade, why, and how tradable."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import MATURITY, MONEYNESS, maturity, moneyness
from .metrics import _spine
from .surface import require


@dataclass(frozen=True)
class Decision:
    """The operating point; ``max_relative_width`` may be infinite."""

    confidence_threshold: float = 0.5
    max_relative_width: float = 0.5
    forbid_flags: Sequence[str] = ("calendar_violation", "convexity_violation")
    weights: tuple[float, float, float] = (0.6, 0.3, 0.1)
    epsilon: float = 1e-9

    def __post_init__(self) -> None:
        if min(self.weights) < 0 or self.epsilon <= 0:
            raise ValueError("weights must not be negative and epsilon must be positive")


def parts(df: DataFrame, config: Decision = Decision()) -> DataFrame:
    """Adds relative_width, low_confidence, wide_interval and forbidden; flags that the table lacks are ignored."""
    require(df, ["confidence_score", "lower", "upper", "uncertainty"])
    rel = (F.col("upper") - F.col("lower")) / F.greatest(F.col("uncertainty"), F.lit(config.epsilon))
    there = [F.coalesce(F.col(f), F.lit(False)) for f in config.forbid_flags if f in df.columns]
    out = df.withColumns({"relative_width": rel, "forbidden": reduce(or_, there, F.lit(False))})
    return out.withColumns({"low_confidence": F.coalesce(F.col("confidence_score") < config.confidence_threshold, F.lit(False)), "wide_interval": F.coalesce(F.col("relative_width") > config.max_relative_width, F.lit(False))})


def flagged(df: DataFrame, flags: Callable[[DataFrame], DataFrame], key: str = "row_key") -> DataFrame:
    """``df`` with the boolean columns that ``flags`` gives for each key. A key that it leaves out has no flag; one it repeats has those of any."""
    got = flags(df)
    names = [c for c in got.columns if c not in df.columns]
    if key not in got.columns or not names:
        raise ValueError(f"flags need {key} and a column that the table lacks")
    return df.join(got.groupBy(key).agg(*(F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in names)), key, "left").fillna(False, names)


def decide(df: DataFrame, config: Decision = Decision(), flags: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds abstain_flag, decision_reason (no_arb_violation, then low_confidence, then wide_interval, else ok) and tradability_score."""
    p = parts(df if flags is None else flagged(df, flags), config)
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    bounded = 0 < config.max_relative_width < float("inf")
    width = 1.0 - clip(F.col("relative_width") / config.max_relative_width) if bounded else F.lit(1.0)
    a, b, c = config.weights
    score = clip(a * clip(F.col("confidence_score")) + b * width + c * F.when(F.col("forbidden"), 0.0).otherwise(1.0))
    reason = F.when(F.col("forbidden"), "no_arb_violation").when(F.col("low_confidence"), "low_confidence").when(F.col("wide_interval"), "wide_interval").otherwise("ok")
    return p.withColumns({"abstain_flag": F.col("forbidden") | F.col("low_confidence") | F.col("wide_interval"), "decision_reason": reason, "tradability_score": score})


def counts(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count("*").alias("n"), F.count_if("abstain_flag").alias("n_abstain"), F.count_if("forbidden").alias("n_no_arb"), F.count_if("low_confidence").alias("n_low_confidence"), F.count_if("wide_interval").alias("n_wide_interval"))


def evaluate(decided: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Errors with and without abstention, and the share abstained, for each group."""
    e = F.abs(F.col("iv_pred") - F.col("iv_clean"))
    return decided.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg(F.when(~F.col("abstain_flag"), e)).alias("mae_kept"), F.avg(F.col("abstain_flag").cast("double")).alias("abstain_rate"), F.avg("tradability_score").alias("tradability"))


def region_tradability(decided: DataFrame) -> DataFrame:
    found = decided.groupBy(maturity().alias("maturity"), moneyness().alias("moneyness")).agg(F.avg("tradability_score").alias("tradability"), F.avg(F.col("abstain_flag").cast("double")).alias("abstain_rate"), F.count("*").alias("n"))
    return _spine(decided, maturity=MATURITY, moneyness=MONEYNESS).join(found, ["maturity", "moneyness"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
