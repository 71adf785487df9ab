"""Half-open buckets [low, high) of maturity and moneyness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
# Names and edges.
MATURITY = (("short", 0.0, 30 / 365), ("medium", 30 / 365, 180 / 365), ("long", 180 / 365, INF))
MONEYNESS = (("deep_itm", -INF, -0.2), ("itm", -0.2, -0.05), ("atm", -0.05, 0.05), ("otm", 0.05, 0.2), ("deep_otm", 0.2, INF))
WINGS = (("deep_put_wing", -INF, -0.2), ("put_wing", -0.2, -0.05), ("atm", -0.05, 0.05), ("call_wing", 0.05, 0.2), ("deep_call_wing", 0.2, INF))


def bucket(value: Column, edges, otherwise: str | None = None) -> Column:
    """Name of the bucket that holds the value; null (or ``otherwise``) outside all, and for null and NaN."""
    out = None
    for name, low, high in edges:
        inside = F.lit(True)
        if low > -INF:
            inside = inside & (value >= low)
        inside = inside & (value < high) if high < INF else inside & (value.isNotNull() & ~F.isnan(value))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(F.lit(otherwise).cast("string"))


def sql_bucket(value: str, edges, otherwise: str = "null") -> str:
    parts = [" and ".join([f"{value} >= {low!r}E0"] * (low > -INF) + ([f"{value} < {high!r}E0"] if high < INF else [f"{value} is not null"])) for _, low, high in edges]
    return "case " + " ".join(f"when {p} then '{e[0]}'" for p, e in zip(parts, edges, strict=True)) + f" else {otherwise} end"


def maturity(tau: str = "tau") -> Column:
    return bucket(F.col(tau), MATURITY)


def moneyness(lm: str = "log_moneyness") -> Column:
    return bucket(F.col(lm), MONEYNESS)
