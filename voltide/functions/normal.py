"""The standard normal distribution function as a column, and Black's undiscounted call price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# West (2005), rational approximation in double precision, highest power first.
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TOLERANCE = 1e-9


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    near = e * _horner(a, _NUM) / _horner(a, _DEN)
    far = e / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def black_call(k: Column, tau: Column, sigma: Column) -> Column:
    """Forward 1, strike exp(k); the intrinsic value where sigma * sqrt(tau) vanishes."""
    std = sigma * F.sqrt(tau)
    d1 = (-k + 0.5 * std * std) / std
    return F.when(std > TOLERANCE, cdf(d1) - F.exp(k) * cdf(d1 - std)).otherwise(F.greatest(1.0 - F.exp(k), F.lit(0.0)))


def _literal(v: float) -> str:
    s = repr(v)
    return s if "e" in s else s + "E0"


def _sql_horner(a: str, coefficients) -> str:
    out = _literal(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {a} + {_literal(c)})"
    return out


def sql_cdf(x: str) -> str:
    """``cdf`` of a column in DuckDB."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2E0) * {_sql_horner(a, _NUM)} / {_sql_horner(a, _DEN)}"
    far = f"exp(-{a} * {a} / 2E0) / ({a} + 1E0 / ({a} + 2E0 / ({a} + 3E0 / ({a} + 4E0 / ({a} + 0.65E0))))) / 2.506628274631E0"
    tail = f"(case when {a} > 37E0 then 0E0 when {a} < 7.07106781186547E0 then {near} else {far} end)"
    return f"(case when {x} > 0 then 1E0 - {tail} else {tail} end)"


def sql_priced(source: str, sigma: str) -> str:
    """A select of all of ``source`` and its call price ``c``, by columns log_moneyness, tau and ``sigma``."""
    return (
        f"(select *, case when std > 1E-9 then {sql_cdf('d1')} - exp(log_moneyness) * {sql_cdf('d2')} else greatest(1E0 - exp(log_moneyness), 0E0) end as c from "
        f"(select *, d1 - std as d2 from (select *, case when std > 1E-9 then (-log_moneyness + 5E-1 * std * std) / std end as d1 from (select *, {sigma} * sqrt(tau) as std from {source}))))"
    )
