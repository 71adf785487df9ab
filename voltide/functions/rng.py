"""Uniform and normal numbers that depend on a row's key only, not on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_uniform(key: str | Column, component: str) -> Column:
    """In [0, 1): the first 32 bits of md5(key|component)."""
    key = F.col(key) if isinstance(key, str) else key
    return _uniform(F.concat(key.cast("string"), F.lit(f"|{component}")))


def _uniform(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def key_uniforms(key: str, components: Sequence[str]) -> Column:
    """``key_uniform`` of each component, as an array: one expression whatever their number, as many are more code than the JVM compiles."""
    return F.transform(F.array(*map(F.lit, components)), lambda c: _uniform(F.concat(F.col(key).cast("string"), F.lit("|"), c)))


def key_normal(key: str | Column, component: str) -> Column:
    """Standard normal by Box and Muller from two uniforms."""
    u, v = key_uniform(key, f"{component}a"), key_uniform(key, f"{component}b")
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(F.lit(2.0 * math.pi) * v)


def sql_uniform(component: str, key: str = "row_key") -> str:
    """``key_uniform`` in DuckDB."""
    return f"(cast('0x' || substr(md5(concat({key}, '|{component}')), 1, 8) as bigint) / 4294967296E0)"


def sql_normal(component: str, key: str = "row_key") -> str:
    return f"(sqrt(-2E0 * ln(1E0 - {sql_uniform(component + 'a', key)})) * cos(2E0 * pi() * {sql_uniform(component + 'b', key)}))"
