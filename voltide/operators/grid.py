"""Places of a surface cut into square cells of few sites each, so that no task needs all of a surface.

A table of sites has the columns ``by`` that tell surfaces apart, and _x and _y. Each surface's square is cut into four as long as a cell holds over
``most`` sites: dense regions get small cells. What a place needs to know of other cells is one row for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import beside, ddl, same, staged
from .surface import small

CELL = ("_lvl", "_cx", "_cy")
#: Halvings of a surface's side after which a cell is not cut any more: its sites are within a millionth of the side.
DEEPEST = 20
#: Places that a task holds against a surface's cells at once.
PLACES = 8192


def cut(sites: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """``sites`` with the cell of each (CELL) and the surface's frame (_x0, _y0, _side)."""
    extent = F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"))
    frame = sites.groupBy(*by).agg(F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), F.when(extent > 0, extent).otherwise(1.0).alias("_side"), F.count("*").alias("_m"))
    first = F.greatest(F.lit(0), F.floor(F.log(F.col("_m") / most) / float(np.log(4.0))).cast("int"))
    placed = sites.alias("l").join(small(staged(frame)).alias("r"), same("l", "r", by)).select("l.*", "_x0", "_y0", "_side", F.least(first, F.lit(DEEPEST)).alias("_lvl"))

    def cells(df: DataFrame) -> DataFrame:
        n = F.pow(F.lit(2.0), F.col("_lvl"))
        at = lambda c, o: F.least(F.floor((F.col(c) - F.col(o)) / F.col("_side") * n), n - 1).cast("bigint")
        return df.withColumns({"_cx": at("_x", "_x0"), "_cy": at("_y", "_y0")})

    placed = staged(cells(placed))
    while True:
        full = placed.groupBy(*by, *CELL).agg(F.count("*").alias("_n")).where((F.col("_n") > most) & (F.col("_lvl") < DEEPEST)).drop("_n")
        full = staged(full)
        if full.isEmpty():
            return placed
        deeper = placed.alias("l").join(small(full.withColumn("_full", F.lit(1))).alias("r"), same("l", "r", [*by, *CELL]), "left")
        deeper = deeper.select(*(F.col(f"l.{c}") for c in placed.columns if c not in CELL), (F.col("l._lvl") + F.coalesce("_full", F.lit(0))).alias("_lvl"))
        placed = staged(cells(deeper).select(*placed.columns))


def cells(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row a cell: its number of sites, their bounds (_xl, _xh, _yl, _yh), and the square itself (_cl, _ch: lower corner; _size)."""
    size = F.first("_side") / F.pow(F.lit(2.0), F.first("_lvl"))
    return placed.groupBy(*by, *CELL).agg(
        F.count("*").alias("_n"), F.min("_x").alias("_xl"), F.max("_x").alias("_xh"), F.min("_y").alias("_yl"), F.max("_y").alias("_yh"),
        (F.first("_x0") + F.first("_cx") * size).alias("_cl"), (F.first("_y0") + F.first("_cy") * size).alias("_ch"), size.alias("_size"),
    )


def _pairs(places: DataFrame, found: DataFrame, by: Sequence[str], choose, extra: str = "") -> DataFrame:
    """(by, _x, _y, CELL, extra) for the cells that ``choose`` (places, cells -> mask, values) picks for each place, in blocks."""
    names = [c.split()[0] for c in extra.split(", ")] if extra else []

    def run(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, step = [], max(1, (1 << 21) // max(len(c), 1))
        for lo in range(0, len(p) if len(c) else 0, step):
            part = p.iloc[lo : lo + step]
            mask, values = choose(part[["_x", "_y"]].to_numpy(float), c)
            i, j = np.nonzero(mask)
            rows = part[[*by, "_x", "_y"]].iloc[i].reset_index(drop=True)
            for name in CELL:
                rows[name] = c[name].to_numpy()[j]
            for name, v in zip(names, values, strict=True):
                rows[name] = v[i, j]
            out.append(rows)
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in [*by, "_x", "_y", *CELL, *names]})

    schema = f"{ddl(places, by)}, _x double, _y double, _lvl int, _cx bigint, _cy bigint" + (f", {extra}" if extra else "")
    return beside(places.select(*by, "_x", "_y"), found, by, PLACES, run, schema)


def within_reach(places: DataFrame, found: DataFrame, by: Sequence[str], others: bool) -> DataFrame:
    """The cells that may hold the site nearest to each place: those no farther than the farthest that the nearest site can be.

    A cell's bounds have a site on each side, so its nearest one is no farther than the far end of the nearer side. With ``others``, the far corners
    count for the bound, of cells that hold sites beside the place itself (beyond a rounding of ten digits).
    """

    def choose(p: np.ndarray, c: pd.DataFrame):
        xl, xh, yl, yh = (c[k].to_numpy(float)[None, :] for k in ("_xl", "_xh", "_yl", "_yh"))
        x, y = p[:, :1], p[:, 1:]
        near = np.hypot(np.maximum(np.maximum(xl - x, x - xh), 0.0), np.maximum(np.maximum(yl - y, y - yh), 0.0))
        dx, dy = np.maximum(np.abs(xl - x), np.abs(xh - x)), np.maximum(np.abs(yl - y), np.abs(yh - y))
        bound = np.minimum(np.hypot(np.minimum(np.abs(xl - x), np.abs(xh - x)), dy), np.hypot(dx, np.minimum(np.abs(yl - y), np.abs(yh - y)))).min(axis=1)
        if others:
            far = np.hypot(dx, dy)
            rest = np.where(far > 3e-10, far, np.inf).min(axis=1)
            bound = np.where(np.isfinite(rest), np.maximum(bound, rest), np.inf)
        return near <= bound[:, None] * (1 + 1e-9) + 1e-12, []

    return _pairs(places, found, by, choose)
