"""Exact order statistics without a global sort, whatever the values' distribution.

One pass sketches the values' quantiles on a grid; the wanted rank lies between two grid values that are GRID steps of rank apart at most.
A second pass counts the rows below these and groups those between them by value, so that equal values are one row, and only these are sorted.
Neither outliers nor a value that most rows have put more than that share of the distinct values in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

#: Steps of the grid of quantiles, and the sketch's accuracy: its error in rank is 1 / ACCURACY, far below a step.
GRID, ACCURACY = 1024, 32768


def sketch(column: str, probabilities: Sequence[float], accuracy: int) -> Column:
    """Approximate quantiles; one expression, as many literals would be many calls to the JVM."""
    return F.expr(f"percentile_approx({column}, array({', '.join(f'{p!r}D' for p in probabilities)}), {accuracy})")


def fixed(few: DataFrame) -> DataFrame:
    """A table of one row for each group, a few numbers each, as a literal: plans that use it don't hold the work it came from."""
    rows = few.collect()
    if len(rows) != 1 or any(isinstance(v, list) and None in v for v in rows[0]):
        return few.sparkSession.createDataFrame(rows, few.schema)
    return few.sparkSession.range(1).select(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(rows[0], few.schema, strict=True)))


def order_statistics(df: DataFrame, value: Column, ranks: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, values, n): the values of the given ranks (from 1, in ascending order) and the number of rows; ``ranks`` are expressions of n.

    Runs the first pass at once. Nulls and NaN don't count. Without rows there is no row; a rank under 1 or over n gives null.
    """
    names, by = list(by), [f"_by{k}" for k in range(len(by))]
    x = value.cast("double")
    rows = df.select(*(F.col(c).alias(b) for c, b in zip(names, by, strict=True)), F.when(~F.isnan(x), x).alias("v")).where("v is not null")
    rows = staged(rows)  # three passes follow, over nothing but the values
    grid = sketch("v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    one = rows.groupBy(*by).agg(F.count("*").alias("n"), grid.alias("g"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")

    def edge(rank: Column, step: int) -> Column:
        at = F.floor(rank.cast("double") / F.col("n") * GRID).cast("int") + 1 + step  # from 1
        return F.when(at < 1, F.col("lo")).when(at > GRID + 1, F.col("hi")).otherwise(F.element_at("g", F.least(F.greatest(at, F.lit(1)), F.lit(GRID + 1))))

    ranges = fixed(one.select(*by, "n", F.array(*(r.cast("bigint") for r in ranks)).alias("rank"), F.array(*(edge(r, -1) for r in ranks)).alias("a"), F.array(*(edge(r, 2) for r in ranks)).alias("b")))
    near = rows.join(F.broadcast(ranges), by) if by else rows.crossJoin(F.broadcast(ranges))
    k = range(len(ranks))
    before = near.groupBy(*by).agg(F.array(*(F.count_if(F.col("v") < F.col("a")[i]) for i in k)).alias("below"))
    before = before.join(ranges, by) if by else before.crossJoin(ranges)
    targets = before.select(*by, F.posexplode(F.zip_with("rank", "below", lambda r, m: r - m)).alias("i", "target"))
    inside = F.expr("filter(sequence(0, size(a) - 1), i -> v >= a[i] and v <= b[i])")
    held = near.select(*by, "v", F.explode(inside).alias("i")).groupBy(*by, "i", "v").agg(F.count("*").alias("m"))
    upto = held.withColumn("upto", F.sum("m").over(Window.partitionBy(*by, "i").orderBy("v")))
    found = upto.join(targets, [*by, "i"]).where((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("m") < F.col("target")))
    got = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    sizes = ranges.select(*by, "n")
    joined = sizes.join(got, by, "left") if by else sizes.crossJoin(got)
    return joined.select(*(F.col(b).alias(c) for c, b in zip(names, by, strict=True)), F.array(*(F.try_element_at("m", F.lit(i)) for i in range(len(ranks)))).alias("values"), "n")


def quantiles(df: DataFrame, value: Column, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, quantiles, n): exact quantiles, interpolated between the two nearest order statistics."""
    at = [F.lit(p) * (F.col("n") - 1).cast("double") for p in probabilities]
    stats = order_statistics(df, value, [r for a in at for r in (F.floor(a) + 1, F.ceil(a) + 1)], by)
    v = F.col("values")
    parts = [v[2 * k] + (v[2 * k + 1] - v[2 * k]) * (a - F.floor(a)) for k, a in enumerate(at)]
    return stats.select(*by, F.array(*parts).alias("quantiles"), "n")
