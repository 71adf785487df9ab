"""Mixing sources to target weights by balanced sampling with the cube method.

Every row of a source is to be taken target / source_size times on average. The whole part is taken for certain; the fraction is an inclusion
probability. The cube method's flight moves the probabilities of three rows at a time along the null space of their constraints, so that the
expected number of words and of documents stays what it is, until they are 0 or 1. At most two rows of a source are left for the landing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, blocks, checked, mix, spread, written

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix has, and how many times a source's words it may have.
TOTAL, MOST = 1.5, 2.0
#: Rows that one flight takes, and rows of a lane: lanes of a flight move together.
UNITS, LANE = 4096, 64
#: Probabilities this near to 0 or 1 are decided.
_NEAR = 1e-9
#: In the last flight of a source, rows with over this share of the words still open are decided first, and the others make up for them.
_HEAVY = 0.005
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[32, *range(9, 14)]] = False


def count_words(column: pa.Array) -> np.ndarray:
    """Runs of bytes other than space and \\t to \\r in each text (null: 0)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(len(column), dtype=np.int64)
    inside = _INSIDE[np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]]
    ends -= ends[0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(inside)]
    begins[first] = inside[first]
    upto = np.concatenate([[0], np.cumsum(begins)])
    return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, upto[ends[1:]] - upto[ends[:-1]])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of every whole text."""
    df = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_words(batch.column(2)))], names=["doc_id", "source", "size"])

    return df.mapInArrow(run, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("doc_id", "source")) + ", size bigint")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, rows, source_size, target) from rows (source, size, times).

    Sources by code point, null last, have the weights in turn. What a source's cap (``most`` times its size) leaves over is shared by weight among
    the others: a source gets the smaller of its cap and level times weight. With the sources in the order in which they reach their caps, the level
    that follows from the first k being at their caps is greatest for the right k. One row a source; the windows run over that table.
    """
    each = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.col("size") * F.col("times")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * float(most)
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole).cast("double") * float(total) - capped) / rest
    levels = each.withColumn("_level", level)
    return levels.select("source", "rows", "source_size", F.least(cap, F.max("_level").over(whole) * F.col("weight")).alias("target"))


def _draws(seed: int, n: int) -> np.ndarray:
    """n numbers in [0, 1) that follow from the seed."""
    return mix(np.arange(n, dtype=U64) + mix(np.array([seed & (2**64 - 1)], dtype=U64))).astype(np.float64) / 2.0**64


def _settled(p: np.ndarray) -> np.ndarray:
    return np.where(p < _NEAR, 0.0, np.where(p > 1 - _NEAR, 1.0, p))


def _step(p: np.ndarray, u: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Rows of p moved along u or against it, as far as they go, with the chances that keep the mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min(axis=1)
        down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min(axis=1)
        move = np.where(draw * (up + down) < down, up, -down)
    return _settled(np.clip(p + move[:, None] * u, 0.0, 1.0))


def flight(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but two at most; sums of p and of p * size stay.

    Rows are dealt in their order to lanes of LANE rows, which step side by side; what the lanes leave open goes on in new lanes.
    """
    p, size = _settled(p.astype(float)), size.astype(float)
    turn = 0
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        if len(open_) < 3:
            return p
        lanes = -(-len(open_) // LANE)
        queue = np.full((lanes, LANE), -1, dtype=np.int64)
        queue.ravel()[: len(open_)] = open_
        held, at = queue[:, :3].copy(), np.full(lanes, 3)
        while True:
            go = np.flatnonzero((held >= 0).all(axis=1))
            if not len(go):
                break
            now = held[go]
            s = size[now]
            u = np.stack([s[:, 1] - s[:, 2], s[:, 2] - s[:, 0], s[:, 0] - s[:, 1]], axis=1)
            u[~u.any(axis=1)] = (1.0, -1.0, 0.0)
            turn += 1
            p[now] = _step(p[now], u, _draws(seed + turn, lanes)[go])
            for k in range(3):
                done = go[(p[held[go, k]] <= 0) | (p[held[go, k]] >= 1)]
                more = at[done] < LANE
                held[done, k] = np.where(more, queue[done, np.minimum(at[done], LANE - 1)], -1)
                at[done] += more


def _spread_out(size: np.ndarray, p: np.ndarray, words: float, count: float) -> np.ndarray | None:
    """p with ``words`` more words and ``count`` more documents on average, evenly changed; at least the words, if both can't be; else None."""
    n, s, ss = len(p), size.sum(), (size * size).sum()
    det = n * ss - s * s
    ways = []
    if det > 0:
        a, b = (count * ss - words * s) / det, (n * words - count * s) / det
        ways.append(p + a + b * size)
    if ss > 0:
        room = np.where(words > 0, 1 - p, p) * size
        if room.sum() > 0:
            ways.append(p + np.where(words > 0, 1 - p, p) * words / room.sum())
    return next((w for w in ways if w.min() >= 0 and w.max() <= 1), None)


def land(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """0 or 1 for each row of a source: its heavy rows are decided one by one, the largest first, and the others' probabilities make up for them;
    the others fly; of the two that may be left, the outcome that is nearest to the words wanted is taken."""
    p, size = _settled(p.astype(float)), size.astype(float)
    order = np.argsort(-size, kind="stable")
    draw = _draws(seed ^ 0x5EED, len(p))
    want = float((p * size).sum())
    for i, k in enumerate(order[:-1]):
        rest = order[i + 1 :]
        rest = rest[(p[rest] > 0) & (p[rest] < 1)]
        if size[k] <= _HEAVY * size[rest].sum() or not len(rest):
            break
        if not 0 < p[k] < 1:
            continue
        for v in (1.0, 0.0) if draw[k] < p[k] else (0.0, 1.0):
            new = _spread_out(size[rest], p[rest], (p[k] - v) * size[k], p[k] - v)
            if new is not None:
                p[rest], p[k] = _settled(new), v
                break
    p = flight(size, p, seed)
    left = np.flatnonzero((p > 0) & (p < 1))
    fixed = float((np.where((p > 0) & (p < 1), 0.0, p) * size).sum())
    best = min(range(1 << len(left)), key=lambda x: (abs(fixed + sum(size[k] for j, k in enumerate(left) if x >> j & 1) - want), abs(bin(x).count("1") - p[left].sum())))
    for j, k in enumerate(left):
        p[k] = best >> j & 1
    return p


def _flown(units: DataFrame, seed: int, units_each: int) -> DataFrame:
    """One round: each source's open rows, dealt over groups of about ``units_each`` by hash, fly; a source that has one group lands."""
    groups = units.groupBy("source").agg(F.ceil(F.count("*") / units_each).cast("int").alias("groups"))
    dealt = units.join(checked(groups.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    dealt = dealt.select("doc_id", "source", "size", "p", "mark", "groups", F.pmod("mark", F.col("groups")).cast("int").alias("cell"))

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "size"], kind="stable")
        own = seed + int(pdf["mark"].iloc[0]) % (1 << 48)
        f = land if pdf["groups"].iloc[0] == 1 else flight
        return pdf[["doc_id", "source", "size", "mark"]].assign(p=f(pdf["size"].to_numpy(), pdf["p"].to_numpy(), own))

    kinds = ", ".join(f"{c} {units.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "size", "mark"))
    return dealt.groupBy("source", "cell").applyInPandas(fly, f"{kinds}, p double")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 20240229, units: int = UNITS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row: how often the mix takes it, and its words times that.

    Words and documents of a source stay balanced to its target, but for two rows at most. A row's copies follow from its doc_id, source and size, the
    table's other rows and the seed: reruns agree, whatever the partitions. Rows of one doc_id, source and size are alike: they are one unit of the
    flight, so many of which are taken for certain that its probability stays below 1; so no key is hot. Null and empty texts have no words; null
    sources are one source, the last; a source without words has target 0. Groups of ``units`` rows fly at a time, and what they leave open (two rows
    each) flies again, until each source is one group. An empty table gives an empty one.
    """
    units_of = written(sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")))
    by_source = written(targets(units_of, weights, total, most))
    same = units_of.join(checked(by_source.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "rows")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.floor(F.col("each")).cast("int")
    many = F.col("times") * (F.col("each") - F.col("sure"))
    whole = F.floor(many + F.lit(_NEAR)).cast("bigint")
    p = F.greatest(many - F.col("whole"), F.lit(0.0))
    mark = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("size"), F.lit(seed))
    rows = written(same.withColumn("each", each).withColumn("sure", sure).withColumn("whole", whole).withColumn("p", p).withColumn("mark", mark))
    open_ = rows.where(F.col("p") > _NEAR).select("doc_id", "source", "size", "p", "mark")
    flown, turn = None, 0
    while True:
        step = written(_flown(open_, seed + turn, units))
        decided = step.where("p = 0 or p = 1")
        flown = decided if flown is None else flown.unionByName(decided)
        open_ = step.where("p > 0 and p < 1")
        turn += 1
        if not open_.limit(1).count():
            break
    won = flown.where("p = 1").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.lit(1).alias("won"))
    key = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    out = rows.join(won, key, "left").withColumn("extra", F.col("whole") + F.coalesce("won", F.lit(0)))
    # the unit's rows again: those that are taken once more come first
    part = F.explode(F.expr(f"sequence(0L, times - 1, {1 << 20}L)")).alias("_from")
    out = out.select("doc_id", "source", "size", "source_size", "target", "sure", "extra", "times", part)
    out = out.select("*", F.explode(F.expr(f"sequence(_from, least(times, _from + {1 << 20}) - 1)")).alias("_i"))
    copies = F.col("sure") + (F.col("_i") < F.col("extra")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
