"""Benchmark decontamination by greedy string tiling.

The benchmark is cut into blocks of bounded size. Each task holds one block's runs of MIN_MATCH words (seeds) sorted by hash and joins the
words of its documents with them, so no text is shuffled and a seed that many items and documents share makes no rows. Where the shared
seeds lie on enough of an item, the longest common runs of words are marked again and again, without overlap on either side,
until none of MIN_MATCH words is left; the share of the item's words under marks decides, whatever the order of the passages in the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, ragged, spread, texts
from .tokens import runs, tokenise

#: Words of the shortest match.
MIN_MATCH = 5
#: Share of an item's words from which a document counts as contaminated with it.
COVERAGE = 0.5
#: Characters of the benchmark that a task holds at once (a longer item is a block of its own); a larger benchmark takes several passes.
BLOCK_CHARS = 8 << 20
#: Pairs of a document's and an item's seed that are laid out at once.
_STEP = 1 << 20
_FILTER_BITS = 22


class Seeds:
    """The runs of ``length`` words of some items, found by hash."""

    def __init__(self, words: np.ndarray, off: np.ndarray, length: int, which: np.ndarray):
        start = ragged(off[which], (off[1:] - off[:-1])[which] - length + 1)
        keys = runs(words, start, np.full(len(start), length))
        order = np.argsort(keys, kind="stable")
        self.length, self.keys, self.place = length, keys[order], start[order].astype(np.int32)
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[(keys >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of each run of the texts' words that is a seed, and the range of ``keys`` that equals it."""
        size = np.maximum(np.diff(off) - self.length + 1, 0)
        start = ragged(off[:-1], size)
        keys = runs(words, start, np.full(len(start), self.length))
        maybe = np.flatnonzero(self.seen[(keys >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        low, high = (np.searchsorted(self.keys, keys[maybe], side) for side in ("left", "right"))
        some = high > low
        return np.repeat(np.arange(len(size)), size)[maybe[some]], low[some], high[some]


class Index:
    """A block of items: their words, and their seeds. Items of fewer than MIN_MATCH words have one seed, of all their words."""

    def __init__(self, batch: list[str]):
        self.words, self.off = tokenise(batch)
        self.size = np.diff(self.off)
        self.item = np.repeat(np.arange(len(batch), dtype=np.int32), self.size)
        kinds = [(n, np.flatnonzero(self.size == n)) for n in range(1, MIN_MATCH)] + [(MIN_MATCH, np.flatnonzero(self.size >= MIN_MATCH))]
        self.seeds = [Seeds(self.words, self.off, n, which) for n, which in kinds if len(which)]

    def candidates(self, words: np.ndarray, off: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """Texts and items whose shared seeds lie on ``coverage`` or more of the item's words: no tiling covers more."""
        n = len(self.words)
        for seeds in self.seeds:
            doc, low, high = seeds.hits(words, off)
            ends = np.cumsum(high - low)
            found: list[np.ndarray] = []
            at = 0
            while at < len(doc):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, side="right")))
                place = seeds.place[ragged(low[at:to], (high - low)[at:to])].astype(np.int64)
                found.append(np.unique(np.repeat(doc[at:to], (high - low)[at:to]) * n + place))
                at = to
            if not found:
                continue
            code = np.unique(np.concatenate(found))
            doc, place = code // n, code % n
            item = self.item[place]
            last = np.append((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True)
            covers = np.where(last, seeds.length, np.minimum(np.append(np.diff(place), 0), seeds.length))
            end = np.flatnonzero(last)
            total = np.diff(np.concatenate([[0], np.cumsum(covers)[end]]))
            enough = total >= coverage * self.size[item[end]]
            yield from zip(doc[end[enough]].tolist(), item[end[enough]].tolist(), strict=True)

    def tiled(self, batch: list[str | None], coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, tiles, covered words, words of the item) of all pairs with ``coverage`` or more."""
        words, off = tokenise(batch)
        of, text = -1, None
        for doc, item in sorted(self.candidates(words, off, coverage)):
            if doc != of:
                of, text = doc, Text(words[off[doc] : off[doc + 1]])
            got = text.tiles(self.words[self.off[item] : self.off[item + 1]])
            covered, size = sum(n for *_, n in got), int(self.size[item])
            if covered >= coverage * size:
                yield doc, item, len(got), covered, size


class Text:
    """A text's words, with the hashes of its runs (by length) sorted once for all items."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self._sorted:
            start = np.arange(max(len(self.words) - length + 1, 0))
            keys = runs(self.words, start, np.full(len(start), length))
            order = np.argsort(keys, kind="stable")
            self._sorted[length] = keys[order], order
        return self._sorted[length]

    def matches(self, item: np.ndarray, length: int) -> list[tuple[int, int, int]]:
        """(-n, start in the text, start in the item) of all longest common runs of ``length`` words or more, by Karp-Rabin hashes."""
        keys, place = self._runs(length)
        start = np.arange(max(len(item) - length + 1, 0))
        wanted = runs(item, start, np.full(len(start), length))
        low, high = (np.searchsorted(keys, wanted, side) for side in ("left", "right"))
        ends = np.cumsum(high - low)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, side="right")))
            size = (high - low)[at:to]
            b = np.repeat(start[at:to], size)
            parts.append(_joined(place[ragged(low[at:to], size)] - b, b, np.ones(len(b), dtype=np.int64)))
            at = to
        if not parts:
            return []
        diagonal, b, n = _joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return list(zip((1 - length - n).tolist(), (diagonal + b).tolist(), b.tolist(), strict=True))

    def tiles(self, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
        """Greedy string tiling: (start in text, start in item, length) of each tile.

        Longest first; of equally long matches the first in the text, then in the item. An item shorter than ``min_match`` words
        is matched as a whole. A match that a tile has come to overlap goes on with what is left of it.
        """
        least = min(min_match, len(item))
        if not least:
            return []
        free_t, free_i = np.ones(len(self.words), dtype=bool), np.ones(len(item), dtype=bool)
        found: list[tuple[int, int, int]] = []
        open_matches = self.matches(item, least)
        heapq.heapify(open_matches)
        while open_matches:
            n, a, b = heapq.heappop(open_matches)
            n = -n
            free = free_t[a : a + n] & free_i[b : b + n]
            if free.all():
                free_t[a : a + n] = free_i[b : b + n] = False
                found.append((a, b, n))
                if max((y - x for x, y in _stretches(free_i)), default=0) < least:
                    break
                continue
            for x, y in _stretches(free):
                if y - x >= least:
                    heapq.heappush(open_matches, (x - y, a + x, b + x))
        return found


def _joined(diagonal: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of n matches from b on each diagonal, with those that follow each other as one."""
    order = np.lexsort((b, diagonal))
    diagonal, b, n = diagonal[order], b[order], n[order]
    new = np.ones(len(b), dtype=bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (b[1:] != b[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return diagonal[first], b[first], np.add.reduceat(n, first) if len(first) else n


def _stretches(free: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tiles(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences, as ``Text.tiles``."""
    return Text(text).tiles(item, min_match)


def _indexes(benchmark: DataFrame) -> Iterator[tuple[Index, pa.Array]]:
    """The benchmark's blocks, and the ids of their items; only one block is with the driver at a time."""
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    parts = -(-chars // BLOCK_CHARS)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow()
        if rows.num_rows:
            yield Index(rows.column("text").to_pylist()), rows.column("item_id").combine_chunks()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, n_item, coverage): pairs of which ``coverage`` or more of the item's words is tiled.

    Null or empty texts and items without a word match nothing; an item of fewer than MIN_MATCH words matches as a whole. Rows without
    an id are left out. A doc_id or item_id with several texts is matched text by text, and the best tiling is returned, once.
    """
    d = spread(texts(docs).where("doc_id is not null and text is not null"))
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, n_tiles bigint, covered bigint, n_item bigint"
    passes = [d.mapInArrow(_finder(index, ids, coverage), schema) for index, ids in _indexes(benchmark)]
    tiled = reduce(DataFrame.union, passes) if passes else d.sparkSession.createDataFrame([], schema)
    best = tiled.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "n_tiles", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_tiles", "b.covered", "b.n_item", (F.col("b.covered") / F.col("b.n_item")).alias("coverage"))


def _finder(index: Index, ids: pa.Array, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            got = list(index.tiled(block.column("text").to_pylist(), coverage))
            doc, item, *counts = (pa.array(c, type=pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * 5))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(doc), ids.take(item), *counts], names=["doc_id", "item_id", "n_tiles", "covered", "n_item"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows whose text is not contaminated, all columns kept; each row by its own text, whether it has a doc_id or not."""
    out = spread(docs)
    for index, _ in _indexes(benchmark):
        out = out.mapInArrow(_sieve(index, coverage), docs.schema)
    return out


def _sieve(index: Index, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keep = np.ones(block.num_rows, dtype=bool)
            keep[[doc for doc, *_ in index.tiled(block.column("text").to_pylist(), coverage)]] = False
            yield block.filter(pa.array(keep))

    return run
