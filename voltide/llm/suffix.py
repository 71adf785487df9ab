"""Removal of repeated byte strings by distributed prefix doubling.

A string of LENGTH bytes is removed where it also starts earlier. Its start, a position, is ranked on its first LENGTH // 2 bytes and then on
all of them: in each round Spark sorts pairs of ranks, those of a position and of the position at the round's offset, and numbers the
pairs in their order; positions whose pair no other has drop out, and the numbers are the ranks of the next round, at twice the offset. The
first ranks are hashes of LENGTH // 4 bytes.

A row for each byte of all texts would be shuffled so. So the positions that can matter are found first, at sampled ones: of the grams of
LENGTH // 4 bytes inside a string, the one of least hash is its anchor, and equal strings have their anchor at the same place.

* Spark sorts all anchors by (hash of the gram, hash of all bytes that strings around it may have). Anchors whose gram is alone drop out
  with their strings. Where all the bytes around are equal, all but the first anchor are repeats throughout and decided; what
  is left is the first one of each of several surroundings.
* These anchors' strings are cut in PARTS runs by their distance from the anchor, and the same is done once more with what a run's strings
  have in common in place of the gram.
* Every position that is still undecided goes through the rounds of rank pairs.

So long copies are decided at their anchors, and the rounds see the ends of repeats only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, blocks, checked, least_at, mix, ragged, release, spread, texts, written

LENGTH = 100
#: Runs of strings that an open anchor's are cut into.
PARTS = 5
#: A packed length has 16 bits; longer ranges are cut in pieces.
_LONGEST = 0xFFFF
_ROLLING = Rolling()


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return mix(np.arange(256, dtype=U64) + U64(0x1234567))


class Block:
    """The bytes of a block of texts, their gram hashes, and the anchor of each string of ``length`` bytes."""

    def __init__(self, batch: list[str | None], length: int):
        raws = [(t or "").encode() for t in batch]
        self.length, self.gram = length, length // 4
        self.raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        self.prefix = _ROLLING.prefix(_bytes_table()[self.raw])
        self.anchors()

    def anchors(self) -> None:
        n, gram, width = len(self.raw), self.gram, self.length - self.gram + 1
        self.pos = self.doc = self.first = self.last = np.empty(0, dtype=np.int64)
        if n < self.length:
            return
        self.hash = mix(_ROLLING.every(self.prefix, gram))
        size = np.maximum(np.diff(self.off) - self.length + 1, 0)
        start = ragged(self.off[:-1], size)  # of the strings that lie within a text
        at = least_at(self.hash, start, width)
        doc = np.repeat(np.arange(len(size)), size)
        change = np.ones(len(at), dtype=bool)
        change[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        where = np.flatnonzero(change)
        self.pos, self.doc = at[where], doc[where]
        self.first, self.last = start[where], start[np.append(where[1:], len(start)) - 1] if len(where) else where

    def window(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(_ROLLING.window(self.prefix, start, end))


def _pack(pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return pos << 32 | left << 16 | right


def _unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pack >> 32, pack >> 16 & 0xFFFF, pack & 0xFFFF


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping ranges as one; they come in the order of text and start."""
    if not len(doc):
        return doc, start, end
    shift = doc * (int(end.max()) + 1)
    reach = np.maximum.accumulate(shift + end)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (shift + start)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - shift[at]


def _pieces(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges in pieces that a pack has room for."""
    many = -(-(end - start) // _LONGEST)
    start = np.repeat(start, many) + ragged(np.zeros(len(many), dtype=np.int64), many) * _LONGEST
    return np.repeat(doc, many), start, np.minimum(start + _LONGEST, np.repeat(end, many))


def _ranked(docs: DataFrame, length: int) -> DataFrame:
    """(name, ctx, doc_id, alt, pack) of all anchors; runs of a text's own repeats of the same surroundings come with a negative pack."""
    reach = length - length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            b = Block(block.column("text").to_pylist(), length)
            left = np.minimum(b.pos - b.off[b.doc], reach)
            right = np.minimum(b.off[b.doc + 1] - b.pos, length)
            name = b.hash[b.pos] if len(b.pos) else np.empty(0, dtype=U64)
            ctx = mix(b.window(b.pos - left, b.pos + right) + (left * 65536 + right).astype(U64))
            own = b.pos - b.off[b.doc]
            key = mix(name + mix(ctx + b.doc.astype(U64)))
            order = np.argsort(key, kind="stable")
            again = np.zeros(len(key), dtype=bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            doc, start, end = _merged(b.doc[again], (own - left)[again], (own + right)[again])
            doc, start, end = _pieces(doc, start, end)
            alone = mix(mix(doc.astype(U64) + U64(b.off[-1])) ^ start.astype(U64))  # any name: spreads them
            of = pa.array(np.concatenate([b.doc[~again], doc]))
            packs = np.concatenate([_pack(own, left, right)[~again], -_pack(start, np.zeros_like(start), end - start) - 1])
            names, surroundings = np.concatenate([name[~again], alone]), np.concatenate([ctx[~again], alone])
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(surroundings.view(np.int64)), block.column("doc_id").take(of), block.column("alt").take(of), pa.array(packs)], names=["name", "ctx", "doc_id", "alt", "pack"])

    df = spread(docs)
    return df.mapInArrow(run, f"name bigint, ctx bigint, doc_id {df.schema['doc_id'].dataType.simpleString()}, alt int, pack bigint")


def _scan(ranked: DataFrame) -> DataFrame:
    """Sorts (name, ctx, doc_id, alt, pack, ...) and walks through it: the column ``open`` is false where a position has an earlier one with equal
    surroundings, true for the first position of each of a name's several surroundings; other rows drop out."""
    rows = ranked.repartition("name").sortWithinPartitions("name", "ctx", "doc_id", "alt", "pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None  # the first row of the surroundings that the last batch ended in
        told = False  # whether that row has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            name, ctx = (batch.column(c).to_numpy() for c in ("name", "ctx"))
            new_name, first = np.ones(len(name), dtype=bool), np.ones(len(name), dtype=bool)
            new_name[1:] = name[1:] != name[:-1]
            first[1:] = new_name[1:] | (ctx[1:] != ctx[:-1])
            pack = batch.column("pack").to_numpy()
            own = pack < 0  # ranges that are repeats already
            group = np.cumsum(new_name) - 1
            several = np.bincount(group, weights=first)[group] > 1
            if carry is not None and told:
                several |= group == 0
            out = first & several
            if carry is not None and told:
                out[0] = False
            if carry is not None:
                own[0] = False  # given out with its own batch
            take = np.flatnonzero(out | ~first | own)
            if len(take):
                given = batch.take(pa.array(take))
                given = given.set_column(batch.schema.get_field_index("pack"), "pack", pa.array(np.where(own, -pack - 1, pack)[take]))
                yield pa.RecordBatch.from_arrays([*given.columns, pa.array((first & ~own)[take])], names=[*batch.schema.names, "open"])
            last = int(np.flatnonzero(first)[-1])
            told = bool(several[last])
            carry = batch.slice(last, 1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, open boolean")


def _split(low: int, high: int) -> list[tuple[int, int]]:
    """low..high in PARTS runs at most."""
    step = max(1, -(-(high - low + 1) // PARTS))
    return [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]


def _ends(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """For each open anchor, the runs of strings that belong to it, ranked on what those have in common, with the bytes around them.

    A text goes before its anchors, of which there may be any number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "alt", "text", F.lit(None).cast("bigint").alias("pack")).union(opened.select("doc_id", "alt", F.lit(None).cast("string"), "pack"))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "alt", F.col("pack").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: str | None = None  # the text that the last block ended in
        for block in blocks(batches):
            at = block.column("pack").is_valid().to_numpy(zero_copy_only=False)
            used = np.append(at[1:], True) & ~at
            given = [last, *(t if u else None for t, u in zip(block.column("text").to_pylist(), used, strict=True))]
            if not at[0]:
                given[0] = None
            own = np.flatnonzero(~at)
            # Row of ``given`` that holds the text of each anchor.
            of = np.maximum.accumulate(np.where(at, 0, np.arange(len(at)) + 1))[at]
            last = given[own[-1] + 1] if len(own) else last
            if not len(of):
                continue
            b = Block(given, length)
            anchors = np.flatnonzero(at)
            pos, _, _ = _unpack(block.column("pack").filter(pa.array(at)).to_numpy())
            k = np.searchsorted(b.pos, pos + b.off[of])
            where = b.pos[k]
            # Strings that start a bytes before the anchor, for a from low to high.
            low, high = where - b.last[k], where - b.first[k]
            for g_low, g_high in _split(0, length - length // 4):
                some = np.flatnonzero((low <= g_high) & (high >= g_low))
                p, d = where[some], of[some]
                start, end = np.maximum(p - g_high, b.off[d]), np.minimum(p - g_low + length, b.off[d + 1])
                name = mix(b.window(p - g_low, p - g_high + length) + b.hash[p] + U64(g_low))
                ctx = mix(b.window(start, end) + ((p - start) * 65536 + end - p).astype(U64))
                data = pa.array([b.raw[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)], type=pa.binary())
                take = pa.array(anchors[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(ctx.view(np.int64)), block.column("doc_id").take(take), block.column("alt").take(take), pa.array(_pack(p - b.off[d], p - start, end - p)),
                     pa.array(np.maximum(low[some], g_low).astype(np.int32)), pa.array(np.minimum(high[some], g_high).astype(np.int32)), data], names=_NAMES)

    return rows.mapInArrow(run, f"name bigint, ctx bigint, doc_id {kind}, alt int, pack bigint, low int, high int, data binary")


_NAMES = ["name", "ctx", "doc_id", "alt", "pack", "low", "high", "data"]


def _positions(opened: DataFrame, length: int) -> DataFrame:
    """(doc_id, alt, pos, a, b, c, d): every undecided string's start with the ranks of its four quarters, hashes of length // 4 bytes (rounded up)."""
    quarter = -(-length // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "data"):
            data = block.column("data").to_pylist()
            flat = np.frombuffer(b"".join(data), dtype=np.uint8)
            off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
            prefix = _ROLLING.prefix(_bytes_table()[flat])
            pack, low, high = (block.column(c).to_numpy().astype(np.int64) for c in ("pack", "low", "high"))
            pos, left, _ = _unpack(pack)
            of = np.repeat(np.arange(len(pos)), high - low + 1)
            before = ragged(low, high - low + 1)  # bytes from the string's start to the anchor
            start = (off[:-1] + left)[of] - before
            ranks = [_ROLLING.window(prefix, start + x, start + x + quarter) for x in (0, quarter, length - 2 * quarter, length - quarter)]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(take), block.column("alt").take(take), pa.array((pos[of] - before).astype(np.int32)), *(pa.array(r.view(np.int64)) for r in ranks)],
                names=["doc_id", "alt", "pos", "a", "b", "c", "d"],
            )

    kind = opened.schema["doc_id"].dataType.simpleString()
    return opened.select("doc_id", "alt", "pack", "low", "high", "data").mapInArrow(run, f"doc_id {kind}, alt int, pos int, a bigint, b bigint, c bigint, d bigint")


def _reranked(pairs: DataFrame) -> DataFrame:
    """(x, y, rank): the pairs of ranks that occur twice or more, sorted and numbered in that order.

    Equal pairs are counted before they are shuffled, so the sort sees each once, however many positions have it.
    """
    several = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    return written(several.repartitionByRange("x", "y").sortWithinPartitions("x", "y").withColumn("rank", F.monotonically_increasing_id()))


def _doubled(positions: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, end) of the strings at ``positions`` that also start earlier, by two rounds of rank pairs."""
    halves = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("c").alias("x"), F.col("d").alias("y")))).alias("h")
    ranks = _reranked(positions.select(halves).select("h.x", "h.y"))
    for x, y, name in (("a", "b", "first"), ("c", "d", "second")):
        positions = positions.join(ranks.select(F.col("x").alias(x), F.col("y").alias(y), F.col("rank").alias(name)), [x, y]).drop(x, y)
    positions = written(positions.select("doc_id", "alt", "pos", F.col("first").alias("x"), F.col("second").alias("y")))
    release(positions.sparkSession)
    here = F.struct("doc_id", "alt", "pos")
    earliest = positions.groupBy("x", "y").agg(F.min(here).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = positions.join(earliest, ["x", "y"]).where(here != F.col("earliest"))
    return again.select("doc_id", "alt", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"))


def _span(rows: DataFrame) -> DataFrame:
    """(doc_id, alt, start, end) of the bytes around positions."""
    pos, left, right = F.shiftright("pack", 32), F.shiftright("pack", 16).bitwiseAND(0xFFFF), F.col("pack").bitwiseAND(0xFFFF)
    return rows.select("doc_id", "alt", (pos - left).cast("int").alias("start"), (pos + right).cast("int").alias("end"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, alt, start, end): byte ranges, which may overlap, that together are all bytes to remove. ``docs`` has doc_id, alt and text."""
    seen = written(_scan(_ranked(docs, length)))
    release(docs.sparkSession)
    rest = written(_scan(_ends(docs, seen.where("open"), length)))
    release(docs.sparkSession)
    decided = _span(seen.where("not open")).union(_span(rest.where("not open")))
    return decided.union(_doubled(written(_positions(rest.where("open"), length)), length))


def _repeated(docs: DataFrame) -> DataFrame | None:
    """The doc_ids of several rows, or None where there are none."""
    found = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("_repeated"))
    return checked(found) if found.limit(1).count() else None


def _told_apart(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``docs`` with a column _alt: a hash of the text where a doc_id has several rows, else 0."""
    if repeated is None:
        return docs.withColumn("_alt", F.lit(0))
    alt = F.when(F.col("_repeated"), F.hash(F.coalesce("text", F.lit("")))).otherwise(0)
    return docs.join(repeated, "doc_id", "left").withColumn("_alt", alt).drop("_repeated")


def _once(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(doc_id, alt, text): every document once."""
    told = _told_apart(texts(docs).where("doc_id is not null"), repeated).select("doc_id", F.col("_alt").alias("alt"), "text")
    return told if repeated is None else told.dropDuplicates(["doc_id", "alt"])


def removed(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """(doc_id, alt, n_bytes, n_removed, spans, kept): one row for each document; spans are the maximal removed runs, kept the other bytes.

    A null or empty text has no bytes; one of fewer than ``length`` bytes loses none. Rows without a doc_id are left out. Rows that
    repeat a doc_id with different texts are documents of their own, in the order of alt, a hash of the text (0 where a doc_id has one
    row); rows that repeat both are one document. With ``as_text`` kept is a string, without the bytes of characters cut in two.
    """
    once = _once(docs, _repeated(docs))
    return _without(once, repeats(once, length), as_text)


def _without(once: DataFrame, spans: DataFrame, as_text: bool) -> DataFrame:
    found = spans.groupBy("doc_id", "alt").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = once.join(found, ["doc_id", "alt"], "left").select("doc_id", "alt", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            size, gone, merged, kept = [], [], [], []
            column = block.column("spans")
            per = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = column.flatten()
            starts, ends = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            for k, text in enumerate(block.column("text").to_pylist()):
                raw = text.encode()
                size.append(len(raw))
                if per[k] == per[k + 1]:
                    gone.append(0)
                    merged.append([])
                    kept.append(raw)
                    continue
                deltas = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(deltas, starts[per[k] : per[k + 1]], 1)
                np.add.at(deltas, ends[per[k] : per[k + 1]], -1)
                out = np.cumsum(deltas)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                gone.append(int(out.sum()))
                merged.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                kept.append(np.frombuffer(raw, dtype=np.uint8)[~out].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("alt"), pa.array(size, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(merged, type=kind), pa.array([k.decode("utf-8", "ignore") for k in kept], type=pa.string()) if as_text else pa.array(kept, type=pa.binary())], names=["doc_id", "alt", "n_bytes", "n_removed", "spans", "kept"])

    kind = once.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, alt int, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept {'string' if as_text else 'binary'}")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings taken out of their texts; bytes of characters cut in two go as well.

    Each row loses what its own text repeats: of rows that repeat a doc_id with different texts each is judged by itself, those that repeat
    both get the same text. A null text stays null and rows without a doc_id stay as they are; so do all columns other than text.
    """
    found = removed(docs, length, as_text=True).where("n_removed > 0").select("doc_id", F.col("alt").alias("_alt"), F.col("kept").alias("_kept"))
    rows = _told_apart(docs, _repeated(docs)).join(found, ["doc_id", "_alt"], "left")
    text = F.when(F.col("text").isNotNull() & F.col("_kept").isNotNull(), F.col("_kept")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(docs.columns)
