"""Ranked lexical search of every document for each item of a query set, by bag deduplication.

A document counts for an item only by its term frequencies within the items' vocabulary and by its length m. So documents are first cut down to such a
bag; documents of identical bag and m (found by hash, verified by comparing the bags themselves) are one class, classes are scored once, and a class's
members follow in ascending order of doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, ragged, shared_dir, spread, texts, written

#: Bytes that are no part of a term become spaces, A to Z become a to z; bytes of other code points than ASCII stay.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: (item, term) pairs that one pass over the documents takes: its tables are the only ones that every task holds. More items take more passes.
BLOCK_PAIRS = 200_000
#: Scored at once: classes times items, and classes times pairs.
_CELLS, _TERMS = 1 << 21, 1 << 24
#: Integers up to this are exact as doubles.
_EXACT = 1 << 53


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


class Items:
    """The items of one block: their vocabulary, and the items that hold each term, one term after another."""

    def __init__(self, pairs: list[tuple[object, str]]) -> None:
        self.ids = list(dict.fromkeys(i for i, _ in pairs))
        number = {x: k for k, x in enumerate(self.ids)}
        held: dict[bytes, list[int]] = {}
        for i, t in pairs:
            held.setdefault(t.encode("utf-8", "surrogatepass"), []).append(number[i])
        self.terms = {t: k for k, t in enumerate(sorted(held))}
        each = [sorted(held[t]) for t in self.terms]
        self.count = np.array([len(x) for x in each], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.items = np.array([i for x in each for i in x], dtype=np.int64)


def bags(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, bag): number of terms, and (term, frequency) pairs of 32-bit integers by ascending term within the vocabulary of ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.terms
        for batch in blocks(batches):
            n, packed = [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                found = Counter(map(number.get, words))
                found.pop(None, 0)
                n.append(len(words))
                packed.append(np.array(sorted(found.items()), dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "bag"])

    df = spread(texts(docs))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n bigint, bag binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' numbers of terms, and terms and frequencies of all rows one after another."""
    raw = column.to_pylist()
    both = np.frombuffer(b"".join(raw), dtype="<u4").reshape(-1, 2).astype(np.int64)
    return np.fromiter((len(x) // 8 for x in raw), dtype=np.int64, count=len(raw)), both[:, 0], both[:, 1]


def document_frequencies(bagged: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of a vocabulary of ``size`` terms: a row for each task and term, then one for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0))[1], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in bagged.select("bag").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a block's terms
        out[r.term] = r.df
    return out


def classes(bagged: DataFrame, documents: int, occurrences: int, top: int) -> DataFrame:
    """(m, bag, members): classes of identical bag and m, with their ``top`` least doc_ids in ascending order.

    Only the first members of a class can be among the best of an item, so the window keeps ``top`` rows of a class in each task before the shuffle,
    whatever the class's size. Rows meet by a hash; as the bag itself is a key too, only identical ones are a class. Documents without a term of the
    vocabulary are in no class.
    """
    m = F.expr(f"cast(10 as bigint) + cast(((cast(90 as decimal(2,0)) * cast(n as decimal(16,0)) * cast({documents} as decimal(18,0))) div {max(occurrences, 1)}) as bigint)")
    rows = bagged.where("doc_id is not null and octet_length(bag) > 0").select("doc_id", m.alias("m"), "bag").withColumn("h", F.xxhash64("bag", "m"))
    key = ["h", "m", "bag"]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))).where(F.col("place") <= top)
    return first.groupBy(*key).agg(F.array_sort(F.collect_list("doc_id")).alias("members")).select("m", "bag", "members")


def scored(grouped: DataFrame, shared, weight: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): each task's ``top`` best members of its classes for each item of the block."""
    kind = grouped.schema["members"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n_items = len(own.ids)
        most = int(np.bincount(own.items, minlength=1).max(initial=0)) * int(weight.max(initial=0)) * 1_000_000
        step = max(1, min(_CELLS // max(n_items, 1), _TERMS // max(len(own.items), 1)))
        item, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        doc, least, doc_type = None, np.ones(n_items, dtype=np.int64), None
        for batch in batches:
            doc_type = batch.column(2).type.value_type
            lens, term, tf = _unpacked(batch.column(1))
            m, off = np.repeat(batch.column(0).to_numpy(), lens), np.concatenate([[0], np.cumsum(lens)])
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            members = batch.column(2)
            starts, flat = members.offsets.to_numpy().astype(np.int64), members.values
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                t, g = term[off[lo] : off[hi]], gain[off[lo] : off[hi]]
                row = np.repeat(np.arange(hi - lo), lens[lo:hi])
                cell = np.repeat(row, own.count[t]) * n_items + own.items[ragged(own.first[t], own.count[t])]
                each = np.repeat(g, own.count[t])
                if most < _EXACT:
                    total = np.bincount(cell, weights=each, minlength=(hi - lo) * n_items).astype(np.int64)
                else:
                    total = np.zeros((hi - lo) * n_items, dtype=np.int64)
                    np.add.at(total, cell, each)
                total = total.reshape(hi - lo, n_items)
                c, i = np.nonzero(total >= least)
                if not len(c):
                    continue
                size = starts[lo + c + 1] - starts[lo + c]
                new = flat.take(pa.array(ragged(starts[lo + c], size)))
                doc = new if doc is None else pa.concat_arrays([doc, new])
                item = np.concatenate([item, np.repeat(i, size)])
                score = np.concatenate([score, np.repeat(total[c, i], size)])
                rank = np.unique(doc.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                order = np.lexsort((rank, -score, item))
                place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
                keep = order[place < top]
                item, score, doc = item[keep], score[keep], doc.take(pa.array(keep))
                full = np.flatnonzero(np.bincount(item, minlength=n_items) >= top)
                last = np.searchsorted(item, full, side="right") - 1  # rows are sorted by item, best first
                least[full] = score[last]
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(item), doc.cast(doc_type), pa.array(score)], names=["item", "doc_id", "score"])

    return grouped.mapInArrow(run, f"item bigint, doc_id {kind.simpleString()}, score bigint")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each once; rows of one item_id are one item with the terms of all of them."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(found).alias("term")).distinct()


def _pass(docs: DataFrame, pairs: list[tuple[object, str]], item_type: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    block = Items(pairs)
    shared = spark.sparkContext.broadcast(block)  # BLOCK_PAIRS pairs or about as many
    bagged = written(bags(docs, shared))
    one = bagged.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    df = document_frequencies(bagged, len(block.terms))
    weight = np.floor(1000 * np.log((2.0 * one.documents + 2) / (2.0 * df + 1))).astype(np.int64)
    best = scored(classes(bagged, one.documents, one.occurrences, top), shared, weight, top)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame([(k, x) for k, x in enumerate(block.ids)], f"item bigint, item_id {item_type}")
    out = best.withColumn("rank", place.cast("int")).where(F.col("rank") <= top).join(names, "item").select("item_id", "rank", "doc_id", "score")
    out = written(out)
    shared.destroy()
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of positive score for each item, equal scores by ascending doc_id.

    Every whole text counts. A null or empty text has no term and counts in nothing; rows without a doc_id count in the statistics, but are not
    ranked, as nothing names them; rows that repeat a doc_id are documents of their own, and so may stand next to each other with one id. Rows of one
    item_id are one item (those without one, too); items without a term, or whose terms no document has, give no row. An empty table gives an empty one.
    Items are taken in blocks of about ``block_pairs`` pairs of item and term, a pass over the documents for each.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    found = written(item_terms(items))
    kind = items.schema["item_id"].dataType.simpleString()
    n_blocks = max(1, -(-found.count() // block_pairs))
    done = None
    for k in range(n_blocks):
        pairs = [tuple(r) for r in found.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).orderBy("item_id", "term").collect()]  # one block
        if not pairs:
            continue
        part = _pass(docs, pairs, kind, top)
        done = part if done is None else done.unionByName(part)
    empty = f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    return spark.createDataFrame([], empty) if done is None else done


SQL = rf"""
with words as (
  select row_number() over () as u, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}') as t from documents
), docs as (select u, doc_id, len(t) as n, t from words where len(t) > 0),
total as (select count(*) as big_n, sum(n) as big_l from docs),
items as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')) as term from benchmark),
vocabulary as (select distinct term from items),
each as (select u, doc_id, n, unnest(t) as term from docs),
tf as (select u, doc_id, n, term, count(*) as tf from each semi join vocabulary using (term) group by all),
weights as (select term, cast(floor(1000 * ln((2E0 * any_value(big_n) + 2) / (2E0 * count(*) + 1))) as bigint) as w from tf, total group by term),
gains as (select u, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (cast(90 as hugeint) * n * big_n) // big_l))) as gain from tf join weights using (term), total),
scores as (select item_id, u, doc_id, cast(sum(gain) as bigint) as score from items join gains using (term) group by all having sum(gain) > 0),
places as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scores where doc_id is not null)
select item_id, cast(place as int) as rank, doc_id, score from places where place <= {TOP}
"""
