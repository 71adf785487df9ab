"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn by hash from its code point. A trigram binds its letters: the product of the first one's vector
permuted twice, the second one's permuted once and the third one's. A text bundles (sums) its trigrams; a language's
prototype is the sum of its texts' vectors at unit length. A text gets the language of the greatest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, mix, spread, texts

DIM = 512
SEED = 20240229
#: Texts are bundled in groups of at most this many characters and rows, over this many distinct trigrams at a time.
GROUP_CHARS, GROUP_ROWS, SLICE = 1 << 20, 512, 4096
#: Numbers of trigrams up to which they are counted in a table in place of being sorted.
_TABLE = 1 << 22
#: Scale of the cosines in the score's softmax.
SHARPNESS = 20.0


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), dtype=bool, count=0x110000)


def letters(cps: np.ndarray) -> np.ndarray:
    """The vectors of characters: DIM signs that follow from the code point, so that every letter of every script has its own."""
    word = mix(cps.astype(U64)[:, None] * U64(DIM // 64) + np.arange(DIM // 64, dtype=U64)[None, :] + U64(SEED << 32))
    return np.unpackbits(word.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def bind(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Vectors of trigrams from those of their letters."""
    return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third


def bundle(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sums of trigram vectors, and whether each has a letter. Character 0 stands for a run of what is no letter."""
    out, has = np.zeros((len(batch), DIM), dtype=np.float32), np.zeros(len(batch), dtype=bool)
    at = 0
    while at < len(batch):
        group, size = [], 0
        while at + len(group) < len(batch) and len(group) < GROUP_ROWS and (not group or size < GROUP_CHARS):
            group.append((batch[at + len(group)] or "").lower())
            size += len(group[-1])
        cps = np.frombuffer(" ".join(["", *group, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _is_letter()[cps]
        lens = np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1  # with the space after it
        doc = np.concatenate([[0], np.repeat(np.arange(len(group)), lens)])
        has[at : at + len(group)] = np.bincount(doc, weights=letter, minlength=len(group)) > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one boundary after each run of letters
        keep[0] = True
        seen = np.zeros(0x110000, dtype=bool)
        seen[cps[letter]] = True
        alphabet = np.concatenate([[0], np.flatnonzero(seen)])
        place = np.zeros(0x110000, dtype=np.int32)
        place[alphabet] = np.arange(len(alphabet))
        sym, doc = np.where(letter, place[cps], 0)[keep].astype(np.int64), doc[keep]
        if len(sym) > 2:
            n = len(alphabet)
            codes = (sym[:-2] * n + sym[1:-1]) * n + sym[2:]
            of, whole = doc[1:-1], doc[1:-1] == doc[2:]  # the boundary before a text may stand for its start
            distinct, slot = _numbered(codes[whole], n**3)
            of, vectors = of[whole], letters(alphabet)
            for lo in range(0, len(distinct), SLICE):
                some = distinct[lo : lo + SLICE]
                inside = (slot >= lo) & (slot < lo + len(some)) if len(distinct) > SLICE else slice(None)
                counts = np.bincount(of[inside] * len(some) + slot[inside] - lo, minlength=len(group) * len(some)).reshape(len(group), len(some))
                bound = bind(vectors[some // (n * n)], vectors[some // n % n], vectors[some % n])
                out[at : at + len(group)] += counts.astype(np.float32) @ bound.astype(np.float32)
        at += len(group)
    return out, has


def _numbered(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and each one's number among them."""
    if limit > _TABLE:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(limit, dtype=bool)
    seen[codes] = True
    distinct, place = np.flatnonzero(seen), np.zeros(limit, dtype=np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[codes]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def fit(docs: DataFrame, max_rows: int = 20_000, held_out_mod: int = 4, held_out: int = 2) -> dict[str, list[float]]:
    """Prototype of each language, from a bounded sample of about ``max_rows`` documents at most.

    Only text and lang of documents whose crc32(doc_id as text) modulo ``held_out_mod`` is not ``held_out`` are learnt from,
    and only where neither is null. Without any, there are no prototypes.
    """
    known = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % held_out_mod != held_out)
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    taken = known.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30) < share).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in blocks(batches):
            v, _ = bundle(batch.column("text").to_pylist())
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0.0) + _unit(v[langs == lang].astype(np.float64)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()), pa.array([s.tolist() for s in sums.values()], type=pa.list_(pa.float64()))], names=["lang", "v"])

    parts = spread(taken).mapInArrow(run, "lang string, v array<double>")
    # One row for each language and dimension, whatever the number of partitions.
    rows = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()
    out: dict[str, list[float]] = {}
    for r in rows:
        out.setdefault(r["lang"], [0.0] * DIM)[r["d"]] = r["x"]
    return out


def predict(docs: DataFrame, prototypes: dict[str, list[float]]) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    lang_pred is the language of the closest prototype (the first by name of equal ones), and und, with score 0, where the
    text is null or has no letter or nothing was learnt. score is the softmax of the cosines. Repeated rows stay.
    """
    names = sorted(prototypes)
    protos = _unit(np.array([prototypes[n] for n in names])) if names else np.zeros((0, DIM))
    df = spread(texts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            v, has = bundle(batch.column("text").to_pylist())
            if names:
                z = SHARPNESS * (_unit(v.astype(np.float64)) @ protos.T)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                lang = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
                score = np.where(has, p[np.arange(len(best)), best], 0.0)
            else:
                lang, score = ["und"] * len(has), np.zeros(len(has))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, type=pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
