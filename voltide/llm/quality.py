"""Quality classifier by compression: dictionaries built from good and bad labelled text.

A text is cut into 1 KB chunks and each chunk is compressed with both dictionaries. The difference of the two
sizes over their sum, for the whole text and for its most suspicious chunk, the share of bytes left and
the length go into a logistic calibration, which gives the score.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, spread, texts

CHUNK = 1024
LEVEL = 3
DICT_BYTES = 32 << 10
#: Chunks of one text that may go into a dictionary, spread over the whole text.
CHUNKS_PER_TEXT = 6
FEATURES = 6


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def to_json(self) -> str:
        return json.dumps({k: v.hex() if isinstance(v, bytes) else v for k, v in self.__dict__.items()})

    @staticmethod
    def from_json(s: str) -> Model:
        d = json.loads(s)
        return Model(bytes.fromhex(d["good"]), bytes.fromhex(d["bad"]), *(tuple(d[k]) for k in ("mean", "scale", "weights")), d["prior"])


def _chunks(raw: bytes) -> list[bytes]:
    return [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] or [b""]


class Sizes:
    """Features of a text from its compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        def compressor(raw: bytes) -> zstd.ZstdCompressor:
            kind = {} if raw[:4] == b"\x37\xa4\x30\xec" else {"dict_type": zstd.DICT_TYPE_RAWCONTENT}
            given = {"dict_data": zstd.ZstdCompressionDict(raw, **kind)} if raw else {}
            return zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **given)

        self.good, self.bad = compressor(good), compressor(bad)

    def of(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        cut = _chunks(raw)
        good = np.array([len(self.good.compress(x)) for x in cut])
        bad = np.array([len(self.bad.compress(x)) for x in cut])
        both = good + bad
        left = both.sum() / (2.0 * (len(raw) + 1))
        return [1.0, (bad.sum() - good.sum()) / both.sum(), ((bad - good) / both).min(), left, left * left, 1.0 / (1.0 + len(raw) / 100.0)]


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard as zstd

    if not samples:
        return b""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-DICT_BYTES:]


def _samples(rows: list[str | None]) -> list[bytes]:
    """At most CHUNKS_PER_TEXT chunks of each text, spread evenly over its bytes, without lines seen before, so that lines common to many
    texts don't fill a dictionary."""
    seen: set[str] = set()
    out: list[bytes] = []
    for text in rows:
        fresh = [line for line in (text or "").split("\n") if not (line in seen or seen.add(line))]
        cut = _chunks("\n".join(fresh).encode())
        taken = np.unique(np.linspace(0, len(cut) - 1, min(len(cut), CHUNKS_PER_TEXT)).round().astype(int))
        out += [cut[i] for i in taken if cut[i]]
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-3 * len(y) / 100 + 1e-3)
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def features(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(doc_id, f): compressed-size features of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            f = [sizes.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f, type=pa.list_(pa.float64()))], names=["doc_id", "f"])

    df = texts(docs)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, f array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_per_label: int = 4000, held_out_mod: int = 5) -> Model:
    """Learns from a bounded sample of labelled rows: about ``max_per_label`` documents of each label at most.

    Rows whose crc32(doc_id as text) modulo ``held_out_mod`` is 0 are never learnt from. A third of the sample builds the
    dictionaries (only their chunks, 6 KB a text at most, reach the driver), the rest calibrates (only six numbers a text
    reach the driver). Without labels of both kinds the score is the share of good labels (0.5 without any). A document that is labelled
    both good and bad counts as good; one labelled several times counts once. Labels without a doc_id, other labels than 0 and 1, and those of
    documents that are not there teach nothing. Where documents repeat a doc_id, its label holds for each of their texts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % held_out_mod != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = counts.get(0, 0), counts.get(1, 0)
    prior = (n_good + 1.0) / (n_good + n_bad + 2.0)
    if not n_good or not n_bad:
        return Model(b"", b"", (), (), (), prior)
    uniform = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("quality") == 1, min(1.0, max_per_label / n_good)).otherwise(min(1.0, max_per_label / n_bad))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(3))
    sample = known.where(uniform < share).withColumn("fold", fold)
    # About 2 * max_per_label ids: so few that they are sent to the texts, which then need no shuffle.
    taken = F.broadcast(docs.sparkSession.createDataFrame(sample.collect(), sample.schema))
    rows = texts(docs).join(taken, "doc_id")
    lines = {1: [], 0: []}
    for r in rows.where("fold = 0").select("doc_id", "quality", _spread_chunks(F.col("text")).alias("text")).orderBy("doc_id").toLocalIterator():
        lines[r["quality"]].append(r["text"])
    good, bad = _dictionary(_samples(lines[1])), _dictionary(_samples(lines[0]))
    found = features(rows.where("fold <> 0"), good, bad).join(taken.select("doc_id", "quality"), "doc_id").orderBy("doc_id").collect()
    if len({r["quality"] for r in found}) < 2:
        return Model(b"", b"", (), (), (), prior)
    x, y = np.array([r["f"] for r in found]), np.array([float(r["quality"]) for r in found])
    mean, scale, w = _logistic(x, y)
    # The sample holds about as many of each label; the calibration is set back to their shares among all labels.
    w[0] += np.log(n_good / n_bad) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), prior)


def _spread_chunks(text):
    """At most CHUNKS_PER_TEXT pieces of CHUNK characters spread evenly over the text, all of it where it is shorter."""
    room = CHUNK * CHUNKS_PER_TEXT
    at = F.transform(F.sequence(F.lit(0), F.lit(CHUNKS_PER_TEXT - 1)), lambda i: F.substring(text, (i * (F.length(text) - CHUNK) / (CHUNKS_PER_TEXT - 1)).cast("int") + 1, F.lit(CHUNK)))
    return F.when(F.length(text) <= room, text).otherwise(F.array_join(at, "\n"))


def _scores(model: Model, sizes: Sizes, column: list[str | None]) -> np.ndarray:
    if not model.weights or not column:
        return np.full(len(column), model.prior)
    z = (np.array([sizes.of(t) for t in column]) - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; a null text counts as an empty one, repeated rows stay.

    score is the chance of a good label, predicted 1 where it is ``threshold`` or more. An empty table gives an empty one.
    """
    df = spread(texts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in blocks(batches):
            s = _scores(model, sizes, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        at = docs_columns.index("text")
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, sizes, batch.column(at).to_pylist()) >= threshold))

    docs_columns = docs.columns
    return spread(docs).mapInArrow(run, docs.schema)
