"""Quality rules: word and line counts, then bands of compression ratios that depend on length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, Rolling, blocks, mix, spread, texts

#: Bytes from which a band holds, least and greatest ratio of plain to compressed size; texts outside are rejected. Prose compresses the better the
#: longer it is: the limits leave room beside what running text of several languages has at that length, while base64 (from 128 bytes), random
#: letters, salads of a few words (1 KB) and hexadecimal digits (4 KB) are beyond them. Shorter such texts compress as prose does.
BANDS = (
    (0, 0.4, 2.0), (64, 0.7, 2.2), (128, 1.05, 2.4), (256, 1.25, 2.4), (512, 1.38, 2.8), (1024, 1.64, 3.0),
    (2048, 1.8, 3.4), (4096, 2.0, 3.8), (8192, 2.1, 4.2), (16384, 2.15, 4.6),
)
#: Chunks of CHUNK bytes (the last one counts from CHUNK // 4 bytes) have the limits of their own length: rejected if over half of them are outside.
CHUNK = 4096
LEVEL = 3
_SPACES, _SYMBOLS = bytes([32, *range(9, 14)]), b"#*$%&|<>"
_ROLLING = Rolling()


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    bare = raw.translate(None, _SPACES)
    chars = len(text) - (len(raw) - len(bare))
    symbols = len(bare) - len(bare.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    repeated = 0
    if n > 5:
        values = mix(np.fromiter(map(hash, words), dtype=np.int64, count=n).view(U64))
        windows = _ROLLING.every(_ROLLING.prefix(values), 5)
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(len(windows), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, np.flatnonzero(twice), 1)
            np.add.at(cover, np.flatnonzero(twice) + 5, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, chars, symbols, dup, repeated


def within(size: int, ratio: float) -> bool:
    """Whether a text of ``size`` bytes may compress that well."""
    _, low, high = next(b for b in reversed(BANDS) if size >= b[0])
    return low <= ratio <= high


class Ratios:
    """Compression ratios of whole texts and of their chunks."""

    def __init__(self) -> None:
        import zstandard as zstd

        self._c = zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def of(self, raw: bytes) -> float:
        return len(raw) / len(self._c.compress(raw)) if raw else 0.0

    def verdict(self, raw: bytes) -> tuple[float, float, bool]:
        """Ratio of the whole, share of chunks outside their limits, and whether both are acceptable."""
        whole = self.of(raw)
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        parts = [p for p in parts if len(p) >= CHUNK // 4] if len(raw) > CHUNK else []
        odd = sum(not within(len(p), self.of(p)) for p in parts)
        share = odd / len(parts) if parts else 0.0
        return whole, share, within(len(raw), whole) and share <= 0.5


def rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict for every whole text; a null text counts as an empty one, repeated rows stay.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, odd_chunks, kept).
    Words are runs of bytes other than space and \\t to \\r. base_failed: under 10 words, or over a fifth of the words in
    five-word windows that are there twice. kept: not base_failed, and the compression bands hold. An empty table gives an empty one.
    """
    df = spread(texts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Ratios()
        for batch in blocks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                c = counts(text)
                failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
                whole, odd, fine = ratios.verdict((text or "").encode())
                rows.append((*c, failed, whole, odd, fine and not failed))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            cols = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "odd_chunks", "kept"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double, odd_chunks double, kept boolean")
