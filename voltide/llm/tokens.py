"""Word tokens of whole texts as 64-bit hashes: runs of letters and digits, in lower case."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import U64, Rolling, mix, ragged

ROLLING = Rolling()


@lru_cache(maxsize=1)
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x10000)), dtype=bool, count=0x10000)


def tokenise(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words one after another, and the offsets of each text's (null: none)."""
    lowered = [(t or "").lower() for t in batch]
    cps = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _word_chars()[np.minimum(cps, 0xFFFF)]
    beyond = np.flatnonzero(cps >= 0x10000)
    inside[beyond] = [chr(c).isalnum() for c in cps[beyond].tolist()]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    hashes = mix(ROLLING.window(ROLLING.prefix(mix(cps.astype(U64) + U64(1))), start, stop))
    ends = np.cumsum(np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1)
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)


def runs(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``length`` words from ``start`` on."""
    return mix(ROLLING.window(ROLLING.prefix(hashes), start, start + length))


def shingles(hashes: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, and their offsets; a shorter text with a word gives one, of all its words."""
    n = np.diff(off)
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    start = ragged(off[:-1], size)
    span = np.repeat(np.minimum(n, width), size)
    return runs(hashes, start, span), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
