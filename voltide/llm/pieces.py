"""SentencePiece vocabularies: unigram encoding and decoding by batched Viterbi, and token counts over a trie.

The score of a segmentation is the sum of its pieces' stored scores; the best one wins, and of equal ones
the one whose last piece is longest (at each position). A character in no one-character piece costs the least
stored score less ten and is written as its UTF-8 byte pieces. One space is put before each non-empty text and
taken off again by decoding; texts are not normalised otherwise, so decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, Rolling, blocks, mix, ragged, spread, texts

#: The public tokenizer file that the registered queries use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words kept between the blocks of a task; at more, the table starts anew (only speed depends on it).
CACHE_WORDS = 400_000
#: Their characters, at more of which the table starts anew as well.
CACHE_CHARS = 8_000_000
#: Words of more characters are walked through one by one, in time linear in their length; the others advance together.
LONG = 96
_WALK = 1 << 16
#: Distinct words are worked on in groups of about this many characters.
GROUP_CHARS = 200_000
_UNKNOWN_COST = 10.0


class Pieces:
    """A vocabulary: for each string the id and score, found by hash in sorted keys."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], skip: set[int]):
        self.strings = [p.replace("▁", " ") for p in pieces]
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        usable = [i for i, p in enumerate(self.strings) if i not in skip and p]
        self.longest = max(len(self.strings[i]) for i in usable)
        self.many_spaces = any(len(self.strings[i]) > 1 and self.strings[i][:2] == "  " for i in usable)
        self.inner_space = any(" " in self.strings[i].lstrip(" ") for i in usable)
        if self.inner_space:
            raise ValueError("pieces with a space after another character are not supported")
        self.rolling = Rolling()
        codes, off = _codes([self.strings[i] for i in usable])
        prefix = self.rolling.prefix(mix(codes.astype(U64) + U64(1)))
        keys = mix(self.rolling.window(prefix, off[:-1], off[1:]))
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces are equal, or their hashes are")
        self.ids = np.array(usable, dtype=np.int32)[order]
        self.scores = np.array([scores[i] for i in usable], dtype=np.float64)[order]
        self.unknown = min(scores[i] for i in usable) - _UNKNOWN_COST
        #: For each value of a hash's highest 20 bits: the first key with at least these, so that few keys are looked at.
        self.bucket = np.searchsorted(self.keys >> U64(44), np.arange((1 << 20) + 1, dtype=U64)).astype(np.int32)
        self.deepest = int(np.diff(self.bucket).max())
        self.seen = np.diff(self.bucket) > 0
        #: UTF-8 of every id, as one buffer with offsets.
        raw = [s.encode() for s in self.strings]
        for value, i in enumerate(byte_ids):
            raw[i] = bytes([value])
        for i in skip - set(byte_ids):
            raw[i] = b""
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces' keys, and where those stand in ``keys``."""
        high = (hashes >> U64(44)).astype(np.int64)
        maybe = np.flatnonzero(self.seen[high])
        at, wanted = self.bucket[high[maybe]], hashes[maybe]
        hit = self.keys[at] == wanted
        for _ in range(1, self.deepest):
            at = np.where(hit, at, np.minimum(at + 1, len(self.keys) - 1))
            hit = self.keys[at] == wanted
        return maybe[hit], at[hit]

    def matches(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each length and end position in the words' characters: the best score of a piece there (or -inf), and its id."""
        n, longest = len(codes), self.longest
        score = np.full((longest + 1, n), -np.inf)
        ident = np.full((longest + 1, n), -1, dtype=np.int32)
        prefix = self.rolling.prefix(mix(codes.astype(U64) + U64(1)))
        inside = np.arange(n, dtype=np.int64) - np.repeat(off[:-1], np.diff(off)) + 1  # characters of the word up to here
        score[1], ident[1] = self.unknown, -2
        for length in range(1, longest + 1):
            h = mix(self.rolling.every(prefix, length))
            where, at = self.find(h)
            end = where + length - 1
            ok = inside[end] >= length
            score[length, end[ok]], ident[length, end[ok]] = self.scores[at[ok]], self.ids[at[ok]]
        return score, ident

    def encode_words(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the offsets of each word's."""
        words = len(off) - 1
        by_length = np.argsort(np.diff(off), kind="stable")  # so that a group has few lengths
        codes, off = _taken(codes, off, by_length)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, order in the word, id
        short = int(np.searchsorted(np.diff(off), LONG, side="right"))
        for word in range(short, words):
            c = codes[off[word] : off[word + 1]]
            ids, ends = self.walk(c)
            parts.append((np.full(len(ids), word), np.arange(len(ids)), np.where(ids == -2, -2 - c[ends - 1].astype(np.int64), ids)))
        for lo, hi in _groups(off[: short + 1]):
            c, o = codes[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if not len(c):
                continue
            score, ident = self.matches(c, o)
            lens = np.diff(o)
            for n in np.unique(lens[lens > 0]):
                rows = np.flatnonzero(lens == n)
                back = self._forward(score, o[rows], int(n))
                pos, step = np.full(len(rows), n), 0
                while (live := np.flatnonzero(pos > 0)).size:
                    took = back[live, pos[live]]
                    end = o[rows[live]] + pos[live] - 1
                    ids = ident[took, end]
                    ids = np.where(ids == -2, -2 - c[end].astype(np.int64), ids)
                    parts.append((rows[live] + lo, np.full(len(live), -step), ids))
                    pos[live] -= took
                    step += 1
        if not parts:
            return np.empty(0, dtype=np.int32), np.zeros(words + 1, dtype=np.int64)
        word, order, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        word = by_length[word]
        sort = np.lexsort((order, word))
        word, ids = word[sort], ids[sort].astype(np.int64)
        odd = np.flatnonzero(ids < -1)
        if odd.size:  # characters without a piece become bytes
            chars = -2 - ids[odd]
            uniq, inv = np.unique(chars, return_inverse=True)
            raw = [chr(x).encode("utf-8", "surrogatepass") for x in uniq]
            reps = np.ones(len(ids), dtype=np.int64)
            reps[odd] = np.array([len(r) for r in raw])[inv]
            first = np.cumsum(reps) - reps
            word, ids = np.repeat(word, reps), np.repeat(ids, reps)
            size = reps[odd]
            flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]]).astype(np.int64)
            ids[ragged(first[odd], size)] = self.byte_ids[flat[ragged(starts[inv], size)]]
        out_len = np.bincount(word, minlength=words)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(out_len)])

    def _forward(self, score: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """Backpointers (length of the last piece) of equal-length words that advance together."""
        best = np.full((n + 1, len(start)), -np.inf)
        best[0] = 0.0
        back = np.zeros((len(start), n + 1), dtype=np.int16)
        for e in range(1, n + 1):
            top = min(self.longest, e)
            lengths = np.arange(top, 0, -1)
            cand = best[e - lengths] + score[lengths[:, None], (start + e - 1)[None, :]]
            pick = np.argmax(cand, axis=0)  # the first of equal ones: the longest piece
            best[e] = cand[pick, np.arange(len(start))]
            back[:, e] = lengths[pick]
        return back

    def walk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one long word (-2: a character without a piece), and where each ends: the same segmentation, over the pieces that occur."""
        n = len(codes)
        prefix = self.rolling.prefix(mix(codes.astype(U64) + U64(1)))
        best, back, ident = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for lo in range(0, n, _WALK):
            hi = min(lo + _WALK, n)
            found: list[tuple[np.ndarray, ...]] = []
            for length in range(1, min(self.longest, hi) + 1):
                start = np.arange(max(lo + 1 - length, 0), hi - length + 1)
                where, at = self.find(mix(self.rolling.window(prefix, start, start + length)))
                found.append((start[where] + length, np.full(len(at), length), self.scores[at], self.ids[at]))
            end, size, score, piece = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((-size, end))  # the longest piece first, which wins among equal scores
            edge = np.searchsorted(end[order], np.arange(lo + 1, hi + 2)).tolist()
            sizes, scores, ids = size[order].tolist(), score[order].tolist(), piece[order].tolist()
            for e in range(lo + 1, hi + 1):
                top, took, name, single = -np.inf, 1, -2, False
                for k in range(edge[e - lo - 1], edge[e - lo]):
                    value = best[e - sizes[k]] + scores[k]
                    if value > top:
                        top, took, name = value, sizes[k], ids[k]
                    single = sizes[k] == 1
                if not single and best[e - 1] + self.unknown > top:
                    top, took, name = best[e - 1] + self.unknown, 1, -2
                best[e], back[e], ident[e] = top, took, name
        ends, at = [], n
        while at:
            ends.append(at)
            at -= back[at]
        ends.reverse()
        return np.array([ident[e] for e in ends], dtype=np.int64), np.array(ends, dtype=np.int64)

    def count_words(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of ids of each word: the words go into a trie, whose every node gets one forward score.

        A node is a distinct prefix, found by its hash, level by level; words that share it share its score. Words of more than LONG
        characters are walked through alone.
        """
        lens = np.diff(off)
        long = np.flatnonzero(lens > LONG)
        if not len(long):
            return self._count_in_trie(codes, off)
        out = np.zeros(len(lens), dtype=np.int64)
        short = np.flatnonzero(lens <= LONG)
        out[short] = self._count_in_trie(*_taken(codes, off, short))
        for w in long.tolist():
            c = codes[off[w] : off[w + 1]]
            ids, ends = self.walk(c)
            out[w] = len(ids) + int((_utf8_size(c[ends[ids == -2] - 1]) - 1).sum())
        return out

    def _count_in_trie(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        words, lens = len(off) - 1, np.diff(off)
        deepest = int(lens.max(initial=0))
        prefix = self.rolling.prefix(mix(codes.astype(U64) + U64(1)))
        utf8 = _utf8_size(codes)
        by_length = np.argsort(lens, kind="stable")
        first = np.searchsorted(lens[by_length], np.arange(deepest + 2))
        terminal = np.zeros(words, dtype=np.int64)
        # Of the last levels: each word's node, and the nodes' scores and counts.
        node: dict[int, np.ndarray] = {0: np.zeros(words, dtype=np.int32)}
        best: dict[int, np.ndarray] = {0: np.zeros(1)}
        count: dict[int, np.ndarray] = {0: np.zeros(1, dtype=np.int64)}
        for d in range(1, deepest + 1):
            live = by_length[first[d] :]
            _, owner, inverse = np.unique(self.rolling.window(prefix, off[live], off[live] + d), return_index=True, return_inverse=True)
            w = live[owner]
            end = off[w] + d
            value, tokens = np.full(len(w), -np.inf), np.zeros(len(w), dtype=np.int64)
            for length in range(min(self.longest, d), 0, -1):
                up = node[d - length][w]
                hit, at = self.find(mix(self.rolling.window(prefix, end - length, end)))
                cand, add = np.full(len(w), -np.inf), np.ones(len(w), dtype=np.int64)
                cand[hit] = best[d - length][up[hit]] + self.scores[at]
                if length == 1:
                    odd = np.isneginf(cand)
                    cand[odd] = best[d - 1][up[odd]] + self.unknown
                    add[odd] = utf8[end[odd] - 1]
                better = cand > value
                value[better], tokens[better] = cand[better], (count[d - length][up] + add)[better]
            node[d] = np.zeros(words, dtype=np.int32)
            node[d][live] = inverse
            best[d], count[d] = value, tokens
            done = by_length[first[d] : first[d + 1]]
            terminal[done] = tokens[node[d][done]]
            if d >= self.longest:
                for level in (node, best, count):
                    del level[d - self.longest]
        return terminal


def _utf8_size(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))]).astype(np.int64)


def _taken(codes: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters and offsets of some of the words, in the order asked for."""
    lens = (off[1:] - off[:-1])[which]
    return codes[ragged(off[:-1][which], lens)], np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def _groups(off: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + GROUP_CHARS, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


@lru_cache(maxsize=2)
def load(model: bytes) -> Pieces:
    """The vocabulary of a SentencePiece model, given as the file's bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(map(sp.is_byte, byte_ids)):
        raise ValueError("the model has no byte pieces")
    skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
    return Pieces([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], byte_ids, skip)


class Words:
    """Cuts texts into chunks that no piece crosses, and keeps what was found for each distinct one.

    A chunk starts at a text's start, at a space (at the first of several, if pieces have several) and on both
    sides of a line feed, which is in no piece. Chunks are found by their hashes; each one's characters are then compared with those of
    the chunk that was found, so that a collision costs time only.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
        self.done = 0
        #: Characters of all chunks by number, and those whose hash another chunk has.
        self.chars, self.off = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.odd: dict[bytes, int] = {}

    def number(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray, bool, np.ndarray, np.ndarray]:
        """Chunk numbers of all texts, how many each has, whether numbering began anew, and the new chunks' characters and offsets."""
        given = [" " + t if t else "" for t in batch]
        codes, ends = _codes(given)
        anew = len(self.keys) > CACHE_WORDS or len(self.chars) > CACHE_CHARS
        if anew:
            self._clear()
        space, line = codes == 32, codes == 10
        begin = space | line
        begin[1:] |= line[:-1]
        if self.pieces.many_spaces:
            begin[1:] &= ~(space[1:] & space[:-1])
        begin[ends[:-1][np.diff(ends) > 0]] = True
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(codes)) if len(start) else start
        lens = np.diff(np.searchsorted(start, ends))
        hashes = self.hashes(codes, start, stop)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        number = np.empty(len(uniq), dtype=np.int64)
        number[known] = self.rows[at[known]]
        fresh = np.flatnonzero(~known)
        number[fresh] = self.done + np.arange(len(fresh))
        self.keys, self.rows = np.insert(self.keys, at[fresh], uniq[fresh]), np.insert(self.rows, at[fresh], number[fresh])
        size, before = stop - start, self.done
        self._add(codes[ragged(start[first[fresh]], size[first[fresh]])], size[first[fresh]])
        flat = number[inverse]
        for k in self._unequal(codes, start, size, flat).tolist():
            raw = codes[start[k] : stop[k]].tobytes()
            if raw not in self.odd:
                self.odd[raw] = self.done
                self._add(codes[start[k] : stop[k]], size[k : k + 1])
            flat[k] = self.odd[raw]
        return flat, lens, anew, self.chars[self.off[before] :], self.off[before:] - self.off[before]

    def hashes(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        rolling = self.pieces.rolling
        return mix(rolling.window(rolling.prefix(mix(codes.astype(U64) + U64(1))), start, stop))

    def _add(self, chars: np.ndarray, size: np.ndarray) -> None:
        self.chars = np.concatenate([self.chars, chars])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(size)])
        self.done += len(size)

    def _unequal(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Which chunks, which follow each other in ``codes``, differ from those of their numbers."""
        if not len(flat):
            return flat
        bad = self.off[flat + 1] - self.off[flat] != size
        if bad.any():
            return np.flatnonzero(bad | self._differs(codes, start, np.where(bad, 0, size), flat))
        differs = np.flatnonzero(self.chars[ragged(self.off[flat], size)] != codes)
        return np.unique(np.searchsorted(start, differs, side="right") - 1)

    def _differs(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(flat)), size)
        return np.bincount(of, weights=self.chars[ragged(self.off[flat], size)] != codes[ragged(start, size)], minlength=len(flat)) > 0


def _encoded(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks with the ids of their texts, and each text's number of ids."""
    words = Words(pieces)
    ids, off = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    for block in blocks(batches):
        flat, lens, anew, *new = words.number(block.column("text").to_pylist())
        if anew:
            ids, off = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        more, ends = pieces.encode_words(*new)
        ids, off = np.concatenate([ids, more]), np.concatenate([off, off[-1] + ends[1:]])
        size = (off[1:] - off[:-1])[flat]
        total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lens)])]
        yield block, ids[ragged(off[flat], size)], np.diff(total)


def _ids_array(column: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids.astype(np.int32)))
    if column.null_count:
        out = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32(), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False)), pa.array(ids.astype(np.int32)))
    return out


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text. A null text gives null, an empty one no ids; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, counts in _encoded(load(model), batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), _ids_array(block.column("text"), ids, counts)], names=["doc_id", "ids"])

    df = spread(texts(docs, id_col, text_col))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_block(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 of each run of ids, without the space that encoding puts first."""
    size = (pieces.raw_off[1:] - pieces.raw_off[:-1])[ids]
    raw = pieces.raw[ragged(pieces.raw_off[ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            col = batch.column("ids")
            counts = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            out = decode_block(pieces, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            text = [r.decode("utf-8", "replace") if ok else None for r, ok in zip(out, col.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, type=pa.string())], names=["doc_id", "text"])

    from pyspark.sql import functions as F

    df = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, decoded_equal): encodes, decodes in the same task, and says whether the text came back.

    A null text gives null in all but doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for block, ids, counts in _encoded(pieces, batches):
            column = block.column("text")
            back = decode_block(pieces, ids, counts)
            same = [None if t is None else t.encode() == b for t, b in zip(column.to_pylist(), back, strict=True)]
            null = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), _ids_array(column, ids, counts), pa.array(counts, mask=null), pa.array(same, type=pa.bool_())],
                names=["doc_id", "ids", "n_ids", "decoded_equal"],
            )

    df = spread(texts(docs, id_col, text_col))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids bigint, decoded_equal boolean")


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens): size of every whole text in ids, from a trie of the distinct pre-tokens.

    A null text gives null counts, an empty one 0; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        words, size = Words(pieces), np.empty(0, dtype=np.int64)
        for block in blocks(batches):
            column = block.column("text")
            flat, lens, anew, *new = words.number(column.to_pylist())
            size = np.concatenate([size[:0] if anew else size, pieces.count_words(*new)])
            of = np.repeat(np.arange(len(lens)), lens)
            null = column.is_null().to_numpy(zero_copy_only=False)
            sums = np.bincount(of, weights=size[flat], minlength=len(lens)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(sums, mask=null), pa.array(lens, mask=null)], names=["doc_id", "n_tokens", "n_pretokens"])

    df = spread(texts(docs, id_col, text_col))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_pretokens bigint")
