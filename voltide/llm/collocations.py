"""Collocations by dynamic itemset counting over word phrases.

The documents are dealt over shards, which are scanned in turn, again and again. The first cycle counts words. As soon as the two shorter phrases that a
longer one consists of (all words but its last, all but its first) have both reached the threshold, the longer one is active: the following scans
count it, whatever the lengths counted beside it, until it has been counted in one full cycle. So lengths interleave, and what never becomes active is
never counted. Whatever reaches the threshold has been active for a full cycle in the end, so its count is exact.

Before the first cycle all words and pairs of words are counted by buckets of their hashes (Park, Chen and Yu). A bucket under the threshold holds nothing
that reaches it, so of words and pairs only those of the other buckets are ever active; they are counted by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import U64, blocks, drop_table, mix, spread, write_table

LONGEST = 4
THRESHOLD, TOP = 30, 2000
SHARDS = 2
#: Bits of the filters that say in a task which phrases have reached the threshold. With more phrases than these have room for, more of what is counted
#: turns out to be rare; counts stay exact.
FILTER_BITS = 1 << 26
#: Bytes of text whose phrases are counted together in a task; the counts of its groups are then added up.
GROUP_BYTES = 4 << 20
#: Rows and bytes of counts that a task holds before they are given back.
HELD_ROWS, HELD_BYTES = 1 << 19, 48 << 20
#: Powers of two: a bucket for every eight bytes of text, within these. With more text than the most have room for, more of what is counted turns out to
#: be rare; counts stay exact.
LEAST_BUCKETS, MOST_BUCKETS = 16, 27
#: Buckets that are one row on their way to the driver.
SLOT = 1 << 16
#: Rows of a batch that a task gives back.
OUT_ROWS = 1 << 16
_MANY, _ODD = U64(0x9E3779B97F4A7C15), U64(1)
#: A to Z become a to z; .,;:!? and \n to \r end a piece, space and tab a word.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Filter:
    """Phrases as bits, by their words' hashes."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.zeros(bits // 64, dtype=U64)

    @staticmethod
    def place(h: np.ndarray, bits: int, k: int) -> np.ndarray:
        """The k-th of the four bits that stand for a hash."""
        return (h + U64(k) * ((h >> U64(32)) | _ODD)) & U64(bits - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        left, out = np.arange(len(h)), np.zeros(len(h), dtype=bool)
        for k in range(4):  # after the first place, only what may still be there
            at = self.place(h if k == 0 else h[left], self.bits, k)
            left = left[(self.slots[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & _ODD).astype(bool)]
        out[left] = True
        return out

    def add(self, slots: np.ndarray, bits: np.ndarray) -> None:
        self.slots[slots] |= bits


def word_hashes(words: list[bytes], lang: np.ndarray, langs: list[bytes]) -> np.ndarray:
    """Hashes of words, each of the language numbered beside it."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, langs), dtype=U64, count=len(langs))
    return mix(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U64, count=len(words)) ^ mix(own)[lang])


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that have one more word."""
    return mix(h * _MANY + word)


def _key(lang: bytes, phrase: bytes) -> bytes:
    return lang + b"\n" + phrase  # no phrase holds a line end


class Buckets:
    """One bit for each bucket of hashes: whether what it holds is there often enough, all together."""

    def __init__(self, power: int, bits: np.ndarray) -> None:
        self.power, self.bits = power, bits

    @staticmethod
    def place(h: np.ndarray, power: int) -> np.ndarray:
        return (h >> U64(64 - power)).astype(np.int64)

    def may(self, h: np.ndarray) -> np.ndarray:
        at = self.place(h, self.power)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class Group:
    """The words of some texts, numbered, and the phrases among them that are to be counted."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.lang: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def add(self, lang: bytes, text: bytes) -> None:
        self.lang.append(self.number.setdefault(lang, len(self.number)))
        self.texts.append(text.translate(_TABLE))
        self.bytes += len(text)

    def close(self) -> int:
        """Splits and numbers the words; gives how many there are."""
        text = b"\n".join([b"", *self.texts, b""])
        raw = np.frombuffer(text, dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts)) + 1)
        line = raw == 10
        inside = ~(line | (raw == 32))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        n = len(start)
        # each word's line, and its text's language
        self.piece = np.cumsum(line, dtype=np.int32)[start]
        lang = np.repeat(np.array(self.lang, dtype=np.int64), np.diff(np.searchsorted(start, ends), prepend=0))
        # the words' bytes one after another: Arrow finds the distinct ones
        off = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size)])
        body = pa.py_buffer(text.translate(None, b" \n"))
        self.texts = []
        encoded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), body]).dictionary_encode()
        words, ids = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        self.langs = list(self.number)
        if len(self.langs) > 1:
            found, ids = _numbered(lang * max(len(words), 1) + ids)
            self.word_lang, words = found // max(len(words), 1), words.take(pa.array(found % max(len(words), 1)))
        else:
            self.word_lang = np.zeros(len(words), dtype=np.int64)
        self.ids, self.words = ids, words.cast(pa.binary())
        self.hash = word_hashes(_listed(self.words), self.word_lang, self.langs)
        return n

    def pairs(self) -> np.ndarray:
        """Hashes of all runs of two words."""
        at = np.flatnonzero(self.piece[1:] == self.piece[:-1])
        return longer(self.hash[self.ids[at]], self.hash[self.ids[at + 1]])

    def rows(self, words_too: bool, often: Buckets, every: Filter | None, recent: Filter | None) -> Iterator[pa.RecordBatch]:
        """(key, v, meta): counts, meta is minus the number of words; 0 words stands for the number of all of a language's."""
        n = self.close()
        if not n:
            return
        ids, piece, lang, langs, texts, h1 = self.ids, self.piece, self.word_lang, self.langs, self.words, self.hash
        keyed = pc.binary_join_element_wise(pa.array(langs, pa.binary()).take(pa.array(lang)), texts, b"\n")

        def out(first: np.ndarray, more: list[np.ndarray], times: np.ndarray) -> pa.RecordBatch:
            parts = [keyed.take(pa.array(first)), *(texts.take(pa.array(m)) for m in more)]
            key = pc.binary_join_element_wise(*parts, b" ") if more else parts[0]
            meta = pa.array(np.full(len(first), -1 - len(more), dtype=np.int64))
            return pa.RecordBatch.from_arrays([key, pa.array(times.astype(np.int64)), meta], names=["key", "v", "meta"])

        if words_too:
            times = np.bincount(ids, minlength=len(texts))
            may = np.flatnonzero(often.may(h1))
            yield out(may, [], times[may])
            whole = np.bincount(lang, weights=times, minlength=len(langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_key(x, b"") for x in langs], pa.binary()), pa.array(whole), pa.array(np.zeros(len(langs), dtype=np.int64))], names=["key", "v", "meta"])
        if every is None:
            return
        known, new = every.holds(h1), recent.holds(h1)
        # phrases of k words at their first word: their hashes, whether they have reached the threshold, and lately
        here, h = np.arange(n), h1[ids]
        reached, lately = known[ids], new[ids]
        for k in range(2, LONGEST + 1):
            ok, fresh = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
            ok[here[reached]], fresh[here[lately]] = True, True
            keep = reached & ok[here + 1] & (here + k - 1 < n)
            keep &= piece[here] == piece[np.minimum(here + k - 1, n - 1)]
            here, h = here[keep], longer(h[keep], h1[ids[here[keep] + k - 1]])
            if k == 2:
                keep = often.may(h)
                here, h = here[keep], h[keep]
            if not len(here):
                return
            at = here[fresh[here] | fresh[here + 1]]
            if len(at):
                yield out(*_counted(ids, at, k, len(texts)))
            if k < LONGEST:
                reached = every.holds(h)
                lately = np.zeros(len(h), dtype=bool)
                lately[reached] = recent.holds(h[reached])


def _counted(ids: np.ndarray, at: np.ndarray, k: int, n_words: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct runs of k words that begin at ``at``: their first words, their further words, and how often each is there."""
    code, parts = ids[at], []
    for j in range(1, k):
        found, code = _numbered(code * n_words + ids[at + j])
        parts = [p[found // n_words] for p in parts or [np.arange(n_words)]] + [found % n_words]
    return parts[0], parts[1:], np.bincount(code)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and each one's place among them, by Arrow's hash table instead of numpy's sort."""
    got = pa.array(values).dictionary_encode()
    return got.dictionary.to_numpy(), got.indices.to_numpy().astype(np.int64)


def _listed(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls, far sooner than by to_pylist."""
    if not len(column):
        return []
    _, off, body = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].tolist()
    raw = body.to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Group]:
    group = Group()
    for batch in blocks(batches):
        for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            group.add(lang, text or b"")
        if group.bytes >= limit:
            yield group
            group = Group()
    yield group


def _added(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Counts of several groups as one row for each key."""
    sums = pa.Table.from_batches(held).group_by(["key", "meta"], use_threads=False).aggregate([("v", "sum")])
    return sums.rename_columns({"v_sum": "v"}).select(["key", "v", "meta"]).combine_chunks().to_batches()[0]


def scanned(shard: DataFrame, words_too: bool, often, every, recent, group_bytes: int | None = None) -> DataFrame:
    """Counts of what is active in one shard, a row for each phrase and task; a task that holds too many gives them back on the way."""
    limit = group_bytes or GROUP_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = (often.value, *((every.value, recent.value) if every is not None else (None, None)))
        held: list[pa.RecordBatch] = []
        size = (0, 0)

        def given() -> Iterator[pa.RecordBatch]:
            yield from (rows.slice(at, OUT_ROWS) for rows in held for at in range(0, rows.num_rows, OUT_ROWS))

        for group in _groups(batches, limit):
            more = list(group.rows(words_too, *filters))
            held += more
            size = (size[0] + sum(x.num_rows for x in more), size[1] + sum(x.nbytes for x in more))
            if size[0] > HELD_ROWS or size[1] > HELD_BYTES:
                held = [_added(held)]
                size = (held[0].num_rows, held[0].nbytes)
                if size[0] > HELD_ROWS // 2 or size[1] > HELD_BYTES // 2:
                    yield from given()
                    held, size = [], (0, 0)
        if held:
            held = [_added(held)]
            yield from given()

    return shard.select("lang", "text").mapInArrow(run, "key binary, v bigint, meta bigint")


def bucket_bits(docs: DataFrame, threshold: int, power: int, group_bytes: int | None = None) -> Buckets:
    """The buckets of words and of pairs of words that hold ``threshold`` occurrences or more.

    A task counts up to the threshold (255 at most) in a byte for each bucket; buckets travel as rows of SLOT, those with few counts as places and counts.
    """
    limit, most = group_bytes or GROUP_BYTES, min(threshold, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << power, dtype=np.uint8)
        for group in _groups(batches, limit):
            if not group.close():
                continue
            at = np.sort(Buckets.place(np.concatenate([group.hash[group.ids], group.pairs()]), power))
            first = np.flatnonzero(np.diff(at, prepend=-1))
            times = np.diff(first, append=len(at))
            counts[at[first]] = np.minimum(counts[at[first]] + times, most)
        for slot in range(0, len(counts), SLOT):
            some = counts[slot : slot + SLOT]
            on = np.flatnonzero(some)
            if len(on):
                raw = some.tobytes() if len(on) * 3 >= len(some) else on.astype(np.uint16).tobytes() + some[on].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([slot // SLOT], pa.int32()), pa.array([raw], pa.binary())], names=["slot", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, sums = -1, np.zeros(SLOT, dtype=np.uint8)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.packbits(sums >= most).tobytes()], pa.binary())], names=["slot", "bits"])

        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != slot:
                    if slot >= 0:
                        yield bits()
                    slot, sums = at, np.zeros(SLOT, dtype=np.uint8)
                got = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                if len(got) == SLOT:
                    sums = np.minimum(sums, most - np.minimum(got, most)) + got
                else:
                    n = len(got) // 3
                    on, got = got[: 2 * n].view(np.uint16), got[2 * n :]
                    sums[on] = np.minimum(sums[on], most - got) + got
        if slot >= 0:
            yield bits()

    rows = docs.select("lang", "text").mapInArrow(run, "slot int, counts binary")
    got = rows.repartition("slot").sortWithinPartitions("slot").mapInArrow(summed, "slot int, bits binary").toArrow()
    out = np.zeros((1 << power) // 8, dtype=np.uint8)
    for slot, raw in zip(got.column("slot").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[slot * SLOT // 8 : (slot + 1) * SLOT // 8] = np.frombuffer(raw, dtype=np.uint8)
    return Buckets(power, out)


def filter_bits(keys: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a filter and their bits for the phrases of ``keys``; as many rows as the filter has slots at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.rpartition(b"\n") for x in _listed(batch.column(0))]
            if not raw:
                continue
            langs = list(dict.fromkeys(x[0] for x in raw))
            number = {x: k for k, x in enumerate(langs)}
            lang = np.array([number[x[0]] for x in raw], dtype=np.int64)
            split = [x[2].split(b" ") for x in raw]
            size = np.array([len(x) for x in split])
            h = word_hashes([x[0] for x in split], lang, langs)
            for k in range(1, int(size.max())):
                at = np.flatnonzero(size > k)
                h[at] = longer(h[at], word_hashes([split[i][k] for i in at], lang[at], langs))
            places = np.concatenate([Filter.place(h, bits, k) for k in range(4)])
            slots, inverse = np.unique((places >> U64(6)).astype(np.int64), return_inverse=True)
            held = np.zeros(len(slots), dtype=U64)
            np.bitwise_or.at(held, inverse, _ODD << (places & U64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(held.view(np.int64))], names=["slot", "bits"])

    got = keys.select("key").mapInArrow(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    return got.column("slot").to_numpy(), got.column("bits").to_numpy().view(U64)


def frequencies(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, bits: int = FILTER_BITS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) for every phrase of up to four words that is there ``threshold`` times, and (lang, n): all words of a language.

    A row of the table of counts: key (language and phrase), v (occurrences so far) and meta: 4096 * (8 * the shards' bits + words) + the scan from which
    on the phrase counts as having reached the threshold (0: not yet). A phrase counted twice in one shard, as a filter may let it pass without need,
    is added once. Rows that have had their full cycle and are rare go.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = spread(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")))
    size = Observation()
    rows = rows.where("text is not null").observe(size, F.sum(F.octet_length("text")).alias("bytes"))
    dealt = write_table(rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), "shard")
    source = spark.read.schema("lang string, text string, shard int").parquet(dealt)
    power = min(max(((size.get["bytes"] or 0) // 8).bit_length() - 1, LEAST_BUCKETS), MOST_BUCKETS)
    often = sc.broadcast(bucket_bits(source, threshold, power))
    table, born, turn = None, {}, 0
    while turn < shards or any(b > turn - shards for b in born):
        shard, shared = turn % shards, []
        for least in (0, turn - shards + 1) if born else ():
            f = Filter(bits)
            for b, (slots, held) in born.items():
                if b >= least:
                    f.add(slots, held)
            shared.append(sc.broadcast(f))
        fresh = scanned(source.where(F.col("shard") == shard), turn < shards, often, *(shared or (None, None)))
        both = fresh if table is None else fresh.unionByName(spark.read.schema(fresh.schema).parquet(table))
        new, bit = F.col("meta") <= 0, 1 << shard
        sums = both.groupBy("key").agg(F.sum(F.when(new, F.col("v")).otherwise(0)).alias("fresh"), F.sum(F.when(new, 0).otherwise(F.col("v"))).alias("old"), F.max("meta").alias("meta"))
        at = F.when(F.col("meta") > 0, F.col("meta")).otherwise(-F.col("meta") * 4096)
        sums = sums.select("key", "fresh", "old", F.shiftright(at, 15).alias("mask"), F.shiftright(at, 12).bitwiseAND(F.lit(7)).alias("k"), at.bitwiseAND(F.lit(4095)).alias("born"))
        seen = F.col("mask").bitwiseAND(F.lit(bit)) != 0
        sums = sums.withColumns({"v": F.col("old") + F.when(seen, 0).otherwise(F.col("fresh")), "mask": F.when(F.col("fresh") > 0, F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))})
        sums = sums.withColumn("born", F.when((F.col("born") == 0) & (F.col("v") >= threshold) & (F.col("k") > 0), F.lit(turn + 1)).otherwise(F.col("born")))
        live = sums.where((F.col("born") > 0) | (F.col("k") == 0) | (F.col("k") * shards - 1 > turn))
        # the whole table of a language's words (k = 0) needs a bit, else meta would be 0
        after = write_table(live.select("key", "v", ((F.col("mask") * 8 + F.col("k")) * 4096 + F.col("born")).alias("meta")))
        for x in shared:
            x.destroy()
        if table is not None:
            drop_table(spark, table)
        table, turn = after, turn + 1
        counts = spark.read.schema(fresh.schema).parquet(table)
        reached = counts.where((F.col("meta").bitwiseAND(F.lit(4095)) == turn) & (F.shiftright("meta", 12).bitwiseAND(F.lit(7)) < LONGEST))
        slots, held = filter_bits(reached, bits)
        if len(slots):
            born[turn] = (slots, held)
    often.destroy()
    drop_table(spark, dealt)
    counts = spark.read.schema("key binary, v bigint, meta bigint").parquet(table)
    k = F.shiftright("meta", 12).bitwiseAND(F.lit(7)).cast("int")
    key = F.col("key").cast("string")
    phrase = F.substring_index(key, "\n", -1)
    named = counts.select(key.alias("key"), phrase.alias("phrase"), k.alias("k"), F.col("v").alias("f")).selectExpr("substring(key, 1, length(key) - length(phrase) - 1) as lang", "phrase", "k", "f")
    # longer phrases that are rare are still there if the scans ended before the fourth cycle did
    return named.where((F.col("k") > 0) & (F.col("f") >= threshold)), named.where("k = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, shards: int = SHARDS, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words that are there ``threshold`` times.

    score is floor(2000000 * a / (l + r)) for the cut into two parts for which it is least (of equal ones the first), in decimals, as are all products.
    Phrases inside a longer one that has four fifths of their occurrences are left out. Null texts count as empty; a null language is ``und``, together
    with what is called so; repeated rows count each; a language without such phrases gives no row, an empty table an empty one.
    """
    freq, whole = frequencies(docs, threshold, shards, bits)
    found = freq.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    part = freq.select("lang", "phrase", "f")
    cuts = found.select("*", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("left"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("x")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("x").alias("x"))
    inner = found.where("k > 2").select("lang", F.col("a").alias("over"), F.split("phrase", " ").alias("w"), "k", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "over", "w", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at")).select("lang", "over", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    hidden = F.expr("cast(100 as decimal(3,0)) * cast(over as decimal(19,0)) >= cast(80 as decimal(2,0)) * cast(a as decimal(19,0))")
    left = best.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(hidden, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase"))
    out = left.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top).join(whole, "lang")
    return out.select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")


SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 5) t(k) where len(w) >= k)
), f as (select lang, phrase, k, count(*) as f from grams group by all having count(*) >= {THRESHOLD} or k = 1),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') as p, array_to_string(w[cut + 1:k], ' ') as q from (select *, unnest(range(1, k)) as cut from cand)),
scored as (select c.lang, c.phrase, a, cut, x.f as l, y.f as r, cast((cast(2000000 as hugeint) * a) // (x.f + y.f) as bigint) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.p and x.k = cut join f y on y.lang = c.lang and y.phrase = c.q and y.k = c.k - cut),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
subs as (select lang, a, array_to_string(w[i:i + size - 1], ' ') as phrase from (select *, unnest(range(1, k - size + 2)) as i from (select *, unnest(range(2, k)) as size from cand))),
over as (select lang, phrase, max(a) as over from subs group by all),
kept as (select b.* from best b left join over o using (lang, phrase) where coalesce(100 * cast(over as hugeint) < 80 * cast(a as hugeint), true))
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept) join n using (lang) where rank <= {TOP}
"""
