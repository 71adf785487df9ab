"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A shingle's weight is how often the text has it. Hashed darts fall on the plane of weight and rank as a Poisson process that
depends on the shingle alone; a text sees those over its weights, and each of K coordinates keeps the one of least rank. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates propose pairs; an
exact comparison of the whole texts' shingles decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, blocks, checked, dealt, mix, ragged, release, spread, texts, written
from .components import components
from .tokens import shingles, tokenise

WIDTH = 5
SIMILARITY = 0.8
#: 20 bands of 4: a pair of similarity 0.8 shares none with a chance of 3e-5, one of 0.9 with 5e-10.
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Share of agreeing coordinates (a byte of each) from which a pair is compared exactly: 4.5 standard deviations below 0.8.
ESTIMATE = 0.6
#: Texts of a bucket that are held against each other at once; larger buckets are cut into blocks, and every two blocks meet.
BLOCK = 512
#: The same for the texts of a bucket's largest class, of which only signatures are held.
MAIN_BLOCK = 8 * BLOCK
#: Shingles of the texts that a task holds to compare others with them.
HOME_ELEMENTS = 1 << 20
#: Pairs of signatures compared at once.
_CHUNK = 1 << 16
#: Rank up to which the first darts are thrown; each later throw doubles it.
_FIRST = 2.0**-7
_GOLD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=64)
def _poisson(rate: float) -> np.ndarray:
    """Distribution function of a Poisson variable, up to where it is 1."""
    k = np.arange(int(rate + 12 * math.sqrt(rate) + 24))
    return np.cumsum(np.exp(-rate + k * math.log(rate) - np.array([math.lgamma(i + 1.0) for i in k])))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def elements(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every unit of weight of the texts' shingles as a hash, and the offsets: the i-th copy of a shingle is an element of its own."""
    hashes, off = tokenise(batch)
    h, ends = shingles(hashes, off, WIDTH)
    doc = np.repeat(np.arange(len(ends) - 1, dtype=np.int64), np.diff(ends))
    key = mix(h ^ mix(doc.astype(U64) + U64(_GOLD)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    at = np.arange(len(key))
    copy = np.empty(len(key), dtype=np.int64)
    copy[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    again = np.flatnonzero(copy)
    h[again] = mix(h[again] ^ mix(copy[again].astype(U64)))
    return h, ends


def signatures(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest dart of each coordinate, for each text, and whether the text has any element."""
    n = len(ends) - 1
    out, some = np.zeros((n, K), dtype=U64), np.diff(ends) > 0
    open_docs = np.flatnonzero(some)
    filled = np.zeros((n, K), dtype=bool)
    low, high, level = 0.0, _FIRST, 0
    while open_docs.size:
        sizes = (ends[1:] - ends[:-1])[open_docs]
        e = h if len(open_docs) == n else h[ragged(ends[:-1][open_docs], sizes)]
        doc = np.repeat(open_docs, sizes)
        cell = mix(e + U64((level + 1) * _GOLD & (1 << 64) - 1))
        u, cdf = _uniform(cell), _poisson(high - low)
        hit = np.flatnonzero(u >= cdf[0])
        darts = np.searchsorted(cdf, u[hit], side="right")
        dart = mix(np.repeat(cell[hit], darts) + ragged(np.ones(len(hit), dtype=np.int64), darts).astype(U64) * U64(0xD1342543DE82EF95))
        rank, coord = _uniform(mix(dart ^ U64(0x5851F42D4C957F2D))), (dart % U64(K)).astype(np.int64)
        slot = np.repeat(doc[hit], darts) * K + coord
        free = ~filled.reshape(-1)[slot]
        dart, rank, slot = dart[free], rank[free], slot[free]
        least = np.full(n * K, np.inf)
        np.minimum.at(least, slot, rank)
        won = rank == least[slot]
        out.reshape(-1)[slot[won]] = dart[won]
        filled.reshape(-1)[slot[won]] = True
        open_docs = open_docs[~filled[open_docs].all(axis=1)]
        low, high, level = high, 2 * high, level + 1
    return out, some


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands, sig, n): key names the exact text, bands are null for a text without a word, n is its number of elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for block in blocks(batches):
            batch = block.column("text").to_pylist()
            h, of = elements(batch)
            sig, some = signatures(h, of)
            band = np.zeros((len(batch), BANDS), dtype=U64)
            for r in range(ROWS):
                band = mix(band + sig[:, r::ROWS])
            band = mix(band + np.arange(1, BANDS + 1, dtype=U64)[None, :])
            small = (sig >> U64(32)).astype(np.uint8)
            null = ~some
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)), pa.array(band[some].reshape(-1).view(np.int64)))
            keys = pa.array([hashlib.md5((t or "").encode()).digest() for t in batch], type=pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), keys, lists, pa.array([s.tobytes() for s in small], type=pa.binary()), pa.array(np.diff(of).astype(np.int64))], names=["doc_id", "key", "bands", "sig", "n"])

    df = spread(texts(docs).where("doc_id is not null"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, key binary, bands array<bigint>, sig binary, n bigint")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ESTIMATE of the coordinates or more."""
    rows = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, K) for c in ("sig_a", "sig_b"))
            ok = (a == b).sum(axis=1) >= ESTIMATE * K
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    kind = rows.schema["a"].dataType.simpleString()
    return rows.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def _homes(placed: DataFrame, hubs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(x, home) for each id of ``placed`` that is outside its bucket's largest class somewhere: ids with one best hub share homes.

    A home has about BLOCK texts and HOME_ELEMENTS shingles at most, so that a task can hold it, unless one text has more.
    """
    ids = placed.where("label <> main").select("id").distinct().join(sigs.select(F.col("doc_id").alias("id"), "n"), "id")
    ids = ids.join(hubs, "id", "left").withColumn("hub", F.coalesce("hub", "id"))
    size = ids.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HOME_ELEMENTS)).cast("int").alias("parts"))
    return ids.join(size, "hub").select(F.col("id").alias("x"), F.xxhash64("hub", F.pmod(F.xxhash64("id"), "parts")).alias("home"))


def _main(placed: DataFrame) -> DataFrame:
    """``placed`` (bucket, id, label) in buckets of several labels, with the label that most of the bucket's rows have and both sizes."""
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("size")).where("size > inside")
    return placed.join(main, "bucket")


def _across(placed: DataFrame, homes: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """(y, home, xs): all pairs of a bucket of ``placed`` with different labels whose signatures agree in ESTIMATE or more, each once.

    x is always a text outside the bucket's largest class, and its partners are listed by y and the home of x, so the rows grow with the
    texts and not with the pairs. Those texts are cut into blocks of about BLOCK, the largest class into blocks of MAIN_BLOCK; each block of
    the former meets each of either kind in a group of its own, whatever task they are in. Pairs of the largest class never meet. Pairs whose
    sizes alone keep them below ``similarity`` are left out.
    """
    few = F.ceil((F.col("size") - F.col("inside")) / BLOCK).cast("int")
    many = F.ceil(F.col("inside") / MAIN_BLOCK).cast("int")
    rows = placed.withColumns({"few": few, "many": many, "out": F.col("label") != F.col("main")})
    mine = F.when(F.col("out"), F.pmod(F.xxhash64("id"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("id"), "many"))
    rows = rows.withColumns({"mine": mine.cast("int"), "last": F.col("few") - 1 + F.when(F.col("out"), F.col("many")).otherwise(0)})
    rows = rows.join(sigs.select(F.col("doc_id").alias("id"), "bands", "sig", "n"), "id").join(homes, F.col("id") == F.col("x"), "left")
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, last)")))
    rows = rows.select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("late"), "id", "label", F.coalesce("home", F.lit(0)).alias("home"), "n", "sig", "bands")
    rows = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "late")
    kind = rows.schema["id"].dataType.simpleString()

    def met(batch: pa.RecordBatch, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, low, high, late, n, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high", "late", "n", "home"))
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        at, end = np.arange(len(bucket)), edge[1:][group]
        early = np.bincount(group, weights=~late, minlength=len(edge) - 1).astype(np.int64)  # rows of a group's first block
        first = np.where(low == high, at + 1, np.where(late, end, edge[:-1][group] + early[group]))
        many = np.maximum(end - first, 0)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, K)
        bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        ids, label = batch.column("id"), batch.column("label")
        ends = np.cumsum(many)
        lo = 0
        while lo < len(many):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHUNK, side="right")))
            a, b = np.repeat(at[lo:hi], many[lo:hi]), ragged(first[lo:hi], many[lo:hi])
            lo = hi
            for keep in (
                lambda a, b: pc.not_equal(label.take(pa.array(a)), label.take(pa.array(b))).to_numpy(zero_copy_only=False),
                lambda a, b: np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9,
                lambda a, b: (sig[a] == sig[b]).sum(axis=1) >= ESTIMATE * K,
                lambda a, b: bands[a, (bands[a] == bands[b]).argmax(axis=1)] == bucket[a],  # the first bucket that both are in
            ):
                if len(a):
                    ok = keep(a, b)
                    a, b = a[ok], b[ok]
            if len(a):
                order = np.lexsort((home[a], b))
                a, b = a[order], b[order]
                cut = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (home[a[1:]] != home[a[:-1]])))
                xs = pa.ListArray.from_arrays(pa.array(np.append(cut, len(a)).astype(np.int32)), ids.take(pa.array(a)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(b[cut])), pa.array(home[a[cut]]), xs], names=["y", "home", "xs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None  # the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for c in ("bucket", "low", "high"):
                v = batch.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            edge = np.flatnonzero(new)
            carry = batch.slice(edge[-1])
            if len(edge) > 1:
                yield from met(batch.slice(0, edge[-1]), edge)
        if carry is not None:
            yield from met(carry, np.array([0, carry.num_rows]))

    met_rows = rows.mapInArrow(run, f"y {kind}, home bigint, xs array<{kind}>")
    return met_rows.groupBy("y", "home").agg(F.flatten(F.collect_list("xs")).alias("xs"))


def _linked(met: DataFrame, homes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of ``similarity`` or more among the pairs of ``met`` (y, home, xs), enough to join all that they join.

    A home's texts are sent once to each group of about GROUP_ROWS of its partners, and each partner's text once to each home; whole
    texts are compared there. A pair that links found in the same group already join is passed over, so a group gives fewer links than it has texts.
    """
    hosts = homes.join(met.select("home").distinct(), "home", "left_semi")
    needed = written(met.select(F.col("y").alias("doc_id")).union(hosts.select("x")).distinct())
    t = texts(docs).join(checked(needed), "doc_id", "left_semi")  # before the texts are shuffled, where their ids are few
    salted, groups = dealt(met, "home", "y")
    kind = salted.schema["y"].dataType.simpleString()
    guests = salted.join(t.withColumnRenamed("doc_id", "y"), "y").select("home", "salt", F.lit(True).alias("guest"), F.col("y").alias("id"), "xs", "text")
    hosts = hosts.join(groups, "home").join(t.withColumnRenamed("doc_id", "x"), "x")
    hosts = hosts.select("home", "salt", F.lit(False).alias("guest"), F.col("x").alias("id"), F.lit(None).cast(f"array<{kind}>").alias("xs"), "text")
    faced = hosts.union(guests).repartition("home", "salt").sortWithinPartitions("home", "salt", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, up = None, {}, {}

        def root(v):
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            return v

        for block in blocks(batches):
            h, ends = elements(block.column("text").to_pylist())
            a, b = [], []
            for k, (home, salt, guest, doc, xs) in enumerate(zip(*(block.column(c).to_pylist() for c in ("home", "salt", "guest", "id", "xs")))):
                if (home, salt) != at:
                    at, held, up = (home, salt), {}, {}
                mine = np.sort(h[ends[k] : ends[k + 1]])
                if not guest:
                    held.setdefault(doc, []).append(mine)
                    continue
                for x in xs:
                    if root(x) == root(doc):
                        continue
                    for host in held[x]:
                        both = int((host[np.minimum(np.searchsorted(host, mine), len(host) - 1)] == mine).sum()) if len(host) else 0
                        if both >= similarity * max(len(mine) + len(host) - both, 1):
                            a.append(x)
                            b.append(doc)
                            up[root(x)] = root(doc)
                            break
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, type=block.column("id").type), pa.array(b, type=block.column("id").type)], names=["a", "b"])

    return faced.mapInArrow(run, f"a {kind}, b {kind}")


def similarities(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, similarity): exact weighted Jaccard similarity of the whole texts' shingles.

    The texts of the a are sent to those of their b, each of which goes before them once for each group of GROUP_ROWS and is cut into
    shingles once there.
    """
    t = texts(docs)
    salted, hosts = dealt(written(pairs.select("a", "b")), "b", "a")
    rows = salted.join(t.select(F.col("doc_id").alias("a"), "text"), "a").select("b", "salt", "a", "text")
    first = hosts.join(t.select(F.col("doc_id").alias("b"), "text"), "b")
    kind = rows.schema["a"].dataType.simpleString()
    faced = first.select("b", "salt", F.lit(None).cast(kind).alias("a"), "text").union(rows).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = np.empty(0, dtype=U64)
        for block in blocks(batches):
            h, ends = elements(block.column("text").to_pylist())
            value = np.zeros(block.num_rows)
            is_host = block.column("a").is_null().to_numpy(zero_copy_only=False)
            for k in range(block.num_rows):
                mine = np.sort(h[ends[k] : ends[k + 1]])
                if is_host[k]:
                    host = mine
                    continue
                both = int((host[np.minimum(np.searchsorted(host, mine), len(host) - 1)] == mine).sum()) if len(host) else 0
                value[k] = both / max(len(mine) + len(host) - both, 1)
            yield pa.RecordBatch.from_arrays([block.column("a"), block.column("b"), pa.array(value)], names=["a", "b", "similarity"]).filter(pa.array(~is_host))

    return faced.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): one row for each doc_id; class_id is the least doc_id of its class.

    Classes are the connected components of links between texts whose similarity is ``similarity`` or more; equal texts are one.
    A null text counts as an empty one. A text without a word is linked with equal texts only; one of fewer than five words has one
    shingle, of all of them. Rows without a doc_id are left out; a doc_id with several texts joins their classes. doc_id may be of any type
    that has an order.

    Links: a bucket's hub is the text in it that shares most buckets with others. Every text is compared with the best hub of its buckets;
    then, in buckets whose texts are not in one class yet, with the hubs of the others and with the text before it in the order of
    the next band. These rounds are cheap and join most; at last, in buckets whose texts are still not in one class, all pairs across
    classes are compared if their signatures agree, and are never rows of their own: a text and the texts that it is to be held against
    travel as one row for each home of these. So no similar pair of a common bucket is left, but for those whose signatures agree in less
    than ESTIMATE (a chance of 1e-5 at similarity 0.8).
    """
    signed = written(_signed(docs))
    firsts = signed.groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = written(signed.select("doc_id", "key").distinct().join(firsts, "key").select("doc_id", "rep"))
    sigs = written(signed.join(firsts.select(F.col("rep").alias("doc_id"), F.col("key").alias("rep_key")), "doc_id").where("key = rep_key and bands is not null").select("doc_id", "bands", "sig", "n"))
    rows = sigs.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "bucket"), "bands")
    rows = rows.select("id", "bucket", F.col("bands")[(F.col("band") + 1) % BANDS].alias("next"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = written(rows.join(sizes, "bucket"))
    fame = held.groupBy("id").agg(F.sum("n").alias("fame"))
    order = F.struct((-F.col("fame")).alias("minus"), "id")
    ranked = held.select("bucket", "id").join(fame, "id")
    hubs = ranked.groupBy("bucket").agg(F.min_by("id", order).alias("hub"), F.min(order).alias("o"))
    nearest = held.select("bucket", "id").join(hubs, "bucket").where("id <> hub").groupBy("id").agg(F.min_by("hub", "o").alias("hub"))
    stars = nearest.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    release(docs.sparkSession)
    tried = written(similarities(_agreeing(stars, sigs), docs))
    alike = F.col("similarity") >= similarity
    first = tried.where(alike).select("a", "b")
    release(docs.sparkSession)
    label = components(first)
    named = label.select(F.col("id").alias("hub"), F.col("label").alias("hub_label"))
    placed = held.join(label, "id", "left").select("bucket", "id", "next", F.coalesce("label", "id").alias("label"))
    split = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    rest = placed.join(split, "bucket").join(hubs.select("bucket", "hub"), "bucket").join(named, "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub"))
    w = Window.partitionBy("bucket").orderBy("next", "id")
    rest = rest.withColumns({"before": F.lag("id").over(w), "before_label": F.lag("label").over(w)})
    tries = F.explode(F.array(F.struct(F.col("hub").alias("o"), F.col("hub_label").alias("l")), F.struct(F.col("before").alias("o"), F.col("before_label").alias("l")))).alias("t")
    across = rest.select("id", "label", tries).where("t.o is not null and t.l <> label").select(F.least("id", "t.o").alias("a"), F.greatest("id", "t.o").alias("b")).distinct()
    across = across.join(stars, ["a", "b"], "left_anti")
    release(docs.sparkSession)
    second = written(similarities(_agreeing(across, sigs), docs))
    release(docs.sparkSession)
    links = first.union(second.where(alike).select("a", "b"))
    label = components(links)
    placed = written(_main(held.select("bucket", "id").join(label, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))))
    homes = written(_homes(placed, nearest, sigs))
    met = written(_across(placed, homes, sigs, similarity))
    release(docs.sparkSession)
    links = links.union(written(_linked(met, homes, docs, similarity)))
    release(docs.sparkSession)
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    label = components(links.union(several))
    found = members.join(label.withColumnRenamed("id", "rep"), "rep", "left")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents whose doc_id is their class's least one, one row each; rows without a doc_id stay.

    Of several rows with that doc_id the one stays whose text has the least digest, and of equal texts the one whose columns' hash is least.
    """
    firsts = classes(docs, similarity).where("doc_id = class_id").select("doc_id")
    kept = docs.where("doc_id is not null").join(firsts, "doc_id", "left_semi").select(docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns))).alias("first_row_of_id")
    return kept.select("*", first).where("first_row_of_id = 1").select(docs.columns).unionByName(docs.where("doc_id is null"))
