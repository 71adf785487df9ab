"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are worked on in blocks of about this many bytes, whatever the size of an Arrow batch.
BLOCK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        import tempfile

        named = tempfile.mkdtemp(prefix="voltide-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows of an Arrow batch, which holds whole texts on both sides of the pipe to Python; a session's own smaller number stays.
BATCH_ROWS = 1024


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, *by: str) -> str:
    """Writes ``df`` as Parquet in the shared folder, in a folder for each value of ``by``; gives the path, for ``drop_table``."""
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``write_table`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores; larger inputs are left as they are."""
    _small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text only, under fixed names, whatever other columns there are."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], sized: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into blocks of about BLOCK_BYTES of the column ``sized``; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(sized))
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


#: Rows that one task sees beside one host text; a host of more rows is put beside several groups of them.
GROUP_ROWS = 512


#: Rows up to which a table of a few numbers a row is broadcast.
SMALL_ROWS = 100_000


def checked(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has SMALL_ROWS rows or fewer; for tables of a few numbers a row."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def dealt(pairs: DataFrame, host: str, guest: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with a column ``salt``, and (host, salt) once for each group: a host's rows are dealt over groups of about GROUP_ROWS by guest."""
    groups = pairs.groupBy(host).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("groups"))
    many = checked(groups.where("groups > 1"))
    salted = pairs.join(many, host, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(guest), F.col("groups")).cast("int"), F.lit(0))).drop("groups")
    return salted, groups.select(host, F.explode(F.expr("sequence(0, groups - 1)")).alias("salt"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_P = U64((1 << 31) - 1)
#: Values worked on at once, so that they stay in the processor's cache.
_STEP = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x``, which is below 2**62 and may be overwritten, modulo the prime 2**31 - 1."""
    for _ in range(2):
        high = x >> U64(31)
        x &= _P
        x += high
    x += (x + U64(1)) >> U64(31)  # the prime itself becomes 0
    x &= _P
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**31 - 1."""
    out = np.ones(max(n, 1), dtype=U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _reduced(out[:more] * U64(pow(base, done, int(_P))))
        done += more
    return out[:n].astype(np.uint32)


class Rolling:
    """Hashes of windows of an integer array: two polynomials modulo the prime 2**31 - 1, each over its own half of the values' bits.

    Sums of values over powers of the base are kept, from which the hash of any window follows. Different windows of n values have the
    same hash with a chance of about (n / 2**31)**2. (Modulo 2**64 some strings would collide whatever the base.)
    """

    BASES = (1_283_946_071, 718_281_829)

    def __init__(self) -> None:
        self._up: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * 2
        self._down = self._up

    def _grow(self, n: int) -> None:
        if len(self._up[0]) < n:
            n = max(n, 2 * len(self._up[0]), 1 << 16)
            self._up = [powers(b, n) for b in self.BASES]
            self._down = [powers(pow(b, -1, int(_P)), n) for b in self.BASES]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums from which ``window`` makes hashes; ``values`` are well mixed unsigned 64-bit integers."""
        n = len(values)
        self._grow(n + 1)
        out = np.zeros((2, n + 1), dtype=U64)
        for at in range(0, n, _STEP):
            to = min(at + _STEP, n)
            for k, half in enumerate((values[at:to] & _P, values[at:to] >> U64(33))):
                half *= self._down[k][at:to]
                np.cumsum(_reduced(half), out=out[k, at + 1 : to + 1])
                out[k, at + 1 : to + 1] += out[k, at]
        return out

    def window(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of [start, end), equal for equal content wherever it stands."""
        got = []
        for k in (0, 1):
            d = _reduced(prefix[k][end] - prefix[k][start])
            d *= self._up[k][end]
            got.append(_reduced(d))
        return got[0] << U64(31) | got[1]

    def every(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hash of each window of ``length`` values, by start."""
        n = prefix.shape[1] - length
        if n <= 0:
            return np.empty(0, dtype=U64)
        self._grow(length + n)
        out = np.zeros(n, dtype=U64)
        for at in range(0, n, _STEP):
            to = min(at + _STEP, n)
            for k in (0, 1):
                d = _reduced(prefix[k, at + length : to + length] - prefix[k, at:to])
                d *= self._up[k][at + length : to + length]
                out[at:to] = out[at:to] << U64(31) | _reduced(d)
        return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0] ... starts[0]+lens[0]-1, starts[1] ... and so on as one index array."""
    lens = np.asarray(lens, dtype=np.int64)
    total = int(lens.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    first = np.cumsum(lens) - lens
    return np.repeat(np.asarray(starts, dtype=np.int64) - first, lens) + np.arange(total, dtype=np.int64)


def positioned(values: np.ndarray) -> np.ndarray:
    """The values with their low bits replaced by the position, so that of values equal in the others the first is least."""
    bits = U64(len(values).bit_length())
    return (values >> bits << bits) | np.arange(len(values), dtype=U64)


def least_at(values: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, the first of equal ones, in each window of ``width`` values, given by its start."""
    n = len(values)
    if n < width or not len(start):
        return np.empty(0, dtype=np.int64)
    rows = np.concatenate([positioned(values), np.full(-n % width, np.iinfo(np.uint64).max, dtype=U64)]).reshape(-1, width)
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(rows, axis=1).ravel()
    least = np.minimum(tail[start], head[start + width - 1])
    return (least & ((U64(1) << U64(n.bit_length())) - U64(1))).astype(np.int64)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the JVM collects garbage.

    Twice, as plans that Python still held the first time are let go in between.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
