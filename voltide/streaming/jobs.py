"""Structured Streaming jobs over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import surface as S
from ..operators.stage import same
from ..sources.payload import chain_from_json, error_payload


def _earlier(spark: SparkSession, folder: str, batch_id: int, schema) -> DataFrame:
    """What earlier batches have written to ``folder``, by batch=<id>: a batch that is run again doesn't see its own rows."""
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(folder).where(F.col("batch") < batch_id)


def once(rows: DataFrame) -> DataFrame:
    """One row for each contract of a date, of several the least; rows without a contract count by all their columns."""
    key = F.coalesce(F.concat(F.lit("c"), "contract_id"), F.concat(F.lit("r"), F.to_json(F.struct(*rows.columns))))
    first = rows.select("date", key.alias("contract_key"), F.struct(*rows.columns).alias("row")).groupBy("date", "contract_key").agg(F.min("row").alias("row"))
    return first.select("contract_key", "row.*")


def stream_chain_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, max_files: int = 1000) -> None:
    """New payload files (JSON lines with a field ``body``) as typed, flagged rows; refused payloads go to ``out``_rejects.

    Runs until no new file is left and may be started again: the checkpoint knows the files that are done. A batch that is run
    again after a failure writes its rows to the same folder, batch=<id>, so none is doubled. A payload that lands again, in the same batch or
    in a later one, even after a restart, gives no further rows: the first of a contract and date stays. What is known is the table itself, of which a batch
    reads the keys of its own dates; no state grows in memory, and a late date is not turned away.
    """
    source = spark.readStream.schema("body string").option("maxFilesPerTrigger", max_files).json(landing)

    def each(batch: DataFrame, batch_id: int) -> None:
        bad = error_payload(F.col("body"))
        rows = once(S.quality_flags(chain_from_json(batch.where(~bad)).withColumn("mid", (F.col("bid") + F.col("ask")) / 2.0))).persist()
        new = rows
        if batch_id > 0:
            keys = rows.select("date", "contract_key").schema
            dates = rows.select("date").distinct()
            known = _earlier(spark, out, batch_id, keys).alias("l").join(F.broadcast(dates).alias("r"), same("l", "r", ["date"]), "left_semi")  # a batch's dates
            new = rows.alias("l").join(known.alias("r"), same("l", "r", ["date", "contract_key"]), "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.where(bad).write.mode("overwrite").parquet(f"{out}_rejects/batch={batch_id}")
        rows.unpersist()

    source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_date_close(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, max_files: int = 1000, keep_days: int = 0) -> None:
    """Emits a date's single-valued surface, once, when a date over ``keep_days`` days later has been seen; rows for dates closed before they came
    go to ``out``_late, with the batch and the date up to which all were closed then (``closed_through``).

    Rows of dates still open are a table, ``out``_open/batch=<id>: a batch reads that of the batch before and writes its own, with the greatest
    date seen; older ones are deleted. So the state is rows, however many a date has, and a batch that is run again after a failure reads and writes
    what it did before. May be started again. Rows without a date are late rows, as no date closes them.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)
    columns = source.columns
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def each(batch: DataFrame, batch_id: int) -> None:
        before = fs.Path(f"{out}_open/batch={batch_id - 1}")
        held, seen = None, None
        if batch_id > 0 and before.getFileSystem(conf).exists(before):
            held = spark.read.schema(f"{schema}, _seen date").parquet(f"{out}_open/batch={batch_id - 1}")
            seen = held.agg(F.max("_seen")).first()[0]
        latest = batch.agg(F.max(F.col("date").cast("date"))).first()[0]
        now = max((x for x in (latest, seen) if x is not None), default=None)
        closed = F.date_sub(F.lit(seen).cast("date"), keep_days)  # dates before it have been emitted
        late = F.coalesce(F.col("date").cast("date") < closed, F.col("date").isNull())
        rows = batch.where(~late) if held is None else held.where("date is not null").select(*columns).unionByName(batch.where(~late))
        ready = F.col("date").cast("date") < F.date_sub(F.lit(now).cast("date"), keep_days)
        S.otm_build(rows.where(ready)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        audit = batch.where(late).select("*", F.lit(batch_id).cast("long").alias("batch_id"), F.date_sub(closed, 1).alias("closed_through"))
        audit.write.mode("overwrite").parquet(f"{out}_late/batch={batch_id}")
        still = rows.where(~F.coalesce(ready, F.lit(False))).withColumn("_seen", F.lit(now).cast("date"))
        if now is not None:  # a row that only says how far dates have been seen, where none is open
            mark = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in still.schema if f.name != "_seen"), F.lit(now).cast("date").alias("_seen"))
            still = still.unionByName(mark)
        still.write.mode("overwrite").parquet(f"{out}_open/batch={batch_id}")
        old = fs.Path(f"{out}_open/batch={batch_id - 2}")
        old.getFileSystem(conf).delete(old, True)

    source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
