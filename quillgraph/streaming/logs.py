"""Structured Streaming over logs and events: batch operators as continuous ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.pairs import dedup_key
from ..sources.commits import Snapshot, Versions


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts by window and key; state is dropped when the watermark passes a window.  Works on batches alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def new_pairs(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each pair once while its first copy is within the watermark."""
    timed = stream.withColumn("arrived", F.to_timestamp("created_at")).withWatermark("arrived", late)
    keyed = timed.withColumn("key", dedup_key(F.col("question"), F.col("chosen"), F.col("rejected")))
    return keyed.dropDuplicatesWithinWatermark(["key"]).drop("key")


def in_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Gives each micro-batch with its number to `write`, until what is there now is done."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BUCKETS = 64


def latest_state_table(stream: DataFrame, path: str, key: str = "pair_id", order: str = "log_seq", *, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps a table of the last row of each key, in buckets of keys; a micro-batch writes anew only the buckets that it touches.

    Each batch is a version: its buckets are written beside the ones they replace and published together, with the batch's
    number.  A batch that is lost on its way leaves the table as it was, and one that is run again after it was published
    changes nothing.
    """
    from ..operators.graph import latest

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = Versions(spark, path)
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers

        def made(base: Snapshot) -> dict | None:
            if base.notes.get(checkpoint, -1) >= number:
                return None
            before, name = table.places(base, touched), table.aside().removeprefix("_aside-")
            rows = new
            if before:
                kept = spark.read.schema(batch.schema).parquet(*before)
                rows = new.unionByName(kept.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
            latest(rows, (key,), order).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
            return {"put": {b: f"{name}/bucket={b}" for b in touched}, "notes": {checkpoint: number}}

        table.change(made)

    return in_batches(stream, upsert, checkpoint)


def read_latest_state(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The table at its last version, or at an earlier one."""
    table = Versions(spark, path)
    places = table.places(table.snapshot(version))
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def train_when_due(stream: DataFrame, checkpoint: str, threshold: int, train: Callable[[int], None], ready: Callable[[], bool] | None = None) -> StreamingQuery:
    """Calls `train` with the pairs since the last call as soon as a micro-batch brings them to the threshold and `ready` agrees.

    The count is published with the batch's number, as a version without data, so it goes on after a restart and a batch
    that is run again counts once (it may call `train` again if it was lost between the call and the count).
    """

    def count(batch: DataFrame, number: int) -> None:
        counts = Versions(batch.sparkSession, f"{checkpoint}/since")

        def made(base: Snapshot) -> dict | None:
            if base.notes.get("batch", -1) >= number:
                return None
            n = base.notes.get("since", 0) + batch.count()
            if n >= threshold and (ready is None or ready()):
                train(n)
                n = 0
            return {"notes": {"batch": number, "since": n}}

        counts.change(made)

    return in_batches(stream, count, f"{checkpoint}/query", "update")


def languages(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends paper_id and language of layouts that come in; papers already seen come back from the checkpoint, not the files."""
    from ..sources.layout import paper_languages

    rows = paper_languages(stream)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
