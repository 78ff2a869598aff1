"""Keyed state in the engine's state store: the last row of each pair, whether it is new, and when it may be forgotten.

State lives in the checkpoint, partitioned by pair, and each micro-batch commits it with its offsets; a query that is
stopped anywhere goes on from there.  It can be read as a table (`stored_states`) without the query.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD_BYTES, ROWS_OUT = 16 << 20, 10_000
# built without a session, as the workers have none
_STATE = [StructField("place", LongType()), StructField("deleted", BooleanType()), StructField("payload", StringType())]
_CHANGE = [StructField("key", StringType()), *_STATE, StructField("is_new", BooleanType()), StructField("was_active", BooleanType())]


class LatestRow(StatefulProcessor):
    """Keeps the row of the greatest place of each key; rows that are older change nothing.

    Keys whose last row is deleted are forgotten `forget_ms` later, in the time of the rows: their ids are not used again.
    """

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", StructType(_STATE))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()
        last, place = None, None if before is None else before[0]
        for row in rows:
            if place is None or row["place"] > place:
                last, place = row, row["place"]
        if last is None:
            return
        best = (place, last["deleted"], last["payload"])
        self.last.update(best)
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[1]:
                self.handle.registerTimer(last["at_ms"] + self.forget_ms)
        was_active = before is not None and not before[1]
        yield Row(key=key[0], place=best[0], deleted=best[1], payload=best[2], is_new=before is None, was_active=was_active)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's packed rows without those that a row of the same key and a greater place outdates; at most HELD_BYTES and a batch are held, so some may be left."""

    def last(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("key", "ascending"), ("place", "descending")])).combine_chunks()
        keys = rows["key"].combine_chunks()
        return rows.filter(pa.concat_arrays([pa.array([True] * min(1, len(keys)), pa.bool_()), pc.not_equal(keys[1:], keys[:-1])]))

    held, size = [], 0
    for batch in batches:
        held.append(last(pa.Table.from_batches([batch])))
        size += held[-1].nbytes
        if size > HELD_BYTES:
            held = [last(pa.concat_tables(held))]
            size = held[0].nbytes
            if size > HELD_BYTES // 2:
                yield from held[0].to_batches(max_chunksize=ROWS_OUT)
                held, size = [], 0
    if held:
        yield from last(pa.concat_tables(held)).to_batches(max_chunksize=ROWS_OUT)


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in the provider that keyed state needs; the session stays as it was."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def row_changes(stream: DataFrame, key: str = "pair_id", order: str = "log_seq", deleted: Column | None = None, at: str | None = None, late: str = "1 hour", forget_ms: int = 0) -> DataFrame:
    """The rows that become the last of their key in a micro-batch, with is_new and was_active; start it in `state_store`.

    `order` is a whole number that grows along the log.  Rows without a key or place are left out.  With `at`, a time of
    the rows, deleted keys are forgotten once the watermark (`late` behind) is forget_ms past their deletion; rows that
    are later than the watermark are left out then.
    """
    deleted = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    rows = stream.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    columns = [F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("place"), deleted.alias("deleted"), F.to_json(F.struct("*")).alias("payload")]
    if at is None:
        packed = rows.select(*columns).mapInArrow(last_rows, StructType([_CHANGE[0], *_STATE]))
    else:  # all rows go on: one that is too late must not stand for one that is not
        time = F.coalesce(F.col(at).cast("timestamp"), F.timestamp_millis(F.lit(0)))
        packed = rows.select(*columns, time.alias("at")).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    processor = LatestRow(None if at is None else forget_ms)
    out = packed.groupBy("key").transformWithState(processor, StructType(_CHANGE), "update", "none" if at is None else "eventTime")
    return out.select(F.from_json("payload", stream.schema).alias("row"), "is_new", "was_active").select("row.*", "is_new", "was_active")


def stored_states(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """The last row of each key as of the last finished micro-batch of a query, from its checkpoint."""
    states = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return states.select(F.from_json("value.payload", schema).alias("row")).select("row.*")
