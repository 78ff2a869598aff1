"""Dominance counting: for each point, how many points have a smaller slot and a strictly larger level, and their weight.

A weighted wavelet matrix holds level ranks in slot order, bit plane by bit plane, with prefix sums of ones and of their
weights in each plane; "how many of the first p are greater than v" takes one step for each plane.  The matrix is dealt
out in two ways.  Its upper planes (which range of levels a point lies in) are sharded by slot, its lower planes (the
ranks within a range of levels) are nodes of their own, each in slot order.  A point asks two shards, that of its
levels and that of its slots, and reads the whole shards before its own from a table of prefix sums, so it is not sent
to every earlier shard.  Shards are range partitions of about `part_rows` points; the table has a cell for each shard
and range of levels, at most a sixteenth of the points.

The two orders are (slot, level, row) and (level, slot, row).  A point that is earlier in the first and later in the
second has a smaller slot and a larger level, and no other has, so ties need no care at the borders of shards: a slot or
a level with any share of all points is spread over many shards.

Defined results: a point with a null slot or level is above none and gets null counts; a null weight counts as 0;
repeated rows count once each; an empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import importable, own_names, staged

PART_ROWS = 1 << 17
POINT = ("slot", "level", "weight")


class WaveletMatrix:
    """A sequence of numbers from 0 on by bit planes, the highest first, with prefix sums of ones and of their weights."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.size = len(values)
        self.bits = int(values.max()).bit_length() if self.size else 0
        self.planes = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            count, mass = np.zeros(self.size + 1, np.int64), np.zeros(self.size + 1, np.int64)
            np.cumsum(ones, out=count[1:])
            np.cumsum(ones * weights, out=mass[1:])
            self.planes.append((bit, count, mass))
            order = np.concatenate([np.flatnonzero(ones == 0), np.flatnonzero(ones)])
            values, weights = values[order], weights[order]

    def greater(self, prefix: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query how many of the first `prefix` numbers are greater than `value`, and their weight."""
        found, weight = np.zeros(len(prefix), np.int64), np.zeros(len(prefix), np.int64)
        beyond = (value >> self.bits) > 0
        low, high = np.zeros(len(prefix), np.int64), np.where(beyond, 0, prefix)
        for bit, count, mass in self.planes:
            one = ((value >> bit) & 1).astype(bool)
            ones_low, ones_high = count[low], count[high]
            found += np.where(one, 0, ones_high - ones_low)
            weight += np.where(one, 0, mass[high] - mass[low])
            zeros = self.size - count[-1]
            low, high = np.where(one, zeros + ones_low, low - ones_low), np.where(one, zeros + ones_high, high - ones_high)
        return found, weight


def _counted(batches: Iterator[pa.RecordBatch], values: str) -> Iterator[pa.RecordBatch]:
    """Adds to the counts of a partition's rows those of its earlier rows, by slot, whose value is greater; and tells the partition."""
    from pyspark import TaskContext

    batches = list(batches)
    if not batches:
        return
    part, table = TaskContext.get().partitionId(), pa.Table.from_batches(batches)
    column = {n: table.column(n).to_numpy() for n in ("slot", "level", "weight", "row", values)}
    order = np.lexsort((column["row"], column["level"], column["slot"]))
    ranks = np.unique(column[values], return_inverse=True)[1].reshape(-1)[order]
    counts = WaveletMatrix(ranks, column["weight"][order]).greater(np.arange(len(order)), ranks)
    put = lambda name, value: table.set_column(table.schema.get_field_index(name), name, pa.array(value))
    for name, of in zip(("n_above", "weight_above"), counts):
        placed = np.empty(len(order), np.int64)
        placed[order] = of
        table = put(name, table.column(name).to_numpy() + placed)
    table = put("shard" if values == "chunk" else "chunk", np.full(len(order), part, np.int32))
    yield from table.to_batches(max_chunksize=1 << 16)


def _in_higher_chunks(key: tuple, table: pa.Table, chunks: int) -> pa.Table:
    """A shard's points in chunks above each chunk, for all chunks."""
    at = table.column("chunk").to_numpy()
    sums = []
    for name in ("n", "w"):
        own = np.zeros(chunks + 1, np.int64)
        own[at] = table.column(name).to_numpy()
        sums.append(np.cumsum(own[::-1])[::-1][1:])
    return pa.table({"shard": pa.array(np.full(chunks, key[0].as_py(), np.int32)), "chunk": pa.array(np.arange(chunks, dtype=np.int32)), "n": sums[0], "w": sums[1]})


def shards_for(rows: int, part_rows: int) -> int:
    """As many that shards hold about part_rows each, or more where shards squared would outgrow a sixteenth of the rows."""
    return max(1, ceil(rows / max(part_rows, 4 * isqrt(rows))))


def count_above(points: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Points (slot, level, weight as long, and any other columns) with n_above and weight_above, both long."""
    spark = points.sparkSession
    importable(spark)
    names = points.columns
    base = own_names(points, POINT)
    inner = base.columns
    weight = F.coalesce(F.col("weight"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    base = base.withColumns({"weight": weight, "row": F.monotonically_increasing_id(), "n_above": zero, "weight_above": zero, "chunk": F.lit(0), "shard": F.lit(0)})
    base = staged(base, "points")  # row numbers stand from here on
    placed = F.col("slot").isNotNull() & F.col("level").isNotNull()
    whole = base.where(placed)
    shards = shards_for(whole.count(), part_rows)
    schema = base.schema
    by_level = whole.repartitionByRange(shards, "level", "slot", "row").mapInArrow(partial(_counted, values="level"), schema)
    by_level = staged(by_level, "levels")
    by_slot = by_level.repartitionByRange(shards, "slot", "level", "row").mapInArrow(partial(_counted, values="chunk"), schema)
    by_slot = staged(by_slot, "slots")
    cells = by_slot.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    chunks = 1 + (by_level.agg(F.max("chunk")).first()[0] or 0)
    higher = cells.groupBy("shard").applyInArrow(lambda key, rows: _in_higher_chunks(key, rows, chunks), "shard int, chunk int, n long, w long")
    earlier = Window.partitionBy("chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    whole_shards = higher.select("shard", "chunk", F.coalesce(F.sum("n").over(earlier), zero).alias("more_n"), F.coalesce(F.sum("w").over(earlier), zero).alias("more_w"))
    # the table grows with the input: both sides are dealt by shard and range of levels
    met = by_slot.join(whole_shards.hint("shuffle_hash"), ["shard", "chunk"])
    outer = [F.col(a).alias(b) for a, b in zip(inner, names)]
    counted = met.select(*outer, (F.col("n_above") + F.col("more_n")).alias("n_above"), (F.col("weight_above") + F.col("more_w")).alias("weight_above"))
    null = F.lit(None).cast("long")
    return counted.unionAll(base.where(~placed).select(*outer, null.alias("n_above"), null.alias("weight_above")))


# --- sales as points ---------------------------------------------------------------------------------------------------


def minutes(timestamp: Column, zoned: bool) -> Column:
    """Whole minutes since 1970, rounded down; a timestamp without a zone is taken as UTC, whatever the session's zone."""
    if zoned:
        return F.floor(F.unix_seconds(timestamp) / 60)
    day = F.datediff(timestamp.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 1440 + F.hour(timestamp) * 60 + F.minute(timestamp)


def sale_points(sales: DataFrame) -> DataFrame:
    """sale_id, slot (minutes), level (hundredths) and weight (1 to 5 by the checksum of the id; 1 for a null id).

    A total that is not a finite number has no level.
    """
    zoned = dict(sales.dtypes)["sold_at"] == "timestamp"
    level = F.when(F.abs("total") < 9e16, F.floor(F.floor(F.lit(100.0) * F.col("total") + 0.5) / F.lit(1.0)))
    weight = 1 + F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(0)) % 5
    return sales.select("sale_id", minutes(F.col("sold_at"), zoned).alias("slot"), level.cast("long").alias("level"), weight.cast("long").alias("weight"))
