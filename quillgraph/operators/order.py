"""Places, running sums and carried values in an order, without a window over a whole table or a whole group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import staged


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """Rows with their place (from 0) by `order`: ranges are sorted apart, and each adds the rows of the ranges before it."""
    ranged = _ranged(rows, order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(before, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def _ranged(rows: DataFrame, order: list[str | Column], made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows dealt by ranges of an order, written with the number of their range, which stands from then on.

    Borders of ranges come from a pass of its own over the rows, so what is dear to compute from a row is `made` after it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return staged(made(dealt) if made else dealt, "ranges")


def scanned(
    rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], carried: dict[str, Column] | None = None,
    made: Callable[[DataFrame], DataFrame] | None = None, kept: Column | None = None,
) -> DataFrame:
    """Rows with running sums and the last values that are not null, both within each group of keys and up to the row itself.

    Two passes over ranges of (keys, order): each range is scanned by itself, then what the ranges before it have summed
    and carried for the same group is added.  Only groups that lie in several ranges need that, at most two for each
    range, so a group of any size is spread over as many tasks as its rows fill.  Names that begin with _ are taken.
    `made` adds columns to each row once it is dealt, and of these rows those that are `kept` are scanned.
    """
    carried = carried or {}
    ins = {f"_in_{n}": c for n, c in (sums | carried).items()}
    ranged = _ranged(rows, [*keys, *order], lambda dealt: (made(dealt) if made else dealt).withColumns(ins))
    ranged = ranged if kept is None else ranged.where(kept)
    columns = [c for c in ranged.columns if c not in ins and c != "_part"]
    by = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda n: F.last(f"_in_{n}", ignorenulls=True)
    local = ranged.withColumns({n: F.sum(f"_in_{n}").over(by) for n in sums} | {n: last(n).over(by) for n in carried})

    place = F.struct(*order)
    latest = lambda n: F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place))
    ends = ranged.groupBy("_part", *keys).agg(*[F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums], *[latest(n).alias(f"_of_{n}") for n in carried])
    # a group lies in several ranges only as the first or the last of each
    group = F.struct(*keys)
    edges = ends.groupBy("_part").agg(F.min(group).alias("_first"), F.max(group).alias("_last"))
    borders = edges.select(F.explode(F.array("_first", "_last")).alias("_k")).distinct().select(*[F.col(f"_k.{k}").alias(f"_k_{k}") for k in keys])
    same = lambda prefix: reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])
    few = ends.join(F.broadcast(borders), same("_k_"), "left_semi")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = few.select(
        F.col("_part").alias("_b_part"), *[F.col(k).alias(f"_b_{k}") for k in keys],
        *[F.sum(f"_of_{n}").over(earlier).alias(f"_before_{n}") for n in sums], *[F.last(f"_of_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in carried],
    )
    met = local.join(F.broadcast(before), (F.col("_part") == F.col("_b_part")) & same("_b_"), "left")
    out = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(n, f"_before_{n}") for n in carried}
    return met.withColumns(out).select(*columns, *out)
