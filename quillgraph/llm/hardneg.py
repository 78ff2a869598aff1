"""Hard negatives for retrieval training, mined by blocked matrix products.

Vectors become whole numbers (floor of scale times each component) and are packed, without a shuffle, into blocks of up
to 4,096 rows.  Anchors are packed into blocks of up to 1,024 rows; these are broadcast in waves of at most `WAVE_BYTES`
and meet every block of candidates in a matrix product in double precision, which is exact while scores stay below 2^53
(blocks whose components could exceed that are multiplied in 64-bit whole numbers).

The first pass keeps for each anchor its best rows of the same label, in tasks as running lists and across tasks by a
ranking that merges them.  The second pass keeps for each anchor and positive the best rows of another label whose score
lies in a window given in percent of the positive's.  What a task holds is bounded by its wave, whatever the number of
candidates; what it sends out are at most k rows for each anchor and window.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; vectors
are compared with those of the same length only; repeated rows are rows of their own (each may be an anchor, and another
row of the same id may be its positive); ties go to the smaller id; an empty table gives an empty result; other columns
are ignored.  Scores beyond 64 bits raise an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_type, importable, out_batch, staged

BLOCK, ANCHOR_BLOCK, SLICE = 4096, 1024, 128
WAVE_BYTES = 128 << 20
NONE = -(1 << 63) + 1

BLOCKS = "block long,dim int,n int,n_anchors int,peak double,wide boolean,ids binary,labels binary,rows binary,anchors binary,vectors binary"
BEST = "anchor_block long,anchor int,anchor_id long,place int,score long,vec_id long"


class _Block:
    """Rows of one block in order of label and id."""

    def __init__(self, row: dict):
        self.number, self.dim, self.peak, self.wide = row["block"], row["dim"], row["peak"], row["wide"]
        self.ids, self.labels, self.rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "rows"))
        self.anchors = np.frombuffer(row["anchors"], np.bool_)
        self.vectors = np.frombuffer(row["vectors"], np.float64 if self.wide else np.float32).reshape(len(self.ids), self.dim)


def _record(number: int, ids, labels, rows, anchors, vectors) -> dict:
    order = np.lexsort((rows, ids, labels))
    return {
        "block": number, "dim": vectors.shape[1], "n": len(ids), "n_anchors": int(anchors.sum()), "peak": float(np.abs(vectors).max(initial=0.0)), "wide": vectors.dtype == np.float64,
        "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "rows": rows[order].tobytes(), "anchors": anchors[order].tobytes(), "vectors": np.ascontiguousarray(vectors[order]).tobytes(),
    }


def _records(records: list[dict]) -> pa.RecordBatch:
    schema = arrow_type(BLOCKS)
    return out_batch(schema, **{f.name: [r[f.name] for r in records] for f in schema})


class _Packer:
    """Collects rows of one vector length and gives them out in blocks."""

    def __init__(self, size: int):
        self.size, self.parts, self.held = size, {}, {}

    def put(self, key: tuple, *columns: np.ndarray) -> Iterator[tuple]:
        self.parts.setdefault(key, []).append(columns)
        self.held[key] = self.held.get(key, 0) + len(columns[0])
        if self.held[key] >= self.size:
            whole = [np.concatenate(c) for c in zip(*self.parts.pop(key))]
            full = self.held.pop(key) // self.size * self.size
            for at in range(0, full, self.size):
                yield tuple(c[at : at + self.size] for c in whole)
            if full < len(whole[0]):
                yield from self.put(key, *[c[full:] for c in whole])

    def rest(self) -> Iterator[tuple]:
        for parts in self.parts.values():
            whole = [np.concatenate(c) for c in zip(*parts)]
            if len(whole[0]):
                yield tuple(whole)


def _pack(batches: Iterator[pa.RecordBatch], scale: float, size: int) -> Iterator[pa.RecordBatch]:
    """Usable rows as blocks: vec_id, label, is_anchor, embedding come in."""
    from pyspark import TaskContext

    base, packer = TaskContext.get().partitionId() << 32, _Packer(size)
    number = seen = 0
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([c.cast(pa.int64()) if i < 2 else c for i, c in enumerate(batch.columns)], names=["vec_id", "label", "is_anchor", "embedding"])
        batch = batch.filter(pa.compute.and_(pa.compute.and_(batch["vec_id"].is_valid(), batch["label"].is_valid()), batch["embedding"].is_valid()))
        if not batch.num_rows:
            continue
        flat, sizes = batch["embedding"].flatten(), pa.compute.list_value_length(batch["embedding"]).to_numpy().astype(np.int64)
        kind = np.float32 if pa.types.is_float32(flat.type) else np.float64
        values = flat.to_numpy(zero_copy_only=False).astype(kind, copy=False)  # nulls become NaN
        starts = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = bad[starts[1:]] == bad[starts[:-1]]
        columns = [batch["vec_id"].to_numpy(), batch["label"].to_numpy(), np.asarray(batch["is_anchor"].fill_null(False).to_numpy(zero_copy_only=False), bool)]
        for dim in np.unique(sizes[good]):
            some = np.flatnonzero(good & (sizes == dim))
            taken = values[starts[some][:, None] + np.arange(dim)]
            # a single-precision number times a power of two, rounded down, is again one
            exact = kind is np.float32 and np.log2(scale).is_integer()
            whole = np.floor(taken * kind(scale)) if exact else np.floor(taken.astype(np.float64) * scale)
            if not np.isfinite(whole).all():
                whole = np.floor(taken.astype(np.float64) * scale)
            ids, labels, anchors = (c[some] for c in columns)
            rows = base + seen + np.arange(len(some))
            seen += len(some)
            for block in packer.put((int(dim), whole.dtype.str), ids, labels, rows, anchors, whole):
                yield _records([_record(base + number, *block)])
                number += 1
    for block in packer.rest():
        yield _records([_record(base + number, *block)])
        number += 1


def _anchors(batches: Iterator[pa.RecordBatch], size: int, only: bool) -> Iterator[pa.RecordBatch]:
    """The anchors of blocks, as small blocks (only) or joined to larger ones."""
    from pyspark import TaskContext

    base, packer, number = TaskContext.get().partitionId() << 32, _Packer(size), 0
    for batch in batches:
        for row in batch.to_pylist():
            b = _Block(row)
            at = b.anchors if only else slice(None)
            part = (b.ids[at], b.labels[at], b.rows[at], b.anchors[at], b.vectors[at])
            for block in [part] if only else packer.put((b.dim, b.vectors.dtype.str), *part):
                yield _records([_record(base + number, *block)])
                number += 1
    for block in packer.rest():
        yield _records([_record(base + number, *block)])
        number += 1


def _products(a: _Block, b: _Block, rows: slice, columns: slice) -> np.ndarray:
    """Inner products as 64-bit whole numbers."""
    most = a.peak * b.peak * max(a.dim, 1)
    left, right = a.vectors[rows], b.vectors[columns]
    if most < 2.0**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return left.astype(np.int64) @ right.astype(np.int64).T
    raise OverflowError("scores of these vectors do not fit into 64 bits")


class _Running:
    """The k best (score, id) for each anchor of a block and each window."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.score = np.full((anchors, windows, k), NONE, np.int64)
        self.ids = np.zeros((anchors, windows, k), np.int64)

    def merge(self, at: slice, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[at], score], axis=2), np.concatenate([self.ids[at], ids], axis=2)
        best = np.lexsort((ids, -score), axis=2)[:, :, : self.score.shape[2]]
        self.score[at], self.ids[at] = np.take_along_axis(score, best, 2), np.take_along_axis(ids, best, 2)


def _mine(batches: Iterator[pa.RecordBatch], k: int, same: bool, windows: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of each anchor and window, over all blocks of this task.

    Rows hold a block of candidates, a block of anchors (a_*), and for the second pass the bounds of its windows.
    """
    running: dict[int, tuple[_Block, _Running]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            b, a = _Block(row), _Block({c[2:]: v for c, v in row.items() if c.startswith("a_")})
            state = running.setdefault(a.number, (a, _Running(len(a.ids), windows, k)))[1]
            low, high = np.full((len(a.ids), windows), NONE, np.int64), np.full((len(a.ids), windows), -NONE, np.int64)
            if not same:
                low[:], high[:] = 1, 0  # a window that takes nothing
                for x in row["bounds"] or []:
                    low[x["anchor"], x["place"]], high[x["anchor"], x["place"]] = x["low"], x["high"]
            for at in range(0, len(a.ids), SLICE):
                rows = slice(at, min(at + SLICE, len(a.ids)))
                first, last = (np.searchsorted(b.labels, a.labels[rows][[0, -1]], side)[i] for i, side in ((0, "left"), (1, "right"))) if same else (0, len(b.ids))
                if first < last:
                    _slice(a, b, rows, slice(first, last), low[rows], high[rows], state, k, same)
    for number, (a, state) in running.items():
        anchor, place, nth = np.nonzero(state.score > NONE)
        yield out_batch(arrow_type(BEST), anchor_block=np.full(len(anchor), number), anchor=anchor, anchor_id=a.ids[anchor], place=place, score=state.score[anchor, place, nth], vec_id=state.ids[anchor, place, nth])


def _slice(a: _Block, b: _Block, rows: slice, columns: slice, low: np.ndarray, high: np.ndarray, state: _Running, k: int, same: bool) -> None:
    score = _products(a, b, rows, columns)
    # what cannot enter any window, or is worse than all that it holds, is left out before sorting
    least = np.maximum(low, state.score[rows][:, :, -1]).min(axis=1)
    fits = (score >= least[:, None]) & (score <= high.max(axis=1)[:, None])
    fits &= (a.labels[rows][:, None] == b.labels[columns]) == same
    fits &= a.rows[rows][:, None] != b.rows[columns]
    i, j = np.nonzero(fits)
    value, ids = score[i, j], b.ids[columns][j]
    order = np.lexsort((ids, -value, i))
    i, value, ids = i[order], value[order], ids[order]
    starts = np.searchsorted(i, np.arange(len(low) + 1))
    best, best_ids = np.full((*low.shape, k), NONE, np.int64), np.zeros((*low.shape, k), np.int64)
    for r in np.flatnonzero(np.diff(starts)):
        some, named = value[starts[r] : starts[r + 1]], ids[starts[r] : starts[r + 1]]
        at = np.searchsorted(-some, -high[r])[:, None] + np.arange(k)  # from the first that the window's upper bound allows
        inside = at < len(some)
        at = np.where(inside, at, 0)
        inside &= some[at] >= low[r][:, None]
        best[r], best_ids[r] = np.where(inside, some[at], NONE), np.where(inside, named[at], 0)
    state.merge(rows, best, best_ids)


def anchor_blocks(blocks: DataFrame, size: int = ANCHOR_BLOCK) -> DataFrame:
    """The anchors among blocks, packed anew (and staged: their numbers stand)."""
    some = blocks.where("n_anchors > 0")
    n = ceil((some.agg(F.sum("n_anchors")).first()[0] or 0) / size)
    small = some.mapInArrow(partial(_anchors, size=size, only=True), _ddl(BLOCKS))
    return staged(small.repartition(max(1, n), "block", "n").mapInArrow(partial(_anchors, size=size, only=False), _ddl(BLOCKS)), "anchors")


def _ddl(schema: str) -> str:
    return schema.replace(",", ", ")


def _ranked(best: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of what tasks have kept: rank from 1."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0, block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK, wave_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its best `positives` other rows of the same label; for each of these the best `negatives` rows of
    another label whose score is at least low and at most high percent of the positive's.
    """
    importable(vectors.sparkSession)
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), is_anchor.alias("is_anchor"), "embedding")
    blocks = staged(plain.mapInArrow(partial(_pack, scale=scale, size=block), _ddl(BLOCKS)), "blocks")
    anchors = anchor_blocks(blocks, anchor_block)
    stored = anchors.agg(F.sum(F.length("vectors") + 25 * F.col("n"))).first()[0] or 0
    waves = max(1, ceil(stored / wave_bytes))
    sides = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])

    def passed(sides: DataFrame, k: int, same: bool, windows: int) -> DataFrame:
        # each wave of anchors is bounded, so it can be broadcast; the candidates stay where they are
        of = [sides.where(F.pmod(F.xxhash64("a_block"), F.lit(waves)) == w) for w in range(waves)]
        met = [blocks.join(F.broadcast(one), F.col("dim") == F.col("a_dim")).mapInArrow(partial(_mine, k=k, same=same, windows=windows), _ddl(BEST)) for one in of]
        return reduce(DataFrame.unionAll, met)

    found = _ranked(passed(sides, positives, True, 1), ["anchor_block", "anchor"], positives)
    found = staged(found.select("anchor_block", "anchor", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(p * low / 100).cast("long"), F.floor(p * high / 100).cast("long")
    bounds = found.groupBy("anchor_block").agg(F.collect_list(F.struct("anchor", "place", least.alias("low"), most.alias("high"))).alias("bounds"))
    bounded = sides.join(bounds.withColumnRenamed("anchor_block", "a_block"), "a_block")
    mined = _ranked(passed(bounded, negatives, False, positives), ["anchor_block", "anchor", "place"], negatives)
    named = mined.select("anchor_block", "anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["anchor_block", "anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
