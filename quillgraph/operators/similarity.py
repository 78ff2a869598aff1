"""Edges between nodes whose embeddings are similar, within a paper and across papers.

Within a paper every ordered pair is compared, so the work follows the squares of paper sizes.  Vectors are packed into
blocks as they are stored, and a task compares two blocks with matrix products, each pair of blocks once; pairs near the
threshold are computed again in double precision.  Neither side is collected or broadcast: numbers of blocks are paired,
and then meet their vectors by equi-joins.

Across papers the pairs of blocks are dealt in tiles, squares of pairs: blocks are cut into sides of at most `SIDE_BYTES`,
a tile gets the blocks of two sides once each, holds one side and lets the other pass by.  So a block is sent as often as
there are sides, which more cores or more bytes raise, and not once for each block that it meets.

Across papers blocks are balls: vectors lie in the block of the pivot nearest to them, with a centre and a radius in
angle.  By the triangle inequality of angles two balls hold no pair that is near enough if their centres are further
apart than both radii and the threshold's angle, and such blocks are not compared.  Pivots are at most `MOST_PIVOTS` of
a bounded sample, as far apart as can be; they decide how much is compared, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip, text
from ..sources.scratch import staged

CANDIDATE_CHARS, SEMANTIC_LEAST, CROSS_LEAST = 512, 20, 30
CROSS_TYPES = ("Concept", "Claim", "TextBlock")


def semantic_candidates(nodes: DataFrame) -> DataFrame:
    long_enough = F.length(strip(text(F.col("content")))) > SEMANTIC_LEAST
    return nodes.where((F.col("node_type") != "Paper") & long_enough).withColumn("content", F.substring("content", 1, CANDIDATE_CHARS))


def cross_candidates(nodes: DataFrame) -> DataFrame:
    long_enough = F.length(strip(text(F.col("content")))) >= CROSS_LEAST
    return nodes.where(F.col("node_type").isin(*CROSS_TYPES) & long_enough).withColumn("content", F.substring("content", 1, CANDIDATE_CHARS))


def semantic_type(src: Column, dst: Column, similarity: Column) -> Column:
    return (
        F.when(dst.isin("Figure", "Table"), "ILLUSTRATES")
        .when((src == "Claim") & (dst == "Claim"), F.when(similarity > 0.85, "SUPPORTS").otherwise("COMPARES"))
        .when(dst == "Equation", "QUANTIFIES")
        .otherwise("SUPPORTS")
    )


BLOCKS = "grp string,block int,ids array<string>,papers array<string>,seqs array<bigint>,vectors binary,wide boolean"
PAIRS = "src_id string, dst_id string, similarity double, src_seq bigint, dst_seq bigint"
_SLICE, _NEAR = 1024, 1e-4


def _before(keys: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which pairs are in order by their keys, the first key that differs deciding."""
    less, equal = np.zeros(len(keys[0][0]), bool), np.ones(len(keys[0][0]), bool)
    for a, b in keys:
        less |= equal & (a < b).astype(bool)
        equal &= (a == b).astype(bool)
    return less


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    """One block: its nodes and their vectors, in the precision that they came in."""
    column = table.column("embedding").combine_chunks()
    wide = not pa.types.is_float32(column.type.value_type)
    data = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False))
    names = [[table.column(c).to_pylist()] for c in ("node_id", "paper_id", "seq")]
    strings, numbers = pa.list_(pa.string()), pa.list_(pa.int64())
    values = [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array(names[0], strings), pa.array(names[1], strings), pa.array(names[2], numbers), pa.array([data.tobytes()], pa.binary()), pa.array([wide])]
    return pa.table(values, names=[f.split()[0] for f in BLOCKS.split(",")])


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = x * 134217729.0  # 2 ** 27 + 1: each half has few enough bits for exact products
    high = high - (high - x)
    return high, x - high


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row, from the first component to the last, each product added before it is rounded.

    So does SQL's dot product where the machine multiplies and adds at once; vectors that differ only in length are near
    to another to the last bit, and rank by that bit.
    """
    x, y, out = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.zeros(len(x))
    for u, v in zip(x, y):
        product, (a, b), (c, d) = u * v, _halves(u), _halves(v)
        lost = ((a * c - product) + a * d + b * c) + b * d
        total = out + product
        part = total - out
        out = total + (((out - (total - part)) + (product - part)) + lost)
    return out


class _Block:
    def __init__(self, row: dict, prefix: str = ""):
        self.ids, self.papers = np.array(row[f"{prefix}ids"], object), np.array([x or "" for x in row[f"{prefix}papers"]], object)
        self.none, self.seqs = np.array([x is None for x in row[f"{prefix}papers"]]), np.array(row[f"{prefix}seqs"], np.int64)
        raw = np.frombuffer(row[f"{prefix}vectors"], np.float64 if row[f"{prefix}wide"] else np.float32)
        raw = raw.reshape(len(self.ids), -1).astype(np.float64)
        size = np.sqrt(_dots(raw, raw))
        self.unit = np.where(size[:, None] < 1e-9, 0.0, raw / np.maximum(size, 1e-300)[:, None])
        self.rough = self.unit.astype(np.float32)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: each holds whole blocks, of which a batch may have thousands."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _compared(a: _Block, b: _Block, least: float, per_paper: bool, order: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of two blocks whose dot product is large enough: in both orders within a paper, else the smaller by `order` first."""
    for low in range(0, len(a.ids), _SLICE):
        i, j = np.nonzero(a.rough[low : low + _SLICE] @ b.rough.T >= least - _NEAR)
        i += low
        if a is b:
            i, j = i[i < j], j[i < j]
        if not per_paper:
            apart = (a.papers[i] != b.papers[j]) | (a.none[i] != b.none[j])
            i, j = i[apart], j[apart]
        value = np.concatenate([_dots(a.unit[i[at : at + 8192]], b.unit[j[at : at + 8192]]) for at in range(0, len(i), 8192)] or [np.zeros(0)])
        i, j, value = i[value >= least], j[value >= least], value[value >= least]
        if not len(i):
            continue
        ends = [(a.ids[i], b.ids[j]), (a.seqs[i], b.seqs[j])]
        if per_paper:
            ends = [(np.concatenate([x, y]), np.concatenate([y, x])) for x, y in ends]
            value = np.concatenate([value, value])
        else:
            keys = {"seq": ends[1], "paper_id": (a.papers[i], b.papers[j]), "node_id": ends[0]}
            first = _before([keys[k] for k in order])
            ends = [(np.where(first, x, y), np.where(first, y, x)) for x, y in ends]
        (src, dst), (src_seq, dst_seq) = ends
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(value), pa.array(src_seq, pa.int64()), pa.array(dst_seq, pa.int64())], names=["src_id", "dst_id", "similarity", "src_seq", "dst_seq"])


def _products(batches: Iterator[pa.RecordBatch], least: float, per_paper: bool, order: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Pairs of the two blocks of each row.

    A block is compared with itself as it came in once: another computation of it may hold its rows in another order.
    """
    for row in _each(batches):
        a = _Block(row)
        yield from _compared(a, a if row["block"] == row["other_block"] else _Block(row, "other_"), least, per_paper, order)


def _tiles(batches: Iterator[pa.RecordBatch], least: float, order: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Pairs of different papers in tiles, one after another: the blocks of one side come first and are held, each of the other meets its partners."""
    tile, held = None, {}
    for row in _each(batches):
        if row["tile"] != tile:
            tile, held = row["tile"], {}
        if not row["meets"]:
            held[row["block"]] = _Block(row)
            continue
        b = held.get(row["block"]) or _Block(row)  # both sides of a tile may be the same
        for partner in row["partners"]:
            yield from _compared(held[partner], b, least, False, order)


#: Total orders of nodes: seq of the whole corpus, or paper after paper (seq is a place within the paper).
BY_SEQ, BY_PAPER = ("seq", "paper_id", "node_id"), ("paper_id", "seq", "node_id")


MOST_PIVOTS, SAMPLE, _CENTRES = 1024, 8192, 512
BALLS = "chunk int,blocks binary,centres binary,radii binary"


def _units(column: pa.Array) -> np.ndarray:
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    size = np.sqrt((raw * raw).sum(axis=1))
    return np.where(size[:, None] < 1e-9, 0.0, raw / np.maximum(size, 1e-300)[:, None])


def _pivots(rows: DataFrame, most: int) -> np.ndarray:
    """Up to `most` vectors of a sample of at most SAMPLE, each as far as can be from those before it."""
    sample = rows.orderBy(F.xxhash64("node_id"), "node_id").select("embedding").limit(min(SAMPLE, 8 * most)).toArrow().column("embedding").combine_chunks()
    if not len(sample):
        return np.zeros((0, 0))
    unit = _units(sample)
    unit = unit[unit.any(axis=1)] if unit.any() else unit[:1]  # vectors of zeros have no direction
    near, chosen = unit @ unit[0], [0]
    while len(chosen) < min(most, len(unit)):
        near[chosen[-1]] = np.inf
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def _assigned(batches: Iterator[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot's number as `ball`."""
    for batch in batches:
        at = batch.schema.get_field_index("embedding")
        nearest = (_units(batch.column(at)) @ pivots.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
        yield batch.append_column("ball", pa.array(nearest, pa.int32()))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The centre and radius of each block, many to a row."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 16, []

    def row() -> pa.RecordBatch:
        blocks, centres, radii = zip(*held)
        values = [np.array(blocks, np.int32).tobytes(), np.array(centres, np.float64).tobytes(), np.array(radii, np.float64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=[f.split()[0] for f in BALLS.split(",")])

    for r in _each(batches):
        unit = _Block(r | {"papers": r["ids"], "seqs": [0] * len(r["ids"])}).unit
        centre = unit.sum(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-9 else centre
        away = np.arccos(np.clip(unit @ centre, -1.0, 1.0)).max() if size > 1e-9 else np.pi
        held.append((r["block"], centre, away))
        if len(held) == _CENTRES:
            yield row()
            number, held = number + 1, []
    if held:
        yield row()


def _near_blocks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of blocks, the smaller number first, whose balls may hold pairs that are near enough."""
    limit = np.arccos(np.clip(least, -1.0, 1.0)) + 1e-6
    for batch in batches:
        for r in batch.to_pylist():
            (n, c, a), (m, d, b) = ((np.frombuffer(r[f"{p}blocks"], np.int32), np.frombuffer(r[f"{p}centres"], np.float64), np.frombuffer(r[f"{p}radii"], np.float64)) for p in ("", "other_"))
            angle = np.arccos(np.clip(c.reshape(len(n), -1) @ d.reshape(len(m), -1).T, -1.0, 1.0))
            i, j = np.nonzero(~(angle - a[:, None] - b[None, :] > limit) | (n[:, None] == m))
            i, j = (i[n[i] <= m[j]], j[n[i] <= m[j]]) if r["chunk"] == r["other_chunk"] else (i, j)
            x, y = n[i], m[j]
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(x), pa.string()), pa.array(np.minimum(x, y), pa.int32()), pa.array(np.maximum(x, y), pa.int32())], names=["grp", "block", "other_block"])


def in_balls(rows: DataFrame, block: int) -> DataFrame:
    """Rows with their block: the ball of the nearest pivot, or a part of it where it has more than `block` rows."""
    spark = rows.sparkSession
    pivots = spark.sparkContext.broadcast(_pivots(rows, max(1, min(MOST_PIVOTS, -(-rows.count() // block)))))  # bounded by MOST_PIVOTS
    placed = rows.mapInArrow(partial(_assigned, pivots=pivots), rows.withColumn("ball", F.lit(0)).schema)
    sizes = placed.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))  # a row for each pivot
    first = F.sum("parts").over(Window.orderBy("ball").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("first", F.coalesce(first, F.lit(0)).cast("int"))
    return placed.join(F.broadcast(sizes), "ball").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node_id"), F.col("parts"))).cast("int")).drop("ball", "parts", "first")


def near_blocks(packed: DataFrame, least: float) -> DataFrame:
    """grp, block and other_block: the pairs of blocks that have to be compared (each block with itself too)."""
    balls = staged(packed.select("block", "ids", "vectors", "wide").mapInArrow(_balls, BALLS), "balls")
    other = balls.select(*[F.col(c).alias(f"other_{c}") for c in balls.columns])
    chunks = balls.select("chunk").join(balls.select(F.col("chunk").alias("other_chunk")), F.col("chunk") <= F.col("other_chunk"))  # numbers only, a row for many blocks
    met = chunks.join(balls, "chunk").join(other, "other_chunk")
    return met.mapInArrow(partial(_near_blocks, least=least), "grp string, block int, other_block int")


SIDE_BYTES, _TILES_PER_CORE, _LEAST_CORES = 32 << 20, 4, 8


def in_tiles(packed: DataFrame, numbers: DataFrame) -> DataFrame:
    """Blocks (block, ...) dealt by the tiles of their pairs (block, other_block), a tile to a partition.

    A row is a block of the side that is held, or one that meets its partners there; those that are held come first.
    There are as many sides as cores need to share the tiles, and more if a side would exceed SIDE_BYTES of vectors.
    """
    longest, last = packed.agg(F.max(F.length("vectors")), F.max("block")).first()
    blocks, cores = (last or 0) + 1, max(_LEAST_CORES, packed.sparkSession.sparkContext.defaultParallelism)
    enough = math.ceil((math.sqrt(8 * _TILES_PER_CORE * cores + 1) - 1) / 2)
    sides = min(blocks, max(enough, -(-blocks * (longest or 0) // SIDE_BYTES)))
    a, b = (F.floor(F.col(c).cast("bigint") * sides / blocks) for c in ("block", "other_block"))
    apart = sides * (sides - 1) // 2  # tiles of two sides have the smaller numbers, as they take longest
    tile = F.when(a < b, (b * (b - 1) / 2).cast("bigint") + a).otherwise(apart + a).cast("int").alias("tile")
    ends = F.array(
        F.struct(F.col("block").alias("block"), F.lit(None).cast("int").alias("partner")),
        F.struct(F.col("other_block").alias("block"), F.col("block").alias("partner")),
    )
    sent = numbers.select(tile, F.explode(ends).alias("end")).select("tile", "end.*")
    sent = sent.groupBy("tile", "block", F.col("partner").isNotNull().alias("meets")).agg(F.collect_list("partner").alias("partners"))
    return sent.join(packed, "block").repartitionById(apart + sides, F.col("tile")).sortWithinPartitions("tile", "meets", "block")


def similar_pairs(vectors: DataFrame, least: float, per_paper: bool, block: int | None = None, order: tuple[str, ...] = BY_SEQ) -> DataFrame:
    """Pairs of vectors (node_id, paper_id, seq, embedding) with a cosine of at least `least`.

    per_paper: ordered pairs within each paper (nodes without one have none); otherwise pairs of different papers, each once, the smaller by `order` first.
    """
    block = block or (8192 if per_paper else 1024)
    group = F.col("paper_id") if per_paper else F.lit("")
    rows = vectors.where(F.col("embedding").isNotNull() & group.isNotNull()).select("node_id", "paper_id", F.col("seq").cast("bigint").alias("seq"), "embedding", group.alias("grp"))
    if not per_paper:
        packed = staged(in_balls(rows, block).groupBy("grp", "block").applyInArrow(_packed, BLOCKS), "balls")
        return in_tiles(packed, near_blocks(packed, least)).mapInArrow(partial(_tiles, least=least, order=order), PAIRS)
    blocks = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    rows = rows.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int")).drop("blocks")
    own = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    numbers = blocks.select("grp", "blocks", own).select("grp", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other_block"))
    packed = rows.groupBy("grp", "block").applyInArrow(_packed, BLOCKS)
    other = packed.select("grp", F.col("block").alias("other_block"), *[F.col(c).alias(f"other_{c}") for c in packed.columns[2:]])
    met = numbers.join(packed, ["grp", "block"]).join(other, ["grp", "other_block"])
    return met.mapInArrow(partial(_products, least=least, per_paper=True, order=order), PAIRS)


def semantic_edges(nodes: DataFrame, threshold: float = 0.75, top_k: int = 10) -> DataFrame:
    """For each node of a paper its most similar others (nodes with an embedding); ties go to the later node."""
    pairs = similar_pairs(nodes, threshold, per_paper=True)
    rank = F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("similarity"), F.desc("dst_seq")))
    types = nodes.select("node_id", "node_type")
    typed = pairs.withColumn("rank", rank).where(F.col("rank") <= top_k)
    typed = typed.join(types.select(F.col("node_id").alias("src_id"), F.col("node_type").alias("src_type")), "src_id").join(types.select(F.col("node_id").alias("dst_id"), F.col("node_type").alias("dst_type")), "dst_id")
    weight = F.round("similarity", 4)
    return typed.select("src_id", "dst_id", semantic_type(F.col("src_type"), F.col("dst_type"), F.col("similarity")).alias("edge_type"), weight.alias("weight"), weight.alias("confidence"), F.lit("embedding").alias("method"), F.lit(None).cast("string").alias("evidence"), F.col("src_seq").alias("seq"))


def cross_document_edges(nodes: DataFrame, threshold: float = 0.85, order: tuple[str, ...] = BY_SEQ) -> DataFrame:
    weight = F.round("similarity", 4)
    return similar_pairs(nodes, threshold, per_paper=False, order=order).select("src_id", "dst_id", F.lit("SAME_CONCEPT").alias("edge_type"), weight.alias("weight"), weight.alias("confidence"), F.lit("crossdoc_embedding").alias("method"), F.lit(None).cast("string").alias("evidence"), F.col("src_seq").alias("seq"))
