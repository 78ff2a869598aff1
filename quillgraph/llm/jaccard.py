"""n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (fewer than five words: one shingle of all words).  Equal sets are one node of
a graph.  Links are the pairs of nodes with a Jaccard similarity of at least the threshold.

1. MinHash values in bands propose candidates: two sets that share a band.  A band's bucket of any size only adds a star
   (each node and the bucket's smallest), and the connected components of all stars hold every candidate pair.
2. Components of up to `most_blocks` blocks (of about 256 sets or 250,000 shingles, by a hash) are compared as they
   are, each set with all others of its component: a set is sent once for each block.  Larger components are either one
   huge group of copies or many texts chained by chance, so there only pairs that share a band are compared, each in the
   first band that they share; a band's bucket is again cut into blocks.  Texts are read again, and only rows that a
   fixed-size bit map of the members lets through are shuffled.
3. A unit of work is a pair of blocks, with the shingles of both.  In a unit MinHash values are compared a few at a time;
   after each step a pair is dropped if, with a uniform prior, the posterior probability that its similarity reaches the
   threshold is below the tolerance.  All others are verified exactly.  Units give link counts for each node and a
   spanning forest, never the pairs.
4. The components of the forests are the classes.

A true pair is missed only if it shares no band (a chance of 3e-6 at a similarity of 0.8 with 42 bands of 6), or by the
tolerance.  A node is named by 128 bits of hashes of its set; components of candidates use 64 of them, where two sets
with one name would only be compared once more.

Defined results: a document without words (null or empty text) has no links and is its own class; class_id is the
smallest doc_id of a class (null if it has none); copies count as links of each other; rows that are repeated are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import U, arrow_type, doc_key, gram_hashes, mix, out_batch, own_names, prepare, shuffle_partitions, staged, utf8_of, word_hashes, words_of
from .substring import MOST_BITS, SLICE_BITS, cells_of, marked

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
TOLERANCE = 1e-9
_STEP = 28
_LEFT = 256
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_A, _B = (_SEEDS[: BANDS * ROWS] >> U(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[BANDS * ROWS :] >> U(32)).astype(np.uint32)
NODES = "id long,key long,node long,size long"
HEAVY, PIECES = 256, 100_000
SHINGLES = "id long,key long,shingles binary"
LINKS = "node long,other long,root long,root_other long,links long,texts long,whole boolean"


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text of a batch."""
    data, offsets = utf8_of(column)
    starts, ends, counts = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    out = []
    for low, high in zip(counts[:-1].tolist(), counts[1:].tolist()):
        n = high - low
        out.append(np.unique(grams[low : high - k + 1]) if n >= k else gram_hashes(words[low:high], n, seed=n + 1) if n else grams[:0])
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set, in slices of bounded size."""
    x = (mix(shingles) >> U(32)).astype(np.uint32)
    out = np.full(len(_A), np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        values = x[at : at + 1024, None] * _A
        values += _B
        np.minimum(out, values.min(axis=0), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        keys = mix(keys * U(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*arrow_type(NODES), pa.field("other", pa.int64()), pa.field("bands", pa.list_(pa.int64()))])
    for batch in batches:
        sets = shingle_sets(batch.column(2))
        full = [len(s) > 0 for s in sets]
        node = [int(mix(s.sum(keepdims=True) + U(len(s))).view(np.int64)[0]) if f else None for s, f in zip(sets, full)]
        other = [int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if f else None for s, f in zip(sets, full)]
        bands = [band_keys(minhash(s)) if f else None for s, f in zip(sets, full)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(other, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)


def with_smallest(rows: DataFrame, n: int) -> DataFrame:
    """Rows (a, b) with m, the smallest b of each a, where n is the number of rows.

    Nodes of more than HEAVY rows (and more than a PIECES-th of all) are dealt to several tasks.  There are at most
    PIECES of them, so their list fits a plan.
    """
    heavy = max(HEAVY, n // PIECES)
    counted = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = [tuple(r) for r in counted.where(F.col("n") > heavy).select(F.xxhash64("a"), "n").collect()]
    smallest = counted.drop("n")
    if not hubs:
        return rows.join(smallest, "a")
    parts = -(-max(k for _, k in hubs) // heavy)
    is_hub = F.xxhash64("a").isin([h for h, _ in hubs])
    dealt = rows.withColumn("part", F.when(is_hub, F.pmod(F.xxhash64("b"), F.lit(parts))).otherwise(0).cast("int"))
    spread = smallest.withColumn("part", F.explode(F.when(is_hub, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, ["a", "part"]).drop("part")


def _values(column: pa.Array) -> np.ndarray:
    """Node names as values that NumPy can sort: numbers, or records of a struct's fields."""
    if not pa.types.is_struct(column.type):
        return column.to_numpy(zero_copy_only=False)
    parts = [f.to_numpy(zero_copy_only=False) for f in column.flatten()]
    out = np.empty(len(column), [(f"f{i}", np.int64) for i in range(len(parts))])
    for i, x in enumerate(parts):
        out[f"f{i}"] = x
    return out


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of stars with the same components: each node but the smallest, and the smallest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(names))
    while True:
        low = np.minimum(up[x], up[y])
        before = up.copy()
        for side in (x, y):
            np.minimum.at(up, before[side], low)
            np.minimum.at(up, side, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        if np.array_equal(up, before):
            break
    child = np.flatnonzero(up != np.arange(len(names)))
    return names[child], names[up[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars, a bounded number of edges at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out():
        table = pa.Table.from_batches(held).combine_chunks()
        columns = []
        for values, field in zip(stars_of(*(_values(c.combine_chunks()) for c in table.columns)), table.schema):
            parts = [values] if values.dtype.names is None else [values[n] for n in values.dtype.names]
            columns.append(pa.array(parts[0], field.type) if values.dtype.names is None else pa.StructArray.from_arrays([pa.array(x) for x in parts], fields=list(field.type)))
        return pa.RecordBatch.from_arrays(columns, schema=table.schema)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 2_000_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def components(edges: DataFrame, name: str) -> DataFrame:
    """The connected components of edges (a, b): node and root, the smallest node, for each node that has an edge.

    Large-star and small-star steps in turn; each task makes stars of its own edges before they are written out, which
    leaves few steps.  The edges are summed up as they are written, and the end is reached when they stay as they are: a
    star per component.
    """
    edges = edges.select("a", "b")

    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        rows = rows.distinct().mapInArrow(_contract, edges.schema)
        summed = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        out = staged(rows.observe(seen, *summed), name)
        return out, (seen.get["n"], seen.get["sum"])

    now, state = written(edges.where("a <> b"))
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_smallest(both, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before = state
        now, state = written(small.where("a <> b"))
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _cells_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit-map cells of row keys, by slice."""
    schema = arrow_type("slice int,cells binary")
    for batch in batches:
        cells = np.unique(cells_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).ravel())
        if len(cells):
            parts = np.split(cells, np.flatnonzero(np.diff(cells >> np.uint32(SLICE_BITS))) + 1)
            yield out_batch(schema, slice=[int(p[0]) >> SLICE_BITS for p in parts], cells=[p.tobytes() for p in parts])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's cells (sorted by slice) as bits."""
    schema = arrow_type("slice int,bits binary")
    now, held = None, np.zeros(1 << SLICE_BITS, bool)
    for batch in batches:
        for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if number != now:
                if now is not None:
                    yield out_batch(schema, slice=[now], bits=[np.packbits(held).tobytes()])
                now = number
                held[:] = False
            held[np.frombuffer(cells, np.uint32) & np.uint32((1 << SLICE_BITS) - 1)] = True
    if now is not None:
        yield out_batch(schema, slice=[now], bits=[np.packbits(held).tobytes()])


def key_map(keys: DataFrame) -> Broadcast:
    """A broadcast bit map of a column of row keys: 32 MB at any size; it lets through all of them and few others."""
    cells = keys.mapInArrow(_cells_of_keys, "slice int, cells binary")
    merged = cells.repartition(F.col("slice")).sortWithinPartitions("slice").mapInArrow(_slices, "slice int, bits binary")
    bits = np.zeros(1 << (MOST_BITS - 3), np.uint8)
    width = 1 << (SLICE_BITS - 3)
    for number, data in merged.collect():
        bits[number * width : (number + 1) * width] = np.frombuffer(data, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _shingle_rows(batches: Iterator[pa.RecordBatch], keys: Broadcast) -> Iterator[pa.RecordBatch]:
    """The shingles of the rows whose key the map lets through."""
    schema = arrow_type(SHINGLES)
    for batch in batches:
        batch = batch.filter(pa.array(marked(keys.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
        if batch.num_rows:
            sets = [s.tobytes() for s in shingle_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], schema=schema)


@lru_cache
def least_matches(threshold: Fraction, tolerance: float, step: int, total: int) -> tuple[int, ...]:
    """For n = step, 2 step, ... compared values, the matches below which a pair is dropped.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and the probability that it is at
    least t is that of at most m successes in n + 1 trials of chance t.
    """
    out, t = [], float(threshold)
    for n in range(step, total + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: Fraction, tolerance: float, bands: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of left, the members of right (after it, if they are the same) whose similarity reaches the threshold.

    bands: the keys of each member's earlier bands; pairs that share one of them are left to that band.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    signatures = np.zeros((len(sets), len(_A)), np.uint32)
    known = np.zeros(len(sets), bool)
    for at in range(0, len(left), _LEFT):
        yield from _linked(sets, sizes, signatures, known, left[at : at + _LEFT], right, left is right, threshold, tolerance, bands)


def _linked(sets, sizes, signatures, known, left, right, same, threshold, tolerance, bands) -> Iterator[tuple[int, np.ndarray]]:
    small, large = np.minimum(sizes[left][:, None], sizes[right]), np.maximum(sizes[left][:, None], sizes[right])
    alive = small * threshold.denominator >= large * threshold.numerator
    if same:
        alive &= left[:, None] < right
    i, j = np.nonzero(alive)
    if bands is not None and bands.shape[1] and len(i):
        new = np.concatenate([~(bands[left[i[at : at + 65536]]] == bands[right[j[at : at + 65536]]]).any(axis=1) for at in range(0, len(i), 65536)])
        i, j = i[new], j[new]
    if not len(i):
        return
    used = np.unique(np.concatenate([left[i], right[j]]))
    for n in used[~known[used]].tolist():
        signatures[n] = minhash(sets[n])
    known[used] = True
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches(threshold, tolerance, _STEP, len(_A))):
        part = slice(k * _STEP, (k + 1) * _STEP)
        for at in range(0, len(i), 65536):
            some = slice(at, at + 65536)
            matches[some] += (signatures[left[i[some]], part] == signatures[right[j[some]], part]).sum(axis=1)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            return
    # exact: the sets in local numbers, one member of left marked at a time
    used = np.unique(np.concatenate([left[i], right[j]]))
    _, numbers = np.unique(np.concatenate([sets[n] for n in used.tolist()]), return_inverse=True)
    local = dict(zip(used.tolist(), np.split(numbers, np.cumsum(sizes[used])[:-1])))
    flags = np.zeros(int(numbers.max()) + 1, bool)
    cuts = np.flatnonzero(np.diff(i)) + 1
    for rows, others in zip(np.split(i, cuts), np.split(j, cuts)):
        own, others = int(left[rows[0]]), right[others]
        flags[local[own]] = True
        parts = [local[n] for n in others.tolist()]
        borders = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        both = np.add.reduceat(flags[np.concatenate(parts)], borders, dtype=np.int64)
        flags[local[own]] = False
        union = sizes[own] + sizes[others] - both
        hit = others[both * threshold.denominator >= union * threshold.numerator]
        if len(hit):
            yield own, hit


def _unit(table: pa.Table, threshold: Fraction, tolerance: float) -> pa.Table:
    """The links of a few whole components, or of a pair of blocks of a large one or of one of its buckets."""
    schema = arrow_type(LINKS)
    group, first, second, block, blocks, band, node, other, docs = (table.column(c).to_numpy() for c in ("cluster", "first", "second", "block", "blocks", "band", "node", "other", "docs"))
    order = np.lexsort((other, node, second, first, band, group))
    new = np.ones(len(order), bool)
    for c in (group, band, first, second):
        new[1:] &= c[order][1:] == c[order][:-1]
    starts = np.flatnonzero(~new)
    out = []
    for rows in np.split(order, starts):
        again = np.zeros(len(rows), bool)  # a row that the input repeats is one node
        again[1:] = (node[rows][1:] == node[rows][:-1]) & (other[rows][1:] == other[rows][:-1])
        rows = rows[~again]
        column = table.column("shingles").take(pa.array(rows)).to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in column]
        bands = None
        if band[rows[0]] >= 0:
            bands = np.array(table.column("bands").take(pa.array(rows)).to_pylist(), np.int64)[:, : band[rows[0]]]
        weights = docs[rows]
        if first[rows[0]] == second[rows[0]]:
            left = right = np.arange(len(rows))
        else:
            left, right = np.flatnonzero(block[rows] == first[rows[0]]), np.flatnonzero(block[rows] == second[rows[0]])
        links, texts, forest = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), Forest(len(rows))
        for own, others in linked_pairs(sets, left, right, threshold, tolerance, bands):
            links[own] += weights[others].sum()
            texts[own] += len(others)
            links[others] += weights[own]
            texts[others] += 1
            for x in others.tolist():
                forest.join(own, x)
        for x in np.flatnonzero(texts).tolist():
            root = rows[forest.find(x)]
            out.append((int(node[rows[x]]), int(other[rows[x]]), int(node[root]), int(other[root]), int(links[x]), int(texts[x]), bool(blocks[rows[0]] == 1 and bands is None)))
    return pa.Table.from_batches([out_batch(schema, **dict(zip(schema.names, zip(*out))))]) if out else schema.empty_table()


def in_blocks(rows: DataFrame, groups: list[str], block_docs: int, block_shingles: int) -> DataFrame:
    """Rows (with node, other and size) with the number of blocks of their group and their own: dealt by a hash, no task orders a group."""
    weight = F.lit(1.0 / block_docs) + F.col("size") / F.lit(float(block_shingles))
    blocks = rows.groupBy(*groups).agg(F.greatest(F.lit(1), F.ceil(F.sum(weight))).cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets"))
    own = F.pmod(F.xxhash64("node", "other"), F.col("blocks")).cast("int")
    return rows.join(blocks.where("sets > 1").drop("sets"), groups).withColumn("block", own)


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_docs: int = 256, block_shingles: int = 250_000, most_blocks: int = 16
) -> DataFrame:
    """A row per document: row_key, doc_id, class_id, n_links (other documents), n_text_links (other shingle sets), first, wordless.

    row_key is a hash of doc_id and text; with doc_id it names the row.  first tells the one document of each class that
    has the smallest doc_id (and row_key); a wordless document is first in a class of its own.
    """
    spark = docs.sparkSession
    prepare(spark)
    limit = Fraction(str(threshold))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), doc_key("doc_id", "text").alias("key"), "text")
    rows = staged(keyed.mapInArrow(_nodes, NODES + ",other long,bands array<long>"), "nodes")
    full = rows.where("node is not null")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    nodes = full.groupBy("node", "other").agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("docs"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = staged(nodes.select("node", "other", "own.id", "own.key", "docs", "size", "bands"), "sets")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = banded.join(shared, "band").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    coarse = components(stars, "stars").select("node", F.col("root").alias("cluster"))

    members = in_blocks(nodes.join(coarse, "node"), ["cluster"], block_docs, block_shingles)
    members = staged(members.select("node", "other", "cluster", "block", "blocks", "docs", "size", F.col("id").alias("own_id"), F.col("key").alias("own_key"), F.when(F.col("blocks") > most_blocks, F.col("bands")).alias("bands")), "members")
    whole = members.where("bands is null").withColumn("band", F.lit(-1))
    buckets = members.where("bands is not null").drop("cluster", "block", "blocks").select("*", F.posexplode("bands").alias("band", "cluster"))
    buckets = in_blocks(buckets, ["band", "cluster"], block_docs, block_shingles).select(*whole.columns)
    dealt = whole.unionByName(buckets).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"first": F.least("block", "with"), "second": F.greatest("block", "with")}).drop("with", "size")
    few = 8 * shuffle_partitions(spark)
    alone = (F.col("blocks") == 1) & (F.col("band") < 0)
    dealt = dealt.withColumn("unit", F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(few))).otherwise(F.xxhash64("cluster", "band", "first", "second")))

    same = (F.col("id").eqNullSafe(F.col("own_id"))) & (F.col("key") == F.col("own_key"))
    sets = keyed.mapInArrow(partial(_shingle_rows, keys=key_map(members.select("own_key"))), SHINGLES)
    found = sets.join(dealt, same).drop("id", "key", "own_id", "own_key").groupBy("unit").applyInArrow(lambda table: _unit(table, limit, tolerance), LINKS)
    found = staged(found, "links")
    counts = found.groupBy("node", "other").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    named_as = lambda a, b, name: F.struct(F.col(a).alias("node"), F.col(b).alias("other")).alias(name)
    alone = found.where("whole").select("node", "other", named_as("root", "root_other", "root"))
    across = components(found.where("not whole").select(named_as("node", "other", "a"), named_as("root", "root_other", "b")), "forests").select("node.node", "node.other", "root")

    named = nodes.select("node", "other", "id", "key", "docs").join(alone.unionByName(across), ["node", "other"], "left").withColumn("root", F.coalesce("root", F.struct("node", "other")))
    smallest = named.groupBy("root").agg(F.min(own).alias("first")).select("root", F.col("first.id").alias("class_id"), F.col("first.key").alias("class_key"))
    named = named.join(smallest, "root").join(counts, ["node", "other"], "left")
    named = named.select("node", "other", "class_id", "class_key", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    joined = rows.select("id", "key", "node", "other").join(named, ["node", "other"], "left")
    alone = F.col("node").isNull()
    return joined.select(
        F.col("key").alias("row_key"), F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        (alone | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))).alias("first"), alone.alias("wordless"),
    )


def join(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, class_id, n_links, n_text_links."""
    return classes(docs, **options).drop("row_key", "first", "wordless")


def unique_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, with the input's columns, one of each class; documents without words all stay.

    Of rows that are equal in doc_id and text any one stays.  Rows are dropped as soon as they are known not to be the
    first of their class, and only names that several rows share are told apart after that.
    """
    plain = own_names(docs, ("doc_id", "text"))
    keyed = plain.select("*", doc_key("doc_id", "text").alias("key"))
    first = classes(plain, **options).where("first").groupBy(F.col("doc_id").alias("first_id"), F.col("row_key").alias("first_key"), "wordless").agg(F.count(F.lit(1)).alias("same"))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["first_id"]) & (keyed["key"] == first["first_key"]))
    once = (F.col("same") == 1) | F.col("wordless")
    several = kept.where(~once).groupBy("doc_id", "key").agg(F.any_value(F.struct(*plain.columns)).alias("row")).select("row.*")
    return kept.where(once).select(*plain.columns).unionByName(several).toDF(*docs.columns)
