"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever its low bits are all ones, so chunk borders follow the
content and survive insertions.  Each chunk gives one of 64 characters; a fingerprint is  B:S:D  with the signature S at
block size B (a chunk every B bytes on average) and D at block size 2 B.  Signatures hold at most 64 and 32 characters;
the last one covers all that remains of the text, however long.  Fingerprints are compared where block sizes agree, by
edit distance: likeness = 1 - distance / length of the longer signature.

Neighbours in the order of doc_id come from one range shuffle: each sorted partition is streamed with a look-ahead of
one row, and only the first and last row of each partition are matched afterwards.

Defined results: a null text is an empty one, whose fingerprint is "4::"; equal fingerprints have likeness 1,
incompatible block sizes 0; a null doc_id comes last, rows with equal doc_id are ordered by a hash of their texts; a
table of one row has itself as its next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_type, mix, prepare, shuffle_partitions, staged, texts_of

LEAST_BLOCK, LONGEST = 4, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
W = np.uint32
_VALUES = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_P1, _P2, _P4 = (W(pow(0x9E3779B1, k, 1 << 32)) for k in (1, 2, 4))


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[by:] = x[:-by] if len(x) > by else x[:0]
    return out


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at each byte, by doubling the window: 1, 2, 3, 4, then 7."""
    one = _VALUES[data]
    two = one + _P1 * _shifted(one, 1)
    three = two + _P2 * _shifted(one, 2)
    four = two + _P2 * _shifted(two, 2)
    seven = four + _P4 * _shifted(three, 4)
    seven ^= seven >> W(15)
    seven *= W(0x2C1B3C6D)
    return seven ^ (seven >> W(13))


def _signature(hashes: np.ndarray, ends: np.ndarray, longest: int) -> str:
    starts = np.concatenate(([0], ends[: longest - 1] + 1))
    if starts[-1] >= len(hashes):
        starts = starts[:-1]
    sums = np.add.reduceat(hashes * W(0x297A2D39), starts, dtype=np.uint32)
    return ALPHABET[(sums * W(0x85EBCA6B)) >> W(26)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    block = LEAST_BLOCK
    if not len(data):
        return f"{block}::"
    while block * LONGEST < len(data):
        block *= 2
    hashes = rolling(data)
    # borders of larger blocks are among those of smaller ones
    low = max(LEAST_BLOCK, block // 16)
    ends = np.flatnonzero((hashes & W(low - 1)) == W(low - 1))
    marks = hashes[ends]
    while True:
        if block < low:
            low = block
            ends = np.flatnonzero((hashes & W(low - 1)) == W(low - 1))
            marks = hashes[ends]
        own = ends[(marks & W(block - 1)) == W(block - 1)]
        if len(own) >= LONGEST // 2 - 1 or block == LEAST_BLOCK:
            break
        block //= 2
    double = ends[(marks & W(2 * block - 1)) == W(2 * block - 1)]
    return f"{block}:{_signature(hashes, own, LONGEST)}:{_signature(hashes, double, LONGEST // 2)}"


def _close(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints; signatures are compared at equal block sizes only."""
    x, y = F.split(a, ":"), F.split(b, ":")
    size_x, size_y = x[0].cast("long"), y[0].cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when(size_x == size_y, F.greatest(_close(x[1], y[1]), _close(x[2], y[2])))
        .when(size_x == 2 * size_y, _close(x[1], y[2]))
        .when(size_y == 2 * size_x, _close(x[2], y[1]))
        .otherwise(F.lit(0.0))
    )


def edited(text: str, following: str) -> str:
    """The text whose last half of code points is replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCAN = "kind int,part int,doc_id long,n_chars long,edited_sha256 string,fingerprint string,edited_fingerprint string,next_fingerprint string,text string"
DONE, FIRST, LAST = 0, 1, 2


def _edit(doc, text: str, own: str, following: str, its: str) -> dict:
    new = edited(text, following)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return {"doc_id": doc, "n_chars": len(text), "edited_sha256": sha, "fingerprint": own, "edited_fingerprint": fingerprint(new), "next_fingerprint": its}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a sorted partition; its first and last rows keep their texts."""
    from pyspark import TaskContext

    schema, part = arrow_type(SCAN), TaskContext.get().partitionId()
    before = None
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            own = fingerprint(text)
            if before is None:
                rows.append({"kind": FIRST, "part": part, "text": text, "fingerprint": own})
            else:
                rows.append({"kind": DONE} | _edit(*before, text, own))
            before = (doc, text, own)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if before is not None:
        yield pa.RecordBatch.from_pylist([{"kind": LAST, "part": part, "doc_id": before[0], "text": before[1], "fingerprint": before[2]}], schema=schema)


def _join_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_type(SCAN)
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_edit(*row) for row in zip(*(c.to_pylist() for c in batch.columns))], schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    prepare(spark)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    sorted_ = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    scanned = staged(sorted_.mapInArrow(_scan, SCAN), "fingerprints")
    first = scanned.where(F.col("kind") == FIRST)
    parts = first.select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    parts = parts.select("part", following.alias("next_part"))
    heads = first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = scanned.where(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint")
    borders = last.join(parts, "part").join(heads, "next_part")
    joined = borders.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_join_borders, SCAN)
    rows = scanned.where(F.col("kind") == DONE).unionByName(joined)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
