"""Helpers shared by the training-data operators: staging, Arrow batches, vectorised word hashing.

Words are maximal runs of bytes other than space and 0x09-0x0D.  These separators are single ASCII bytes, so the words
of a text and the words of its UTF-8 bytes are the same.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path, staged  # noqa: F401  the operators' staging

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = r"[^\x20\x09-\x0D]+"

U = np.uint64


BATCH_ROWS = 400


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches (texts may be long), and workers that can import this package.

    Plans are lazy, so the batch size has to stay set; it is only ever lowered, to the same value for all operators.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    importable(spark)


def importable(spark: SparkSession) -> None:
    """Workers find this package."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(docs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """The same columns in the same order; those that an operator does not need get names that cannot clash with its own."""
    return docs.toDF(*[c if c in needed else f"in_{i}" for i, c in enumerate(docs.columns)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Schemes of Hadoop file systems under the names that Arrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system and path of a path in the shared folder, as executors open it."""
    scheme, mark, rest = uri.partition(":")
    if not mark:
        return pa.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def arrow_type(schema: str) -> pa.Schema:
    """An Arrow schema from 'name type, ...' with the few types that the operators use."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(","))])


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its n + 1 borders, null as empty; no copy is made."""
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- word hashes -------------------------------------------------------------------------------------------------------

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, _SLICE + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inverse)):
            powers = np.full(size, U(base))
            powers[0] = U(1)
            _powers[key] = np.multiply.accumulate(powers)
    return _powers["p"], _powers["i"]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the batch, and the number of words before each of the n + 1 document borders."""
    inside = ~SEPARATOR[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begin[borders] = inside[borders]
    finish[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from polynomial prefix sums over slices of bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _SLICE, "right")))
        high = ends[to - 1]
        powers, inverse = _powers_to(int(high - low) + 1)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_VALUES[data[low:high]] * powers[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        at = to
    return out


def gram_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """The hash of the n words that start at each position; positions whose words run over the end are left out."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, U(seed))
    for j in range(n):
        out *= U(_BASE)
        out += words[j : j + size]
    return mix(out)


def starts_inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Which positions of the batch begin n words of one document; counts: words before each document border."""
    total = int(counts[-1])
    size = max(0, total - n + 1)
    lengths = np.diff(counts)
    left = np.repeat(counts[1:], lengths) - np.arange(total)
    return left[:size] >= n


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of span k-gram hashes, the position of its leftmost smallest.

    Whole hashes are compared, then positions, so equal runs select the same offset wherever they stand.
    """
    size = len(grams) - span + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    low, at = grams, np.arange(len(grams))
    width = 1
    while width < span:
        step = min(width, span - width)
        n = len(low) - step
        right = low[step:] < low[:n]
        low, at = np.where(right, low[step:], low[:n]), np.where(right, at[step:], at[:n])
        width += step
    return at


def doc_key(*columns: str):
    """A 64-bit key of a row from its columns, nulls told apart from values."""
    return F.xxhash64(*[c for n in columns for c in (F.col(n), F.col(n).isNull())])
