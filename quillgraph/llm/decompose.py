"""Power-of-two decomposition: documents of tokens become pieces of binary lengths, and pieces of one length share a bucket.

A document of n tokens is cut into as many whole sequences as it holds and, for the rest, one piece for each one bit of
its length, the longest first; so every piece begins at a multiple of its own length.  Each piece is a sequence of its
own: none crosses documents and, as its length is a power of two, none is padded.  Sequences of one length lie in one
bucket, are numbered without gaps there, and are batched so that every batch of every bucket has the same number of
tokens (but the last of a bucket).

Numbers come from counts by task and length, whose prefix sums tell where a task's pieces begin in a bucket; tokens
never leave the task that has made them, and only counts are shuffled and summed.

Defined results: a null text is an empty one (end token only); repeated rows are cut once each; an empty table gives an
empty result; other columns of the input are ignored; documents of any length are cut as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_type, out_batch, prepare, staged, texts_of
from .packing import MAX_TOKENS, tokenizer

END_ID = 2
#: Tokens of a batch: so many sequences of the greatest length, or as many more of a shorter one.
BATCH_TOKENS = 8 * MAX_TOKENS
PIECES = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,task int,own long"


def binary_lengths(n: int, most: int) -> list[int]:
    """Lengths that add up to n: as often `most` (a power of two) as it fits, then the powers of two of the rest, falling."""
    rest = n % most
    return [most] * (n // most) + [1 << bit for bit in range(most.bit_length() - 1, -1, -1) if rest >> bit & 1]


def _cut(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema, tokens, task = arrow_type(PIECES), tokenizer(path), TaskContext.get().partitionId()
    end = np.asarray([end_id], "<u4").tobytes()
    seen = dict.fromkeys((1 << bit for bit in range(most.bit_length())), 0)
    for batch in batches:
        out = {f.name: [] for f in schema}
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            raw = tokens.ids(text) + end
            n, start = len(raw) // 4, 0
            for length in binary_lengths(n, most):
                values = (doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, task, seen[length])
                for column, value in zip(out.values(), values):
                    column.append(value)
                seen[length] += 1
                start += length
        yield out_batch(schema, **out)


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, and its task and place among that task's pieces of its length."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("the greatest length has to be a power of two")
    prepare(docs.sparkSession)
    cut = partial(_cut, path=vocabulary, most=max_tokens, end_id=end_id)
    return staged(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


def bucketed(cut: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Pieces (staged) with place (from 0 in the bucket of their length), batch, sequence_id and offset (always 0)."""
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    begins = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    out = cut.join(begins, ["length", "task"]).withColumn("place", F.col("begin") + F.col("own"))
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    exponent = F.floor(F.log2(F.col("length").cast("double")) + 0.5).cast("long")
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(exponent, 48) + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.floor(F.col("place") / each).alias("batch"),
    )


def decompose_documents(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Tokenises documents and cuts them: a row per piece with its sequence, bucket (its length) and batch."""
    return bucketed(pieces(docs, vocabulary, max_tokens, end_id), batch_tokens)
