"""Substring dedup: words in windows of 35 words that start more than once are removed; a count-min sketch filters first.

1. Sketch.  Each window of 35 words is represented by its anchor, the 8-word gram in it with the smallest hash
   (leftmost of equal ones).  Equal windows have equal anchors at equal offsets, so an anchor's count is never below
   the count of any of its windows, and there are about a fourteenth as many anchors as windows.  The sketch has two
   rows of 2**27 cells; a count is estimated by the smaller of its two cells.  Tasks sketch the anchors they select,
   partition sketches are merged slice by slice, and cells counted twice or more form a bit map of 32 MB at any size of
   the input, which is broadcast.  A fuller sketch only lets more windows through, it loses none.
2. Exact grouping.  Windows whose anchor is estimated repeated are grouped by a 96-bit hash of their words.  Tasks
   pre-aggregate: a window that a task sees twice is settled there and sent on once, so a passage that a third of all
   documents share costs one entry for each task.  Buckets answer to the documents' buckets, and there the words go.

Defined results: a null text has no words and gives the digest of the empty string; texts of fewer than 35 words lose
nothing; repeated rows are documents of their own, so they lose all windows; rows are told apart by doc_id and a hash
of their text, and null ids are told from others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, anchors, arrow_type, doc_key, gram_hashes, mix, out_batch, own_names, prepare, shuffle_partitions, starts_inside, utf8_of, word_hashes, words_of

WINDOW, GRAM = 35, 8
MOST_BITS = 28
SLICE_BITS = 20
_SALTS = (0x5851F42D4C957F2D, 0xC2B2AE3D27D4EB4F)
SKETCH = "slice int,words long,cells binary"
BUCKET = "bucket int,settled boolean,entries binary"
REPLY = "home int,entries binary"
#: Of a window that may be repeated: two parts of its hash, its document's two key parts and its place.
ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8"), ("key", "<i8"), ("at", "<u4")])
PLACE = np.dtype([("id", "<i8"), ("key", "<i8"), ("at", "<u4")])
_FLUSH = 400_000


def columns_of(entries: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(entries[n]).tobytes() for n in entries.dtype.names)


def from_columns(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(data) // kind.itemsize, 0
    out = np.empty(n, kind)
    for name in kind.names:
        out[name] = np.frombuffer(data, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


class Windows:
    """The windows of a batch of documents: their anchors' grams, and which positions begin one."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        data, offsets = utf8_of(column)
        starts, ends, self.counts = words_of(data, offsets)
        self.words = word_hashes(data, starts, ends)
        self.window, self.gram = window, gram
        grams = gram_hashes(self.words, gram)
        self.at = np.flatnonzero(starts_inside(self.counts, window))
        self.anchor = anchors(grams, window - gram + 1)[self.at] if len(self.at) else self.at
        self.grams = grams

    def selected(self) -> np.ndarray:
        """The hashes of the selected anchors, once for each place."""
        if not len(self.anchor):
            return np.zeros(0, np.uint64)
        new = np.ones(len(self.anchor), bool)
        new[1:] = self.anchor[1:] != self.anchor[:-1]
        return self.grams[self.anchor[new]]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the words of the windows at these places."""
        a, b = np.full(len(at), U(3)), np.full(len(at), U(7))
        for j in range(self.window):
            w = self.words[at + j]
            a = a * U(0x9E3779B97F4A7C15) + w
            b = b * U(0xC2B2AE3D27D4EB4F) + (w ^ (w >> U(32)))
        return mix(a), (mix(b) >> U(32)).astype(np.uint32)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """The cell of each hash in each of the two rows; anchors are minima, so their hashes are mixed once more."""
    half = 1 << (MOST_BITS - 1)
    rows = [(mix(hashes ^ U(salt)) >> U(65 - MOST_BITS)).astype(np.uint32) + np.uint32(row * half) for row, salt in enumerate(_SALTS)]
    return np.stack(rows)


def _sketch(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A task's sketch, sparse, at full width: its cells, those counted more than once listed twice."""
    schema = arrow_type(SKETCH)
    held: list[np.ndarray] = []
    size = words = 0

    def out():
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        cells = np.sort(np.concatenate([cells, cells[n > 1]]))
        slices = cells >> np.uint32(SLICE_BITS)
        cuts = np.flatnonzero(np.diff(slices)) + 1
        parts = np.split(cells, cuts)
        return out_batch(schema, slice=[int(p[0]) >> SLICE_BITS for p in parts], words=[words, *[0] * (len(parts) - 1)], cells=[p.tobytes() for p in parts])

    for batch in batches:
        got = Windows(batch.column(0), window, gram)
        words += int(got.counts[-1])
        held.append(cells_of(got.selected()).ravel())
        size += len(held[-1])
        if size > 1_000_000:
            yield out()
            held, size, words = [], 0, 0
    if size:
        yield out()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the slices of a partition (sorted by slice); gives the bits of cells counted twice or more, and as slice -1 the words."""
    schema = arrow_type("slice int,bits binary")
    now, counts, words = None, np.zeros(1 << SLICE_BITS, np.uint8), 0
    for batch in batches:
        words += sum(batch.column(1).to_pylist())
        for number, cells in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if number != now:
                if now is not None:
                    yield out_batch(schema, slice=[now], bits=[np.packbits(counts > 1).tobytes()])
                now = number
                counts[:] = 0
            cells, n = np.unique(np.frombuffer(cells, np.uint32) & np.uint32((1 << SLICE_BITS) - 1), return_counts=True)
            counts[cells] = np.minimum(counts[cells] + n, 2)
    if now is not None:
        yield out_batch(schema, slice=[now, -1], bits=[np.packbits(counts > 1).tobytes(), words.to_bytes(8, "little")])


def repeated_anchors(docs: DataFrame, window: int, gram: int) -> tuple[Broadcast, int]:
    """The broadcast bit map of the sketch's cells that are counted at least twice (32 MB at any size of the input), and the number of words."""
    cells = docs.select("text").mapInArrow(partial(_sketch, window=window, gram=gram), SKETCH)
    merged = cells.repartition(F.col("slice")).sortWithinPartitions("slice").mapInArrow(_merge, "slice int, bits binary")
    bits = np.zeros(1 << (MOST_BITS - 3), np.uint8)
    width, words = 1 << (SLICE_BITS - 3), 0
    for number, data in merged.collect():
        if number < 0:
            words += int.from_bytes(data, "little")
        else:
            bits[number * width : (number + 1) * width] = np.frombuffer(data, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits), words


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have a bit in both rows."""
    cells = cells_of(hashes)
    return ((bits[cells >> np.uint32(3)] >> (np.uint8(7) - (cells & np.uint32(7)).astype(np.uint8))) & np.uint8(1)).all(axis=0)


def _candidates(batches: Iterator[pa.RecordBatch], sketch: Broadcast, window: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows that may be repeated, by bucket of their hash; those repeated here go by their document, settled."""
    schema = arrow_type(BUCKET)
    held: list[np.ndarray] = []
    size = 0

    def out():
        entries = np.concatenate(held)
        order = np.lexsort((entries["b"], entries["a"]))
        entries = entries[order]
        new = np.ones(len(entries), bool)
        new[1:] = (entries["a"][1:] != entries["a"][:-1]) | (entries["b"][1:] != entries["b"][:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        asked, settled = entries[new], entries[many]
        # a window that is settled here is still told to the others, but expects no answer (at is all ones)
        asked["at"][many[new]] = 0xFFFFFFFF
        for rows, done, where in ((asked, False, asked["a"] % U(buckets)), (settled, True, mix(settled["key"].view(np.uint64)) % U(buckets))):
            if not len(rows):
                continue
            order = np.lexsort((rows["at"], rows["key"], where))
            rows, where = rows[order], where[order]
            cuts = np.flatnonzero(np.diff(where)) + 1
            parts = np.split(rows, cuts)
            numbers = where[np.concatenate(([0], cuts))].astype(np.int32)
            yield out_batch(schema, bucket=numbers, settled=[done] * len(parts), entries=[columns_of(p) if not done else columns_of(p[list(PLACE.names)]) for p in parts])

    for batch in batches:
        got = Windows(batch.column(2), window, gram)
        if not len(got.at):
            continue
        at = got.at[marked(sketch.value, got.grams[got.anchor])]
        if not len(at):
            continue
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        doc = np.searchsorted(got.counts, at, "right") - 1
        entries = np.empty(len(at), ENTRY)
        entries["a"], entries["b"] = got.hashes(at)
        entries["id"], entries["key"], entries["at"] = ids[doc], keys[doc], at - got.counts[doc]
        held.append(entries)
        size += len(entries)
        if size > _FLUSH:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def _answer(table: pa.Table, homes: int) -> pa.Table:
    """One bucket: the places of windows that start elsewhere too, by home of their document."""
    schema = arrow_type(REPLY)
    places: list[np.ndarray] = []
    asked: list[np.ndarray] = []
    for settled, entries in zip(table.column("settled").to_pylist(), table.column("entries").to_pylist()):
        (places if settled else asked).append(from_columns(entries, PLACE if settled else ENTRY))
    if asked:
        entries = np.concatenate(asked)
        entries = entries[np.lexsort((entries["b"], entries["a"]))]
        same = (entries["a"][1:] == entries["a"][:-1]) & (entries["b"][1:] == entries["b"][:-1])
        many = np.zeros(len(entries), bool)
        many[1:] |= same
        many[:-1] |= same
        entries = entries[many & (entries["at"] != 0xFFFFFFFF)]
        places.append(entries[list(PLACE.names)].astype(PLACE))
    found = np.concatenate(places) if places else np.zeros(0, PLACE)
    if not len(found):
        return schema.empty_table()
    where = np.mod(found["key"], homes)
    order = np.lexsort((found["at"], found["key"], where))
    found, where = found[order], where[order]
    cuts = np.flatnonzero(np.diff(where)) + 1
    return pa.Table.from_batches([out_batch(schema, home=where[np.concatenate(([0], cuts))].astype(np.int32), entries=[columns_of(p) for p in np.split(found, cuts)])])


def covered(places: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the places."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + window, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _remove(docs: pa.Table, replies: pa.Table, window: int, carry: int) -> pa.Table:
    parts = [from_columns(x, PLACE) for x in replies.column("entries").to_pylist()]
    found = np.concatenate(parts) if parts else np.zeros(0, PLACE)
    found = found[np.lexsort((found["at"], found["id"], found["key"]))]
    by: dict[tuple[int, int], np.ndarray] = {}
    if len(found):
        cuts = np.flatnonzero((found["key"][1:] != found["key"][:-1]) | (found["id"][1:] != found["id"][:-1])) + 1
        by = {(int(p["id"][0]), int(p["key"][0])): p["at"].astype(np.int64) for p in np.split(found, cuts)}
    total, left, texts = [], [], []
    for id_, key, text in zip(*(docs.column(c).to_pylist() for c in ("row_id", "row_key", "row_text"))):
        words = (text or "").encode().split()
        places = by.get((id_, key))
        kept = words if places is None else list(compress(words, ~covered(places, len(words), window)))
        total.append(len(words))
        left.append(len(words) - len(kept))
        texts.append(b" ".join(kept).decode())
    own = docs.select(docs.column_names[4 : 4 + carry])
    return own.append_column("n_words", pa.array(total, pa.int64())).append_column("n_removed", pa.array(left, pa.int64())).append_column("kept", pa.array(texts, pa.string()))


def removed(docs: DataFrame, carry: list[str], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row per document: the carried columns (none of them named as those that follow), n_words, n_removed, kept.

    docs is read three times (sketch, windows, removal) and shuffled once, by document.  Buckets and homes hold a fixed
    number of words at any size of the input.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id"), doc_key("doc_id", "text").alias("row_key"), F.col("text").alias("row_text"), *carry)
    sketch, words = repeated_anchors(docs, window, gram)
    n = shuffle_partitions(docs.sparkSession)
    buckets, homes = max(n, words // 1_000_000), max(n, words // 300_000)
    asked = keyed.select("row_id", "row_key", "row_text").mapInArrow(partial(_candidates, sketch=sketch, window=window, gram=gram, buckets=buckets), BUCKET)
    replies = asked.groupBy("bucket").applyInArrow(lambda bucket: _answer(bucket, homes), REPLY)
    at_home = keyed.select(F.pmod("row_key", F.lit(homes)).cast("int").alias("row_home"), *keyed.columns)
    schema = T.StructType([*(docs.schema[c] for c in carry), *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    together = at_home.groupBy("row_home").cogroup(replies.groupBy("home"))
    return together.applyInArrow(lambda left, right: _remove(left, right, window, len(carry)), schema)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a space)."""
    return removed(docs, ["doc_id"], window)


def cleaned_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with the input's columns, without repeated words; n_chars follows.

    A text that loses nothing stays as it is; a document that loses all its words goes.
    """
    plain = own_names(docs, ("doc_id", "text", "n_chars"))
    got = removed(plain, plain.columns, window).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return got.select(*[new[c].alias(c) if c in new else F.col(c) for c in plain.columns]).toDF(*docs.columns)
