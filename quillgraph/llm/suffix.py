"""Suffix-array dedup on sparse suffixes: passages of at least 50 words that occur more than once.

Suffixes are retained only at minimiser positions: in each run of 50 words the 8-word gram with the smallest hash.  Equal
passages select equal positions.  A count-min sketch of the anchors (as for substring dedup, a bit map of fixed size)
leaves out suffixes that cannot repeat.  The rest are sorted by the hashes of their words, once, and each is compared with
its neighbour: the match is extended right over the common prefix and left over the words before, up to the reach within
which every run of 50 words around the position lies.  Matches of at least 50 words become spans.

A row's neighbours may fall short of 50 words while another one, elsewhere among the suffixes that begin with the same 8
words, matches it on both sides.  These stand together in the order, so there the windows of 50 words whose minimiser the
row is are also grouped by a 96-bit hash: every repeat of 50 words consists of repeated windows, so none is missed.  Rows
that stand at a partition's border, or in too many to hold, send each of their different windows on once, and these are
grouped in a second step.  The spans of a document are united.

Sort keys end in the row's own place, so range partitions split even a passage that a third of all documents share.  Only
neighbours are compared, never pairs in groups; of equal windows each gets the next one as its partner.  A word is told
by 32 bits of its hash, a window by 50 of them.

Defined results: a row per united span, none for documents without one (null texts, fewer than 50 words); the partner is
that of the span's longest match, whose own place and length are given; repeated rows repeat each other; spans may repeat
inside one document; ties in the order are broken by doc_id, a hash of the text and the place; a null doc_id stays null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, arrow_type, doc_key, mix, out_batch, prepare, shuffle_partitions, staged
from .substring import Windows, columns_of, from_columns, marked, repeated_anchors

LEAST, GRAM = 50, 8
NO_ID = -(1 << 63)
#: A retained suffix: words from it on, words before it (nearest first), its place, and how far before it its windows begin.
SUFFIXES = "right binary,left binary,id long,key long,at int,near int,far int"
#: A span, and its longest match: the partner, the partner's place, and the match's own borders.
SPAN = np.dtype([("id", "<i8"), ("key", "<i8"), ("from", "<u4"), ("to", "<u4"), ("other", "<i8"), ("okey", "<i8"), ("place", "<u4"), ("start", "<u4"), ("end", "<u4")])
#: Of a window that may be repeated: two parts of its hash, its document's id and key, its place, and whether its task settled it.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8"), ("key", "<i8"), ("at", "<u4"), ("done", "u1")])
FOUND = "asked boolean,number int,entries binary"
PACKED = "number int,entries binary"
SPANS = "doc_id long,start long,n_words long,other_doc_id long,other_start long,match_start long,match_words long"
_ROWS, _SPANS = 8_000, 200_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _suffixes(batches: Iterator[pa.RecordBatch], sketch: Broadcast, least: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The retained suffixes that may repeat, with the words around them as big-endian 32-bit hashes."""
    schema = arrow_type(SUFFIXES)
    for batch in batches:
        got = Windows(batch.column(2), least, gram)
        if not len(got.anchor):
            continue
        # the windows of an anchor begin at places one after another
        first = np.flatnonzero(np.concatenate(([True], got.anchor[1:] != got.anchor[:-1])))
        last = np.append(first[1:], len(got.anchor)) - 1
        places = got.anchor[first]
        near, far = places - got.at[last], places - got.at[first]
        kept = marked(sketch.value, got.grams[places])
        places, near, far = places[kept], near[kept], far[kept]
        if not len(places):
            continue
        doc = np.searchsorted(got.counts, places, "right") - 1
        low, high = got.counts[doc], got.counts[doc + 1]
        words = (got.words >> np.uint64(32)).astype(">u4")
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        right = [words[p:e].tobytes() for p, e in zip(places.tolist(), np.minimum(places + least, high).tolist())]
        left = [words[b:p][::-1].tobytes() for p, b in zip(places.tolist(), np.maximum(places - (least - gram), low).tolist())]
        yield out_batch(schema, right=right, left=left, id=ids[doc], key=keys[doc], at=(places - low).astype(np.int32), near=near.astype(np.int32), far=far.astype(np.int32))


Rows = dict[str, list]


def some(rows: Rows, start: int, end: int) -> Rows:
    return {n: x[start:end] for n, x in rows.items()}


def joined(parts: list[Rows]) -> Rows:
    return {n: [x for p in parts for x in p[n]] for n in parts[0]}


def padded(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row, zeros after its end, and its length."""
    n = len(column)
    lengths = np.fromiter(map(len, column), np.int64, n) // 4
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in column), ">u4").reshape(n, width), lengths


def common_prefix(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each neighbouring two of n rows, the words that their sequences begin with in common."""
    same = np.cumprod(words[1:] == words[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))


def window_hashes(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each run of `least` words of each row, from polynomial prefix sums."""
    wide = mix(words.astype(np.uint64) + U(1))
    out = []
    for base in _BASES:
        n = words.shape[1]
        powers = np.full(n, U(base))
        powers[0] = U(1)
        powers = np.multiply.accumulate(powers)
        inverse = np.full(n - least + 1, U(pow(base, -1, 1 << 64)))
        inverse[0] = U(1)
        inverse = np.multiply.accumulate(inverse)
        sums = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(wide * powers, axis=1, out=sums[:, 1:])
        out.append(mix((sums[:, least:] - sums[:, : n - least + 1]) * inverse))
    return out[0], (out[1] >> U(32)).astype(np.uint32)


def compared(rows: Rows, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans that neighbouring rows give each other, and the windows of the rows."""
    right, n_right = padded(rows["right"], least)
    left, n_left = padded(rows["left"], least - gram)
    id_, key, at, near, far = (np.asarray(rows[c], np.int64) for c in ("id", "key", "at", "near", "far"))
    r, l = common_prefix(right, n_right), common_prefix(left, n_left)
    hit = np.flatnonzero(r + l >= least)
    spans = np.empty(2 * len(hit), SPAN)
    for part, mine, other in ((spans[: len(hit)], hit, hit + 1), (spans[len(hit) :], hit + 1, hit)):
        part["id"], part["key"], part["other"], part["okey"] = id_[mine], key[mine], id_[other], key[other]
        part["from"], part["to"] = at[mine] - l[hit], at[mine] + r[hit]
        part["start"], part["end"], part["place"] = part["from"], part["to"], at[other] - l[hit]
    a, b = window_hashes(np.concatenate([left[:, ::-1], right], axis=1), least)
    before = (least - gram) - np.arange(a.shape[1])  # words before the suffix in each window
    row, column = np.nonzero((before >= near[:, None]) & (before <= far[:, None]))
    entries = np.zeros(len(row), WINDOW)
    entries["a"], entries["b"] = a[row, column], b[row, column]
    entries["id"], entries["key"], entries["at"] = id_[row], key[row], at[row] - before[column]
    return spans, entries


def equal_windows(entries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """One entry of each hash (done: it has equals here), and the spans of entries that have an equal and are not done."""
    entries = entries[np.lexsort((entries["at"], entries["key"], entries["b"], entries["a"]))]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["a"][1:] != entries["a"][:-1]) | (entries["b"][1:] != entries["b"][:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    partner = np.arange(1, len(entries) + 1)
    partner[np.append(first[1:], len(entries)) - 1] = first  # the last one's is the first
    mine = np.flatnonzero((sizes[group] > 1) & (entries["done"] == 0))
    other = entries[partner[mine]]
    spans = np.empty(len(mine), SPAN)
    for name in ("id", "key"):
        spans[name] = entries[name][mine]
    spans["from"], spans["to"] = entries["at"][mine], entries["at"][mine] + np.uint32(least)
    spans["other"], spans["okey"], spans["place"] = other["id"], other["key"], other["at"]
    spans["start"], spans["end"] = spans["from"], spans["to"]
    once = entries[new]
    once["done"] |= (sizes > 1).astype(np.uint8)
    return once, spans


def _runs(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of intervals sorted by keys and start, where a new union of overlapping or touching ones begins."""
    new = np.ones(len(low), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(high.astype(np.int64) + (group << 32))
    new[1:] |= low[1:].astype(np.int64) + (group[1:] << 32) > reach[:-1]
    return np.flatnonzero(new)


def united(spans: np.ndarray) -> np.ndarray:
    """Spans of each document that overlap or touch become one; matches with one partner that follow each other do too, and the longest stays."""
    if not len(spans):
        return spans
    shift = spans["place"].astype(np.int64) - spans["start"]
    order = np.lexsort((spans["start"], shift, spans["okey"], spans["other"], spans["id"], spans["key"]))
    spans, shift = spans[order], shift[order]
    first = _runs([spans[n] for n in ("key", "id", "other", "okey")] + [shift], spans["start"], spans["end"])
    parts = spans[first].copy()
    parts["end"] = np.maximum.reduceat(spans["end"], first)
    parts["from"], parts["to"] = np.minimum.reduceat(spans["from"], first), np.maximum.reduceat(spans["to"], first)
    parts = parts[np.lexsort((parts["from"], parts["id"], parts["key"]))]
    first = _runs([parts["key"], parts["id"]], parts["from"], parts["to"])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(parts))))
    length = parts["end"].astype(np.int64) - parts["start"]
    best = np.lexsort((parts["place"], parts["other"], parts["start"], -length, group))[first]
    out = parts[best].copy()
    out["from"], out["to"] = parts["from"][first], np.maximum.reduceat(parts["to"], first)
    return out


def _dealt(rows: np.ndarray, where: np.ndarray, asked: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Entries by number of their bucket or home."""
    if len(rows):
        order = np.lexsort((rows["key"], where))
        rows, where = rows[order], where[order]
        cuts = np.flatnonzero(np.diff(where)) + 1
        numbers = where[np.concatenate(([0], cuts))].astype(np.int32)
        yield out_batch(schema, **{"asked": [asked] * len(numbers)} if "asked" in schema.names else {}, number=numbers, entries=[columns_of(p) for p in np.split(rows, cuts)])


def _compare(batches: Iterator[pa.RecordBatch], least: int, gram: int, homes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A sorted partition: spans of its documents by home, and windows of rows whose equals may be in other partitions by bucket."""
    schema = arrow_type(FOUND)
    held: list[np.ndarray] = []
    whole: list[Rows] = []  # runs of rows that begin with the same words, each complete
    size = 0

    def spans_out():
        found = united(np.concatenate(held))
        held.clear()
        return _dealt(found, np.mod(found["key"], homes), False, schema)

    def settle(rows: Rows, complete: bool):
        spans, entries = compared(rows, least, gram)
        once, equal = equal_windows(entries, least)
        held.append(united(np.concatenate([spans, equal])))
        if not complete:
            yield from _dealt(once, (once["a"] % U(buckets)).astype(np.int64), True, schema)
        if sum(map(len, held)) > _SPANS:
            yield from spans_out()

    rows: Rows | None = None  # the run that the partition has not ended yet
    cut = True  # it began before this partition, or was sent on in part
    for batch in batches:
        if not batch.num_rows:
            continue
        more = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        rows = more if rows is None else joined([rows, more])
        grams = np.array([x[: 4 * gram] for x in rows["right"]], f"S{4 * gram}")
        starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))).tolist()
        for start, end in zip(starts, starts[1:]):
            if cut:
                yield from settle(some(rows, start, end), False)
                cut = False
            elif end - start > 1:
                whole.append(some(rows, start, end))
                size += end - start
        rows = some(rows, starts[-1], len(grams))
        if len(rows["id"]) > _ROWS:
            yield from settle(rows, False)
            rows, cut = None, True
        if size > _ROWS:
            yield from settle(joined(whole), True)
            whole, size = [], 0
    if rows is not None:
        yield from settle(rows, False)
    if whole:
        yield from settle(joined(whole), True)
    if held:
        yield from spans_out()


def _equal(table: pa.Table, least: int, homes: int) -> pa.Table:
    """One bucket: the spans of windows that are in other partitions too, by home of their document."""
    schema = arrow_type(PACKED)
    found = united(equal_windows(np.concatenate([from_columns(x, WINDOW) for x in table.column("entries").to_pylist()]), least)[1])
    return pa.Table.from_batches(_dealt(found, np.mod(found["key"], homes), False, schema), schema)


def _unite(table: pa.Table) -> pa.Table:
    spans = united(np.concatenate([from_columns(x, SPAN) for x in table.column("entries").to_pylist()]))
    named = lambda x: pa.array(x, pa.int64(), mask=x == NO_ID)
    number = lambda x: pa.array(x.astype(np.int64))
    return pa.table(
        [named(spans["id"]), number(spans["from"]), number(spans["to"] - spans["from"]), named(spans["other"]), number(spans["place"]), number(spans["start"]), number(spans["end"] - spans["start"])],
        schema=arrow_type(SPANS),
    )


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """A row per united span of repeated words: doc_id, start (words before it), n_words, and its longest match.

    The match_words words from match_start on also stand in other_doc_id from other_start on.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), doc_key("doc_id", "text").alias("key"), "text")
    sketch, words = repeated_anchors(keyed, least, gram)
    n = shuffle_partitions(docs.sparkSession)
    homes = max(n, words // 2_000_000)
    order = ["right", "left", "id", "key", "at"]
    suffixes = keyed.mapInArrow(partial(_suffixes, sketch=sketch, least=least, gram=gram), SUFFIXES)
    sorted_ = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = staged(sorted_.mapInArrow(partial(_compare, least=least, gram=gram, homes=homes, buckets=n), FOUND), "matches")
    asked = found.where("asked").select("number", "entries").groupBy("number").applyInArrow(lambda bucket: _equal(bucket, least, homes), PACKED)
    return found.where("not asked").select("number", "entries").unionByName(asked).groupBy("number").applyInArrow(_unite, SPANS)
