"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised in Arrow batches; only documents longer than a sequence are cut.  Piece metadata (never tokens)
is then packed by vector best-fit: a bin has a residual in three dimensions (tokens, documents, attention cost, the sum
of squared lengths), a piece fits only if no dimension is exceeded, and among the open bins that fit the one with the
largest weighted dot product of piece and bin load (or the smallest residual norm) is taken.  Packing runs in
independent blocks of pieces, and a second round repacks the bins that blocks left too empty.

Defined results: a null text is an empty one (end token only); repeated rows are packed once each; an empty table gives
an empty result; other columns of the input are ignored; ties go to the older bin.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, out_batch, prepare, staged, texts_of

MAX_TOKENS = 4096
END_ID = 1

PIECES = "doc_id long,piece int,start long,length long,ids_crc32 long"
PACKED = PIECES + ",sequence_id long,offset long"

# Letters whose lower case is one letter of the same set, then marks other than an apostrophe: tokenised apart exactly.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\s\w']*)")
_LITTLE = array("I").itemsize == 4 and sys.byteorder == "little"
#: Words that a generation of a cache holds; there are two, as most words of large tables are seen a few times only.
_KEPT = 300_000
PROBES = (
    "Plain words, in a Sentence.", "UPPER lower MiXeD", "naïve Ärger ÉCOLE straße", "a\nb\n\n c  d", " leading and trailing ",
    "don't it's I'LL", "x.y,z;(q)[r]{s} -- ...!?", "\u201cquoted\u201d\u2014dash\u2026", "123 4a5 2nd 3.14", "snake_case a__b", "\u6f22\u5b57 \u4eee\u540d", "tab\tand\u00a0space", "", "\U0001f642 \u2167",
)


class WordTokenizer:
    """Token ids of texts, word by word with bounded caches: a full one becomes the older generation, whose words come back when they are met.

    The vocabulary drops white space, and no token crosses it, so a text's ids are those of its words one after another.
    Texts with white space other than space and line feed are split there by the tokenizer itself.  Whether a vocabulary
    is of this kind (lower-casing, byte-level spelling, no token over white space) is tried on `PROBES` when it is loaded;
    one that differs on any of them encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes = _byte_alphabet()
        self.words, self.older_words = {}, {}  # of whole words, as they are written
        self.bare, self.older_bare = {}, {}  # of letters in lower case, and of marks
        self.by_word = True
        self.by_word = all(self.ids(t) == self._encode(t) for t in PROBES)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str, spell: Callable[[str], bytes]) -> bytes:
        got = self.bare.get(part)
        if got is None:
            got = self.older_bare.get(part)
            if got is None:
                got = spell(part)
            if len(self.bare) >= _KEPT:
                self.older_bare, self.bare = self.bare, {}
            self.bare[part] = got
        return got

    def _letters(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.bytes.__getitem__, word.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(spelled)])
        return (ids if _LITTLE else np.asarray(ids, "<u4")).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.older_words.get(word)
        if got is None:
            plain = _PLAIN.fullmatch(word) if len(word) < 64 else None
            if plain is None or "<|" in word or not plain[2].isascii():
                got = self._encode(word)
            else:
                got = self._part(plain[1].lower(), self._letters)
                if plain[2]:
                    got += self._part(plain[2], self._encode)
        if len(word) < 64:
            if len(self.words) >= _KEPT:
                self.older_words, self.words = self.words, {}
            self.words[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not self.by_word:
            return self._encode(text)
        known, word = self.words.get, self._word
        parts = [got if (got := known(w)) is not None else word(w) for w in text.replace("\n", " ").split(" ") if w]
        return b"".join(parts)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as itself, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _cut(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    schema, tokens = arrow_type(PIECES), tokenizer(path)
    end = np.asarray([END_ID], "<u4").tobytes()
    for batch in batches:
        docs, piece, start, length, crc = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            raw = tokens.ids(text) + end
            for k, at in enumerate(range(0, len(raw), 4 * most)):
                part = raw[at : at + 4 * most]
                docs.append(doc)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield out_batch(schema, doc_id=docs, piece=piece, start=start, length=length, ids_crc32=crc)


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_cut, path=vocabulary, most=max_tokens), PIECES)


class VectorBins:
    """Open bins with their residuals in tokens, documents and attention cost.

    Every bin that fits is scored, in one pass over arrays; with `tries` only so many, those with the fewest tokens left.
    """

    def __init__(self, tokens: int, documents: int, cost: int, weights: tuple[float, float, float], rule: str, tries: int | None = None):
        self.full = (tokens, documents, cost)
        self.weights, self.rule, self.tries = weights, rule, tries
        self.count, self.opened = 0, 0
        self.left, self.number = np.zeros((3, 1024), np.int64), np.zeros(1024, np.int64)

    def _score(self, need: tuple[int, int, int], left: np.ndarray) -> np.ndarray:
        score = np.zeros(left.shape[1])
        for w, n, f, x in zip(self.weights, need, self.full, left):
            score += -w * (n / f) * ((f - x) / f) if self.rule == "dot" else w * ((x - n) / f) ** 2  # dot: of the piece and of what the bin holds, full bins are closed first
        return score

    def _open(self) -> int:
        if self.count == len(self.number):
            self.left, self.number = np.concatenate([self.left, np.zeros_like(self.left)], axis=1), np.concatenate([self.number, np.zeros_like(self.number)])
        at, self.count = self.count, self.count + 1
        self.left[:, at], self.number[at] = self.full, self.opened
        self.opened += 1
        return at

    def _fitting(self, need: tuple[int, int, int]) -> np.ndarray:
        left = self.left[:, : self.count]
        fit = np.flatnonzero(left[0] >= need[0])
        return fit[(left[1, fit] >= 1) & (left[2, fit] >= need[2])]

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and the tokens before it there."""
        need = (length, 1, length * length)
        fit = self._fitting(need)
        if self.tries is not None and len(fit) > self.tries:
            fit = fit[np.lexsort((self.number[fit], self.left[0, fit]))[: self.tries]]
        if len(fit):
            score = self._score(need, self.left[:, fit])
            best = fit[score == score.min()]
            at = int(best[self.number[best].argmin()])  # of equal scores the older bin
        else:
            at = self._open()
        number, offset = int(self.number[at]), int(self.full[0] - self.left[0, at])
        self.left[:, at] -= need
        if self.left[:, at].min() <= 0:  # full: the last open bin takes its place
            self.count -= 1
            self.left[:, at], self.number[at] = self.left[:, self.count], self.number[self.count]
        return number, offset


def _pack(batches: Iterator[pa.RecordBatch], round_: int, full: tuple[int, int, int], weights, rule: str, tries: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema, part = arrow_type(PACKED), TaskContext.get().partitionId()
    bins = VectorBins(*full, weights, rule, tries)
    for batch in batches:
        placed = [bins.put(n) for n in batch.column(3).to_pylist()]
        base = (round_ << 60) | (part << 32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([base | b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], schema=schema)


def best_fit(
    cut: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    tries: int | None = None,
    block: int = 50_000,
    least_fill: float = 0.97,
) -> DataFrame:
    """Packs pieces into sequences; every capacity holds in every sequence.

    Blocks of about `block` pieces are packed apart, longest first (the order is total, so a task that is run again
    packs alike).  Sequences filled below `least_fill` are opened again and their pieces packed together in a second
    round of far fewer blocks.  By default documents and cost are as large as max_tokens allows.
    """
    full = (max_tokens, max_documents or max_tokens, max_cost or max_tokens * max_tokens)
    pack = partial(_pack, full=full, weights=weights, rule=rule, tries=tries)
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]
    n = max(1, -(-cut.count() // block))
    first = cut.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(*order)
    first = staged(first.mapInArrow(partial(pack, round_=0), PACKED), "packed")
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < int(least_fill * max_tokens))
    loose = first.join(fill.select("sequence_id"), "sequence_id", "left_semi").select(*[f.split()[0] for f in PIECES.split(",")])
    kept = first.join(fill.select("sequence_id"), "sequence_id", "left_anti").select(*first.columns)
    m = max(1, -(-loose.count() // block))
    again = loose.repartition(m, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(*order)
    return kept.unionByName(again.mapInArrow(partial(pack, round_=1), PACKED))


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, **options) -> DataFrame:
    """Tokenises, cuts and packs documents: a row per piece with its sequence and place."""
    cut = staged(pieces(docs, vocabulary, max_tokens), "pieces")
    return best_fit(cut, max_tokens, **options)
