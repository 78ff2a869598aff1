"""Quality rules: simple counts, and n-gram perplexity within bands of each language.

The model is a character 5-gram model with modified Kneser-Ney smoothing for each value of lang (null is one of them),
counted by Spark over all whole texts.  A character is one of 4096 classes (code points below 2048 as they are, others by
a hash), so an n-gram packs into 60 bits, its context and its suffix are bit fields, and lower orders follow from the
distinct higher ones.  Discounts come from counts of counts.  Every n-gram that occurs is kept, at any size of the corpus,
and nothing of the model is collected or broadcast: probabilities are joins of n-gram tables, order by order.

For scoring, the n-grams that a file of the input needs are asked for once each.  Questions meet the model in buckets,
where its keys and values stand in sorted arrays; the answers of a file are written to the shared folder, and the tasks
that read the file look its texts up there.  So what is shuffled follows the different n-grams of each file, and a task
holds those of one file.  Input that does not come from files, or from very large ones, is written out first.

Perplexity is that of a word: the exponential of a text's negative log-probability over its number of words.  (A mean
over characters would hide words with marks stuck to them, whose repeated characters are cheap.)  A document is rejected
if the logarithm lies outside its language's band: the median of the documents that pass the base rules, less `below` and
plus `above` robust standard deviations (1.4826 times the median absolute deviation, at least `floor`).  The lower side
is tighter: texts of likely fragments score only a little below the median, texts with marks stuck to words far above it.

Defined results: a null text has no words and fails the base rules; perplexity is null without a word; a language
without any document that passes the base rules has no band and rejects none; repeated rows count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, U, arrow_type, gram_hashes, mix, out_batch, place, prepare, shared_path, shuffle_partitions, staged, starts_inside, texts_of, utf8_of, word_hashes, words_of

ORDER, CLASS_BITS = 5, 12
PLAIN = 2048
BELOW, ABOVE, FLOOR = 4.5, 6.0, 0.1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
ASKED = "bucket int,chunk long,lang string,keys binary,times binary"
COUNTS = "lang string,gram long,n long"
ANSWERS = "chunk long,lang string,keys binary,logs binary"
SCORED = "doc_id long,lang string,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,nll double"
BASE = "doc_id long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long"
_FLUSH = 2_000_000
_LARGE_FILE = 1 << 30


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character classes of texts one after another, each after ORDER - 1 zeros, and the offsets of the texts with their zeros."""
    pad = "\0" * (ORDER - 1)
    code = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = PLAIN + ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    return np.where(code < PLAIN, code.astype(np.int64), folded), np.concatenate(([0], np.cumsum(lengths)))


def packed(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at each character of the texts (zeros before them left out)."""
    n = len(code) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = code[:n].copy()
    for j in range(1, ORDER):
        out <<= CLASS_BITS
        out |= code[j : j + n]
    last = np.ones(n, bool)
    for j in range(ORDER - 1):  # those that end in a later text's zeros
        at = offsets[1:-1] + j - (ORDER - 1)
        last[at[(at >= 0) & (at < n)]] = False
    return out[last]


# --- sorted arrays as bytes: differences byte by byte, as their high bytes are mostly zero ------------------------------


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def keys_out(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=0))


def keys_in(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<i8"))


# --- counting ----------------------------------------------------------------------------------------------------------


def with_files(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and chunk, a number of the file that the row comes from."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")]
    chunk = F.xxhash64("_metadata.file_path").alias("chunk")
    try:
        own = docs.select(*columns, chunk, F.col("_metadata.file_size").alias("file_size"))
        largest = own.agg(F.max("file_size")).first()[0]
        if (largest or 0) <= _LARGE_FILE:
            return own.drop("file_size")
    except AnalysisException:  # not read from files
        pass
    return staged(docs.select(*columns), "documents").select("doc_id", "lang", "text", chunk)


def _by(*columns: list) -> Iterator[tuple[tuple, list[int]]]:
    """The row numbers of each combination of values."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*columns)):
        groups.setdefault(key, []).append(i)
    yield from groups.items()


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A task's n-grams by file and language, merged in memory and given out by bucket whenever they grow large."""
    schema = arrow_type(ASKED)
    held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[tuple, int] = {}

    def merge(key: tuple) -> tuple[np.ndarray, np.ndarray]:
        held[key] = [merged(held[key])]
        sizes[key] = len(held[key][0][0])
        return held[key][0]

    def out(key: tuple) -> pa.RecordBatch:
        grams, n = merge(key)
        del held[key], sizes[key]
        where = np.mod(grams, buckets)
        order = np.argsort(where, kind="stable")
        grams, n, where = grams[order], n[order], where[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
        keys, times = np.split(grams, cuts[1:]), np.split(n.astype("<u4"), cuts[1:])
        return out_batch(schema, bucket=where[cuts].astype(np.int32), chunk=[key[0]] * len(cuts), lang=[key[1]] * len(cuts), keys=list(map(keys_out, keys)), times=list(map(planes, times)))

    for batch in batches:
        texts = texts_of(batch.column(2))
        for key, rows in _by(batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]):
            grams, n = np.unique(packed(*classes([texts[i] for i in rows])), return_counts=True)
            if not len(grams):
                continue
            held.setdefault(key, []).append((grams, n))
            sizes[key] = sizes.get(key, 0) + len(grams)
            if sizes[key] > _FLUSH:
                merge(key)
        while sum(sizes.values()) > 2 * _FLUSH:
            for key in list(held):
                merge(key)
            if sum(sizes.values()) > _FLUSH:
                yield out(max(sizes, key=sizes.get))
    for key in list(held):
        yield out(key)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and the sums of their counts."""
    grams, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.add.reduceat(n, first)


def _sum(table: pa.Table) -> pa.Table:
    """One bucket: the counts of its n-grams."""
    out = []
    langs, keys, times = (table.column(c).to_pylist() for c in ("lang", "keys", "times"))
    for (lang,), rows in _by(langs):
        grams, n = merged([(keys_in(keys[i]), from_planes(times[i], "<u4")) for i in rows])
        out.append(pa.table({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": n}, schema=arrow_type(COUNTS)))
    return pa.concat_tables(out)


def asked_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """The n-grams that each file needs, with their counts, by bucket; and the number of buckets (odd, so that all characters count)."""
    buckets = shuffle_partitions(docs.sparkSession) | 1
    return staged(docs.select("chunk", "lang", "text").mapInArrow(partial(_count, buckets=buckets), ASKED), "asked"), buckets


def gram_counts(asked: DataFrame) -> list[DataFrame]:
    """For orders 1 to 5 lang, gram, n: counts of the highest order, and of the lower ones the number of different characters before."""
    top = asked.select("bucket", "lang", "keys", "times").groupBy("bucket").applyInArrow(_sum, COUNTS)
    tables = [staged(top, f"grams{ORDER}")]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (CLASS_BITS * order)) - 1))
        tables.append(staged(tables[-1].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{order}"))
    return tables[::-1]


# --- the model ---------------------------------------------------------------------------------------------------------


def discounts(counts: list[DataFrame]) -> DataFrame:
    """order, lang, d1, d2, d3: what n-grams seen once, twice and more often give up, from counts of counts; where these are missing, halves.

    A row for each order and language, written out: Spark broadcasts it where its size allows.
    """
    every = counts[0].select(F.lit(1).alias("order"), "lang", "n")
    for order, table in enumerate(counts[1:], 2):
        every = every.unionByName(table.select(F.lit(order).alias("order"), "lang", "n"))
    n1, n2, n3, n4 = (F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4))
    got = every.groupBy("order", "lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    full = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def of(k: int, more: str, here: str) -> Column:
        raw = k - (k + 1) * y * F.try_divide(F.col(more), F.col(here))
        return F.when(full, F.least(F.greatest(raw, F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(k / 2)).alias(f"d{k}")

    return staged(got.select("order", "lang", of(1, "n2", "n1"), of(2, "n3", "n2"), of(3, "n4", "n3")), "discounts")


def log_probabilities(counts: list[DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """lang, gram and log: of the last character of each 5-gram after the others; for those counted, or those wanted (lang, gram).

    An n-gram's probability is its discounted share of its context, and the mass that the context leaves times the
    probability one order below; the lowest order shares with all classes alike.
    """
    lower: DataFrame | None = None
    gives = discounts(counts)
    for order, table in enumerate(counts, 1):
        context = F.shiftright("gram", CLASS_BITS).alias("context")
        given = table.select("lang", "gram", "n", context).join(gives.where(F.col("order") == order).drop("order"), "lang")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        given = given.withColumn("discount", discount)
        contexts = given.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("back"))
        rows = given.select("lang", "gram", "context", (F.col("n") - F.col("discount")).alias("own"))
        if wanted is not None:
            asked = wanted.select("lang", F.col("gram").bitwiseAND(F.lit((1 << (CLASS_BITS * order)) - 1)).alias("gram")).distinct()
            rows = asked.withColumn("context", context).join(rows.drop("context"), ["lang", "gram"], "left")
        rows = rows.join(contexts, ["lang", "context"], "inner" if wanted is None else "left")
        share, back = F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)), F.coalesce("back", F.lit(1.0))
        if lower is None:
            rows = rows.select("lang", "gram", (share + back * F.lit(2.0**-CLASS_BITS)).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (CLASS_BITS * (order - 1))) - 1))
            rows = rows.select("lang", "gram", share.alias("share"), back.alias("back"), suffix.alias("suffix"))
            rows = rows.join(lower, ["lang", "suffix"]).select("lang", "gram", (F.col("share") + F.col("back") * F.col("below")).alias("p"))
        lower = rows.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    return rows.select("lang", "gram", F.log("p").alias("log"))


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """One bucket: the model's sorted arrays, and the values that each file asks for."""
    order = np.argsort(model.column("gram").to_numpy(), kind="stable")
    grams, logs = (model.column(c).to_numpy()[order] for c in ("gram", "log"))
    langs = np.array(model.column("lang").to_pylist(), object)[order]
    stored = {lang: (grams[langs == lang], logs[langs == lang].astype("<f4")) for lang in set(langs.tolist())}
    found = []
    for lang, keys in zip(*(asked.column(c).to_pylist() for c in ("lang", "keys"))):
        found.append(planes(look_up(stored[lang], keys_in(keys))))
    return pa.table([asked.column("chunk"), asked.column("lang"), asked.column("keys"), pa.array(found, pa.binary())], schema=arrow_type(ANSWERS))


def look_up(stored: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The values of keys in sorted arrays; all of them have to be there."""
    at = np.minimum(np.searchsorted(stored[0], keys), len(stored[0]) - 1)
    if len(keys) and not np.array_equal(stored[0][at], keys):
        raise ValueError("an n-gram was not counted: the documents changed while they were scored")
    return stored[1][at]


def answers(asked: DataFrame, buckets: int, logs: DataFrame) -> str:
    """Writes the answers to each file's questions to a folder of its own; gives the path above."""
    path = shared_path(asked.sparkSession, "answers")
    model = logs.withColumn("bucket", F.pmod("gram", F.lit(buckets)).cast("int"))
    questions = asked.select("bucket", "chunk", "lang", "keys").groupBy("bucket")
    found = questions.cogroup(model.groupBy("bucket")).applyInArrow(_answer, ANSWERS)
    found.repartition("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(path)
    return path


class Answers:
    """The model's sorted arrays for the texts of one file at a time."""

    def __init__(self, folder: str):
        self.folder, self.chunk = folder, None
        self.stored: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, chunk: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        if chunk != self.chunk:
            self.chunk, self.stored = chunk, {}
            fs, path = place(f"{self.folder}/chunk={chunk}")
            parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for info in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
                if not info.base_name.startswith(("_", ".")):
                    for row in pa.parquet.read_table(info.path, filesystem=fs, partitioning=None).to_pylist():
                        parts.setdefault(row["lang"], []).append((keys_in(row["keys"]), from_planes(row["logs"], "<f4")))
            for lang, some in parts.items():
                keys, logs = (np.concatenate(x) for x in zip(*some))
                keys, first = np.unique(keys, return_index=True)  # tasks of one file may ask alike
                self.stored[lang] = keys, logs[first]
        return self.stored


def negative_log(stored: tuple[np.ndarray, np.ndarray] | None, texts: list[str]) -> list[float]:
    """The negative log-probability of each text."""
    code, offsets = classes(texts)
    top, inverse = np.unique(packed(code, offsets), return_inverse=True)
    if not len(top):
        return [0.0] * len(texts)
    if stored is None:
        raise ValueError("a text was not counted: the documents changed while they were scored")
    sums = np.concatenate(([0.0], np.cumsum(-look_up(stored, top).astype(float)[inverse])))
    ends = offsets - np.arange(len(offsets)) * (ORDER - 1)
    return (sums[ends[1:]] - sums[ends[:-1]]).tolist()


# --- rules -------------------------------------------------------------------------------------------------------------


def base_counts(column: pa.Array, texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of a batch."""
    data, offsets = utf8_of(column)
    starts, ends, counts = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    per_text = lambda flags, at: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])
    grams = gram_hashes(words, 3)
    covered = np.zeros(len(words), bool)
    inside = np.flatnonzero(starts_inside(counts, 3))
    if len(inside):
        doc = (np.searchsorted(counts, inside, "right") - 1).astype(np.uint64)
        _, number, times = np.unique(mix(grams[inside] + doc * U(0xC2B2AE3D27D4EB4F)), return_inverse=True, return_counts=True)
        again = inside[times[number] > 1]
        for j in range(3):
            covered[again + j] = True
    lines = [[x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
    return {
        "n_words": np.diff(counts),
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~SEPARATOR[data], offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": per_text(covered, counts),
    }


def _score(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    schema, known = arrow_type(SCORED), Answers(folder)
    for batch in batches:
        langs, texts, chunks = [x or "" for x in batch.column(1).to_pylist()], texts_of(batch.column(2)), batch.column(3).to_pylist()
        base = base_counts(batch.column(2), texts)
        nll: list[float | None] = [None] * len(texts)
        for (chunk, lang), own in sorted(_by(chunks, langs)):
            for i, x in zip(own, negative_log(known.of(chunk).get(lang), [texts[i] for i in own])):
                nll[i] = x / int(base["n_words"][i]) if base["n_words"][i] else None
        yield out_batch(schema, doc_id=batch.column(0), lang=langs, nll=nll, **base)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_type(BASE)
    for batch in batches:
        yield out_batch(schema, doc_id=batch.column(0), **base_counts(batch.column(1), texts_of(batch.column(1))))


FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def base_rules(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, the base counts and base_failed, without a model."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_base, BASE).withColumn("base_failed", F.expr(FAILED))


def scored_documents(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, lang (null as empty), the base counts and nll, the negative log-probability for each word."""
    prepare(docs.sparkSession)
    docs = with_files(docs)
    asked, buckets = asked_of(docs)
    folder = answers(asked, buckets, log_probabilities(gram_counts(asked)))
    return docs.mapInArrow(partial(_score, folder=folder), SCORED)


def quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE, floor: float = FLOOR) -> DataFrame:
    """A row per document: doc_id, the base counts, base_failed, kept, perplexity and the band's lower and upper perplexity."""
    scored = staged(scored_documents(docs), "scored")
    scored = scored.withColumn("base_failed", F.expr(FAILED))
    good = scored.where("not base_failed").select("lang", "nll")
    middle = staged(good.groupBy("lang").agg(F.percentile_approx("nll", 0.5, 10000).alias("middle")), "medians")
    spread = good.join(middle, "lang").groupBy("lang", "middle").agg(F.percentile_approx(F.abs(F.col("nll") - F.col("middle")), 0.5, 10000).alias("spread"))
    unit = F.greatest(F.lit(floor), 1.4826 * F.col("spread"))
    bands = staged(spread.select("lang", (F.col("middle") - F.lit(below) * unit).alias("low"), (F.col("middle") + F.lit(above) * unit).alias("high")), "bands")
    judged = scored.join(bands, "lang", "left")
    inside = F.coalesce(F.col("nll").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        F.exp("nll").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"),
    )
