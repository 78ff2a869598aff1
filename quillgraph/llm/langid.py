"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are the character 1- to 3-grams of the lower-case text (all that is not a letter counts as a space), hashed to
2**15 numbers.  Document frequencies are counted over all training rows.  Weights are learned by
follow-the-regularised-leader with elastic-net penalties (many stay zero) on a bounded sample of labelled rows: about
`per_language` rows of each language, chosen by a hash, and fewer if there are so many languages that all would be more
than MOST_ROWS.  A part of the sample is kept out of the fit and sets the temperature that calibrates the probabilities.
Predictions use the text alone.

Defined results: a text that is null or has no letter is `und` with score 0, as are all texts if there is no training
row; rows without lang are not learned from; a null doc_id is not held out; repeated rows get equal predictions; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, doc_key, out_batch, own_names, prepare, texts_of

BITS, ORDERS = 15, 3
FEATURES = 1 << BITS
UNKNOWN = "und"
PER_LANGUAGE, MOST_ROWS = 400, 20_000
_SLICE = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SEEDS = np.array([0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint32)
PREDICTED = "lang_pred string,score double"
VECTORS = "lang string,fold long,features binary,values binary"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str) -> np.ndarray | None:
    """The count of each hashed n-gram of a whole text, in slices of bounded size; None if it has no letter."""
    total, any_letter = np.zeros(FEATURES, np.int64), False
    for at in range(0, len(text), _SLICE):
        code = np.frombuffer(text[max(0, at - ORDERS + 1) : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters()[code]
        any_letter |= bool(known.any())
        code = np.where(known, code, np.uint32(32))
        parts = []
        for n in range(1, min(ORDERS, len(code)) + 1):
            h = np.full(len(code) - n + 1, _SEEDS[n - 1])
            for j in range(n):
                h += code[j : j + len(h)] * _FACTORS[j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            parts.append(h >> np.uint32(32 - BITS))
        total += np.bincount(np.concatenate(parts), minlength=FEATURES)
    return total if any_letter else None


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The sparse TF-IDF vector of a text, of length 1, with a constant as last feature."""
    total = counts(text)
    if total is None:
        return None
    at = np.flatnonzero(total)
    values = (1 + np.log(total[at])) * idf[at]
    norm = np.sqrt(values @ values)
    if norm == 0:
        return np.array([FEATURES]), np.ones(1)
    return np.append(at, FEATURES), np.append(values / norm, 1.0)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row per label, FEATURES + 1 columns
    temperature: float = 1.0

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ values

    def predict(self, text: str) -> tuple[str, float]:
        got = vector(text, self.idf) if self.labels else None
        if got is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*got) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 5) -> np.ndarray:
    """Follow-the-regularised-leader, one coordinate-wise step for each row; the weights that the penalties leave."""
    z, n = np.zeros((n_labels, FEATURES + 1)), np.zeros((n_labels, FEATURES + 1))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, at, values = rows[k]
            w = weights(z[:, at], n[:, at])
            slope = softmax(w @ values)
            slope[label] -= 1
            g = slope[:, None] * values
            squares = n[:, at]
            z[:, at] += g - (np.sqrt(squares + g * g) - np.sqrt(squares)) / alpha * w
            n[:, at] = squares + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean()) + 1e-4 * t * t

    low, high, part = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in texts_of(batch.column(0)):
            got = counts(text)
            if got is not None:
                total += got > 0
                n += 1
    at = np.flatnonzero(total)
    yield out_batch(arrow_type("feature int,n long"), feature=np.append(at, FEATURES).astype(np.int32), n=np.append(total[at], n))


def _vectors(batches: Iterator[pa.RecordBatch], idf: Broadcast) -> Iterator[pa.RecordBatch]:
    schema = arrow_type(VECTORS)
    for batch in batches:
        rows = [(lang, fold, v[0].astype(np.uint16).tobytes(), v[1].astype(np.float32).tobytes()) for lang, fold, text in zip(*(c.to_pylist() for c in batch.columns)) if (v := vector(text or "", idf.value)) is not None]
        if rows:
            yield out_batch(schema, **dict(zip(schema.names, zip(*rows))))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows with text, lang and key (a hash that chooses the sample; its fourth part sets the temperature)."""
    spark = labelled.sparkSession
    prepare(spark)
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    labels = sorted(sizes)
    df = np.zeros(FEATURES + 1)
    for feature, n in labelled.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        df[feature] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    if not labels:
        return Model([], idf, np.zeros((0, FEATURES + 1)))
    each = min(per_language, max(1, MOST_ROWS // len(labels)))
    share = F.element_at(F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, each / sizes[k])))]), F.col("lang"))
    chosen = labelled.where(F.pmod("key", F.lit(1 << 30)) / float(1 << 30) < share)
    chosen = chosen.orderBy(F.pmod("key", F.lit(1 << 30)), "key").limit(2 * each * len(labels))  # the same rows on each run
    held = spark.sparkContext.broadcast(idf)
    fold = F.pmod(F.shiftrightunsigned("key", 32), F.lit(4))
    vectors = chosen.select("lang", fold.alias("fold"), "text").mapInArrow(partial(_vectors, idf=held), VECTORS).collect()
    rows = sorted((labels.index(lang), f, a, v) for lang, f, a, v in vectors)
    rows = [(y, f, np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for y, f, a, v in rows]
    model = Model(labels, idf, ftrl([(y, a, v) for y, f, a, v in rows if f], len(labels)))
    kept = [(y, a, v) for y, f, a, v in rows if not f]
    model.temperature = temperature(np.array([model.logits(a, v) for _, a, v in kept]), np.array([y for y, _, _ in kept]))
    model.weights = model.weights.astype(np.float32)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast, schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    known = model.value
    for batch in batches:
        got = [known.predict(t) for t in texts_of(batch.column(text))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=pa.schema([*batch.schema, *schema]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with lang_pred and score; docs has a text and no columns of these names."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    shape = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "," + PREDICTED
    return docs.mapInArrow(partial(_predict, model=held, schema=arrow_type(PREDICTED), text=names.index("text")), shape)


def training_rows(docs: DataFrame) -> DataFrame:
    """Text, lang and key of the rows that may be learned from: those that are not held out and have a lang."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang", doc_key("doc_id", "text").alias("key"))


def accepted_documents(docs: DataFrame, least_score: float = 0.5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents, with the input's columns, whose language is known with a score of at least `least_score`."""
    plain = own_names(docs, ("doc_id", "text", "lang"))
    got = predict(plain, train(training_rows(plain), per_language))
    return got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).drop("lang_pred", "score").toDF(*docs.columns)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score."""
    model = train(training_rows(docs), per_language)
    got = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return got.drop("text")
