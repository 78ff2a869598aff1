"""Answer metrics as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WHITE_SPACE, squeeze, strip, text

# Punctuation, final-answer phrases, stop words, Korean endings and particles.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ANSWER_PHRASES = (
    r"(?im)(?:the\s+)?(?:final\s+)?answer\s+is\s*[:\-]?\s*([^\n\.]+)",
    r"(?im)therefore[,\s]+(?:the\s+answer\s+is\s+)?([^\n\.]+)",
    r"(?im)(?:so|thus)[,\s]+(?:the\s+answer\s+is\s+)?([^\n\.]+)",
    r"(?im)(?:결론|정답|답)\s*[:\-]\s*([^\n\.]+)",
)
STOP_WORDS = (
    "that", "this", "with", "from", "have", "been", "they", "their", "also", "which", "were", "would", "could", "into", "more",
    "some", "when", "then", "than", "used", "both", "using", "between", "through", "while", "these", "those", "about", "after", "before",
)
KOREAN_ENDINGS = ("입니다", "이에요", "예요", "습니다", "합니다", "이다", "있습니다", "있어요", "많습니다", "많아요", "했습니다", "됩니다", "죠", "요")
KOREAN_PARTICLE = "(은|는|이|가|을|를|의|에|에서|으로|로|와|과|도|만)$"


def best_of(truths: Column, score) -> Column:
    """The best score over the truths; 0 without any."""
    return F.coalesce(F.array_max(F.transform(truths, lambda t: score(text(t)))), F.lit(0.0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, wherever it occurs there (in lambdas too, where Spark computes it anew)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(c: Column) -> Column:
    """Stripped and in lower case."""
    return F.lower(strip(text(c)))


def _distance(a: Column, b: Column) -> Column:
    """Of folded texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).when(F.least(F.length(a), F.length(b)) == 0, 1.0).otherwise(F.levenshtein(a, b) / longer)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, of stripped lower-case texts; 0 if both are empty, 1 if one is."""
    return _distance(folded(a), folded(b))


def _nearest(distances: Column, threshold: float) -> Column:
    return F.coalesce(F.array_max(F.transform(distances, lambda d: F.when(d > threshold, 0.0).otherwise(1 - d))), F.lit(0.0))


def anls(prediction: Column, truths: Column, threshold: float = 0.5) -> Column:
    """As one expression; on many rows count distances first (evaluation.scored does)."""
    p = folded(prediction)
    return _nearest(F.transform(F.transform(truths, folded), lambda t: _distance(p, t)), threshold)


def counted_anls(prediction: Column, truths: Column, distances: Column, threshold: float = 0.5) -> Column:
    """The same with `distances` as `short_distances` gives them; the others are counted here."""
    return _nearest(F.transform(truths, lambda t, i: F.coalesce(F.get(distances, i), edit_distance(prediction, t))), threshold)


# --- many short texts at once ------------------------------------------------------------------------------------------

#: Letters of the shorter text that fit the bits of a word, pairs that are counted at once, and the most words of bits that they take.
_BITS, _LANES, _WORDS = 64, 4096, 1 << 20
#: Rows that are worked on at once, so that what they take stays in a core's cache.
_ROWS = 2048


def _sliced(compare: Callable[[pa.Array, pa.Array], pa.Array], predictions: pa.Array, truths: pa.Array) -> pa.Array:
    return pa.concat_arrays([compare(predictions.slice(at, _ROWS), truths.slice(at, _ROWS)) for at in range(0, max(1, len(predictions)), _ROWS)])


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (null: empty) and the borders between them."""
    column = column.fill_null("") if column.null_count else column
    _, borders, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(borders, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _before(flags: np.ndarray) -> np.ndarray:
    """The sums of the flags, or sizes, before each place and the end."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _listed(truths: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All texts of an array of lists one after another, the row of each, and how many each row has."""
    counts = pc.fill_null(pc.list_value_length(truths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return truths.flatten(), np.repeat(np.arange(len(truths)), counts), counts


_WHITE = np.isin(np.arange(ord(max(WHITE_SPACE)) + 2), [ord(c) for c in WHITE_SPACE])  # no later letter is white space


def _stripped(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts, and where each begins and ends without white space around it."""
    data, borders = _utf8(column)
    letters = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    borders = _before((data & 0xC0) != 0x80)[borders]
    shown = np.flatnonzero(~_WHITE[np.minimum(letters, len(_WHITE) - 1)])
    first, past = np.searchsorted(shown, borders[:-1]), np.searchsorted(shown, borders[1:])
    some = past > first
    starts, ends = borders[:-1].copy(), borders[:-1].copy()
    starts[some], ends[some] = shown[first[some]], shown[past[some] - 1] + 1
    return letters, starts, ends


def _same_beginning(letters: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters, at most `most`, are the same from a on as from b on; they take no edit."""
    same, going = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(going):
        at = same[going]
        going = going[letters[a[going] + at] == letters[b[going] + at]]
        same[going] += 1
        going = going[same[going] < most[going]]
    return same


def _edits(letters: np.ndarray, p: np.ndarray, m: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Levenshtein distances of patterns of 1 to 64 letters (from p on, m long) to texts (from t on, n long), many at once.

    Myers's bit vectors: a word for each pair holds where a column of the table steps up or down; another for each pair and
    letter holds where the pattern has it.
    """
    out = np.zeros(len(p), np.int64)
    if not len(p):
        return out
    known = np.zeros(int(letters.max()) + 1, bool)
    known[letters] = True
    codes, kinds = (np.cumsum(known) - 1)[letters], int(known.sum())
    lanes_most = max(256, min(_LANES, _WORDS // kinds))
    by_length, one = np.argsort(n, kind="stable"), np.uint64(1)
    for at in range(0, len(p), lanes_most):
        lanes = by_length[at : at + lanes_most]
        p_, m_, t_, n_ = p[lanes], m[lanes], t[lanes], n[lanes]
        places, base = np.zeros(len(lanes) * kinds, np.uint64), np.arange(len(lanes)) * kinds
        for i in range(int(m_.max())):
            has = np.flatnonzero(m_ > i)
            places[base[has] + codes[p_[has] + i]] |= one << np.uint64(i)
        up, down, score = np.full(len(lanes), ~np.uint64(0)), np.zeros(len(lanes), np.uint64), m_.copy()
        last, least = (m_ - 1).astype(np.uint64), int(n_[0])
        final = np.maximum(t_ + n_ - 1, 0)
        for j in range(int(n_[-1])):
            equal = places[base + codes[np.minimum(t_ + j, final)]]
            vertical = equal | down
            diagonal = (((equal & up) + up) ^ up) | equal
            rise, fall = down | ~(diagonal | up), up & diagonal
            step = ((rise >> last) & one).astype(np.int64) - ((fall >> last) & one).astype(np.int64)
            score += step if j < least else np.where(j < n_, step, 0)
            rise, fall = (rise << one) | one, fall << one
            up, down = fall | ~(vertical | rise), rise & vertical
        out[lanes] = score
    return out


def edits_of(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of pairs whose first text has 1 to 64 characters."""
    letters = np.frombuffer("".join(a + b for a, b in pairs).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(x) for pair in pairs for x in pair], np.int64)
    starts = _before(sizes)[:-1]
    return _edits(letters, starts[::2], sizes[::2], starts[1::2], sizes[1::2])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def short_distances(predictions: pa.Array, truths: pa.Array) -> pa.Array:
    """Edit distances of a text to each of an array of texts, stripped here, in lower case before; null where both have over 64 characters."""
    return _sliced(_distances, predictions, truths)


def _distances(predictions: pa.Array, truths: pa.Array) -> pa.Array:
    flat, owner, counts = _listed(truths)
    p_letters, p_starts, p_ends = _stripped(predictions)
    letters, starts, ends = _stripped(flat)
    ours, own = (p_ends - p_starts)[owner], ends - starts
    shorter, longer = np.minimum(ours, own), np.maximum(ours, own)
    out = np.where(longer == 0, 0.0, 1.0)
    todo = np.flatnonzero((shorter > 0) & (shorter <= _BITS))
    turned = (own < ours)[todo]  # the shorter text is the pattern
    a, b = p_starts[owner[todo]], starts[todo] + len(p_letters)
    a, b, both = np.where(turned, b, a), np.where(turned, a, b), np.concatenate([p_letters, letters])
    same = _same_beginning(both, a, b, shorter[todo])
    a, b, m, n = a + same, b + same, shorter[todo] - same, longer[todo] - same
    some, edits = m > 0, n.copy()
    edits[some] = _edits(both, a[some], m[some], b[some], n[some])
    out[todo] = edits / longer[todo]
    return pa.ListArray.from_arrays(pa.array(_before(counts), pa.int32()), pa.array(out, mask=shorter > _BITS))


_SPACE, _MARK = 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in WHITE_SPACE if c < "\x80"]] = _SPACE
_KINDS[[ord(c) for c in PUNCTUATION]] = _MARK
_WIDE_SPACES = [c.encode() for c in WHITE_SPACE if c >= "\x80"]
_LEADS = np.isin(np.arange(256), [c[0] for c in _WIDE_SPACES])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of normalized texts, equal for equal words, and how many words stand before each border of texts."""
    data, borders = _utf8(column)
    kinds = _KINDS[data]
    leads = np.flatnonzero(_LEADS[data])
    for space in _WIDE_SPACES if len(leads) else ():
        fits = leads[leads + len(space) <= len(data)]
        for i, byte in enumerate(space):
            fits = fits[data[fits + i] == byte]
        for i in range(len(space)):
            kinds[fits + i] = _SPACE
    kept = kinds != _MARK
    data, inside, borders = data[kept], kinds[kept] != _SPACE, _before(kept)[borders]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    within = borders[(borders > 0) & (borders < len(data))]
    begins[within] = inside[within]
    starts, letters = np.flatnonzero(begins), data[inside]
    ends = np.append(_before(inside)[starts], len(letters))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), np.searchsorted(starts, borders)


@F.arrow_udf(T.StructType([T.StructField("f1", T.DoubleType()), T.StructField("same", T.BooleanType())]))
def word_scores(predictions: pa.Array, truths: pa.Array) -> pa.Array:
    """Of texts in lower case: the best F1 of the words of a text and of each of an array of texts, repeated words counted, and whether one has the same words in order."""
    return _sliced(_word_scores, predictions, truths)


def _word_scores(predictions: pa.Array, truths: pa.Array) -> pa.Array:
    flat, owner, _ = _listed(truths)
    n, both = len(predictions), pa.concat_arrays([predictions, flat.cast(predictions.type)])
    words, borders = _words(both)
    sizes, kinds = np.diff(borders), int(words.max(initial=0)) + 1
    ours, own = sizes[:n][owner], sizes[n:]
    text_of, split = np.repeat(np.arange(len(both)), sizes), borders[n]
    there = text_of[split:] - n  # the truth of each of their words
    counted, times = np.unique(text_of[:split] * kinds + words[:split], return_counts=True)
    theirs, their_times = np.unique(there * kinds + words[split:], return_counts=True)
    truth, word = theirs // kinds, theirs % kinds
    common = np.zeros(len(flat))
    if len(counted):
        sought = owner[truth] * kinds + word
        at = np.minimum(np.searchsorted(counted, sought), len(counted) - 1)
        common = np.bincount(truth, np.where(counted[at] == sought, np.minimum(times[at], their_times), 0), len(flat))
    best = np.zeros(n)
    np.maximum.at(best, owner, np.where(common > 0, 2.0 * common / np.maximum(ours + own, 1), 0.0))
    level = (ours == own)[there]
    across = borders[owner[there[level]]] + (np.arange(split, len(words)) - borders[n:-1][there])[level]
    equal = np.bincount(there[level], words[across] == words[split:][level], len(flat))
    same = np.bincount(owner, (ours == own) & (equal == own), n) > 0
    return pa.StructArray.from_arrays([pa.array(best), pa.array(same)], ["f1", "same"])


# --- words and letters -------------------------------------------------------------------------------------------------


def normalized(c: Column) -> Column:
    """Lower case without ASCII punctuation, white space squeezed."""
    return squeeze(F.translate(F.lower(text(c)), PUNCTUATION, ""))


def exact_match(prediction: Column, truths: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(truths, normalized), normalized(prediction)), F.lit(False)).cast("double")


def words_of(normal: Column) -> Column:
    """The words of a normalized text."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def tokens(c: Column) -> Column:
    return words_of(normalized(c))


def token_overlap(words: Column, truths: Column) -> Column:
    """The best F1 of words and those of each truth, repeated words counted; both are columns of words, made before."""

    def score(g: Column) -> Column:
        both = F.array_intersect(words, g)
        times = lambda some, w: F.size(some) - F.size(F.array_remove(some, w))
        once = (F.size(F.array_distinct(g)) == F.size(g)) | (F.size(F.array_distinct(words)) == F.size(words))
        counted = bound(both, lambda same: F.when(once | (F.size(same) == 0), F.size(same)).otherwise(F.aggregate(same, F.lit(0), lambda sum_, w: sum_ + F.least(times(words, w), times(g, w)))))
        return bound(counted, lambda common: F.when(common > 0, 2.0 * common / (F.size(words) + F.size(g))).otherwise(0.0))

    return F.coalesce(F.array_max(F.transform(truths, score)), F.lit(0.0))


def token_f1(prediction: Column, truths: Column) -> Column:
    """As one expression, for short answers; on long ones make the words a column first (evaluation.scored does)."""
    return token_overlap(tokens(prediction), F.transform(truths, lambda t: tokens(text(t))))


def mcq_letter(prediction: Column, choices: int = 8) -> Column:
    """The letter that a response chooses, by six rules in order; empty if none applies."""
    upper = "ABCDEFGH"[: max(1, min(choices, 8))]
    letter = f"[{upper}{upper.lower()}]"
    t = strip(text(prediction))
    rules = (
        rf"(?iU)(?:answer|정답)\s*[:\-]?\s*\(?({letter})\)?",
        rf"(?U)^\s*\(?({letter})\)?[.):\s]",
        rf"\(({letter})\)",
        rf"^({letter})$",
        rf"(?U)\b({letter})\b",
        rf"^({letter})",
    )
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(t, r, 1), F.lit("")) for r in rules], F.lit("")))


def mcq_accuracy(prediction: Column, correct: Column, choices: int = 8) -> Column:
    got = mcq_letter(prediction, choices)
    return F.when(got == "", 0.0).otherwise((got == F.substring(F.upper(strip(text(correct))), 1, 1)).cast("double"))


def final_answer(prediction: Column, multiple_choice: Column | bool = False) -> Column:
    """The final answer of a long response: boxed, tagged, phrased, a letter, or its last line."""
    t = strip(text(prediction))
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    found = [first(r"\\boxed\{([^\}]+)\}"), first(r"(?i)ANSWER\s*:\s*(.+)"), *[first(p) for p in ANSWER_PHRASES]]
    choice = multiple_choice if isinstance(multiple_choice, Column) else F.lit(multiple_choice)
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    letter = F.when(choice, F.nullif(mcq_letter(t), F.lit("")))
    return F.coalesce(strip(F.coalesce(*found)), letter, F.try_element_at(lines, F.lit(-1)), F.lit(""))


def number(c: Column) -> Column:
    return F.regexp_extract(F.replace(F.replace(strip(text(c)), F.lit(",")), F.lit("%")), r"-?\d+\.?\d*", 0).try_cast("double")


def relaxed_accuracy(prediction: Column, truths: Column, tolerance: float = 0.05) -> Column:
    """1 if the final answer equals a truth, or is a number within the tolerance of it."""
    answer = final_answer(prediction)
    p, n = normalized(answer), number(answer)

    def near(t: Column) -> Column:
        g = number(t)
        close = F.when(g == 0, F.abs(n) <= tolerance).otherwise(F.abs(n - g) / F.abs(g) <= tolerance)
        return (normalized(t) == p) | F.coalesce(close, F.lit(False))

    return F.coalesce(F.exists(truths, near), F.lit(False)).cast("double")


def keywords(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)\b[a-zA-Z]{4,}\b"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?U)\b\d+\.?\d*\b"), F.lit(0)))


#: From this length on SequenceMatcher leaves frequent letters out, so such texts go to it.
_AUTOJUNK = 200


def _longest_match(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest block that a[alo:ahi] and b[blo:bhi] share, the earliest in a, then in b: its places and its length.

    A longer block than the best so far is looked for at each place of a by whole-string searches, its length by doubling
    and halving, so near copies cost a few searches and no table of letters is made.
    """
    size = at = to = 0
    for i in range(alo, ahi):
        most = ahi - i
        if most <= size:
            break
        there = b.find(a[i : i + size + 1], blo, bhi)
        if there < 0:
            continue
        low, step = size + 1, 1
        while low < most:  # of length `low` is found; try further by 1, 2, 4, ...
            further = min(low + step, most)
            next_ = b.find(a[i : i + further], there, bhi)
            if next_ < 0:
                break
            low, there, step = further, next_, 2 * step
        high = min(low + step, most + 1)
        while high - low > 1:  # of length `high` is not
            middle = (low + high) // 2
            next_ = b.find(a[i : i + middle], there, bhi)
            if next_ < 0:
                high = middle
            else:
                low, there = middle, next_
        size, at, to = low, i, there
    return at, to, size


def sequence_ratio(a: str, b: str) -> float:
    """difflib's SequenceMatcher(None, a, b).ratio(), with the same blocks in the same order."""
    if len(b) >= _AUTOJUNK:
        from difflib import SequenceMatcher

        return SequenceMatcher(None, a, b).ratio()
    same, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, k = _longest_match(a, alo, ahi, b, blo, bhi)
        if k:
            same += k
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi))
    return 2.0 * same / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sequence_ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The matching-blocks ratio of a text to each of an array of texts; no built-in function computes it."""
    for predictions, truths in batches:
        yield pd.Series([[sequence_ratio(p or "", g or "") for g in ([] if gs is None else gs)] for p, gs in zip(predictions, truths)])


def with_crossdoc_score(rows: DataFrame, prediction: Column, truths: Column, name: str = "crossdoc") -> DataFrame:
    """The rows with a struct of score and method; ratios are computed first, as lambdas cannot call Python."""
    ratios = sequence_ratios(_folded(prediction), F.transform(truths, _folded))
    return rows.withColumn(f"{name}_ratios", ratios).withColumn(name, crossdoc_score(prediction, truths, F.col(f"{name}_ratios"))).drop(f"{name}_ratios")


def _folded(c: Column) -> Column:
    return squeeze(F.lower(text(c)))


def crossdoc_score(prediction: Column, truths: Column, ratios: Column) -> Column:
    """A struct of score and method over five comparisons, truth by truth; the first containment or equal numbers end it."""
    read = lambda t: F.struct(t.alias("t"), numbers(t).alias("n"), keywords(t).alias("k"))

    def facts(p: Column, g: Column, i: Column) -> Column:
        pn, gn, gk = p["n"], g["n"], g["k"]
        common = F.size(F.array_intersect(gn, pn))  # of distinct numbers
        recall = F.size(F.array_intersect(gk, p["k"])) / F.size(gk)
        return F.struct(
            (g["t"] != "").alias("some"),
            (p["t"].contains(g["t"]) | g["t"].contains(p["t"])).alias("contain"),
            ((F.size(gn) > 0) & (F.size(gn) == F.size(pn)) & (common == F.size(gn))).alias("exact"),
            ((F.size(gn) > 0) & (common > 0)).alias("partial"),
            F.when(F.size(gk) > 0, recall).otherwise(-1.0).alias("recall"),
            F.get(ratios, i).alias("ratio"),
        )

    best = lambda score, method, final: F.struct(score.cast("double").alias("score"), method.alias("method"), final.alias("final"))
    no = F.lit(False)

    def step(b: Column, f: Column) -> Column:
        b1 = F.when(f["partial"] & (b["score"] < 0.7), best(F.lit(0.7), F.lit("num_partial"), no)).otherwise(b)
        b2 = F.when((f["recall"] >= 0.7) & (b1["score"] < 0.8), best(F.lit(0.8), F.lit("kw_high"), no)).when((f["recall"] >= 0.4) & ~((f["recall"] >= 0.7) & (b1["score"] < 0.8)) & (b1["score"] < 0.5), best(F.lit(0.5), F.lit("kw_mid"), no)).otherwise(b1)
        b3 = F.when((f["ratio"] >= 0.5) & (f["ratio"] > b2["score"]), best(f["ratio"], F.lit("seq"), no)).otherwise(b2)
        return (
            F.when(b["final"] | ~f["some"], b)
            .when(f["contain"], best(F.lit(1.0), F.lit("contain"), F.lit(True)))
            .when(f["exact"], best(F.lit(1.0), F.lit("num_exact"), F.lit(True)))
            .otherwise(b3)
        )

    golds = F.transform(truths, lambda t: bound(_folded(t), read))
    known = bound(bound(_folded(prediction), read), lambda p: F.transform(golds, lambda g, i: facts(p, g, i)))
    got = F.aggregate(known, best(F.lit(0.0), F.lit("no_match"), no), step)
    empty = (text(prediction) == "") | (F.coalesce(F.size(truths), F.lit(0)) <= 0)
    return F.when(empty, best(F.lit(0.0), F.lit("empty"), no)).otherwise(got)


def korean_normalized(c: Column) -> Column:
    t = F.regexp_replace(F.lower(strip(text(c))), r"(?U)[,\s]+", " ")
    return squeeze(F.regexp_replace(t, r"[.。!?~\"'()\[\]]", " "))


def korean_numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.replace(text(c), F.lit(",")), F.lit(r"(?U)-?\d+(?:\.\d+)?"), F.lit(0))


def korean_tokens(c: Column) -> Column:
    def bare(w: Column) -> Column:
        out = w
        for ending in reversed(KOREAN_ENDINGS):  # the first that fits is taken off
            out = F.when(w.endswith(ending) & (F.length(w) > len(ending)), F.substring(w, F.lit(1), F.length(w) - len(ending))).otherwise(out)
        return F.regexp_replace(out, KOREAN_PARTICLE, "")

    return F.array_distinct(F.filter(F.transform(F.split(korean_normalized(c), " "), bare), lambda x: F.length(x) >= 2))


def korean_vqa_accuracy(prediction: Column, gold: Column, answer_type: Column | None = None) -> Column:
    """1 if a number of the gold answer is found (numeric answers), or by containment, content words, or their F1."""
    kind = text(answer_type) if answer_type is not None else F.lit("")
    p, g = korean_normalized(prediction), korean_normalized(gold)
    gn, pn = korean_numbers(gold), korean_numbers(prediction)
    numeric = (kind == "수치형") | ((F.size(gn) > 0) & (kind == ""))
    found = F.exists(gn, lambda x: F.exists(pn, lambda y: (x == y) | (F.abs(x.try_cast("double") - y.try_cast("double")) < 1e-6)))
    gt, pt = korean_tokens(gold), korean_tokens(prediction)
    common = F.size(F.array_intersect(gt, pt))
    worded = (F.size(gt) > 0) & (F.size(pt) > 0) & ((common == F.size(gt)) | ((common > 0) & (2.0 * common / (F.size(gt) + F.size(pt)) >= 0.5)))
    right = (numeric & found) | ((g != "") & (p.contains(g) | g.contains(p))) | worded
    return F.when((text(prediction) == "") | (text(gold) == ""), 0.0).otherwise(right.cast("double"))
