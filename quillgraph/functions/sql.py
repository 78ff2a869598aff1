"""Metrics as SQL functions of the session; their bodies are SQL, so Catalyst inlines them into plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .metrics import PUNCTUATION

_STRIP = r"regexp_replace(coalesce({}, ''), '(?U)^\\s+|\\s+$', '')"
_FOLD = "lower(" + _STRIP + ")"
_MARKS = PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'")
_NORM = r"regexp_replace(regexp_replace(translate(lower(coalesce({}, '')), '" + _MARKS.replace("{", "{{").replace("}", "}}") + r"', ''), '(?U)\\s+', ' '), '^ | $', '')"
_DISTANCE = f"CASE WHEN greatest(length({_FOLD.format('a')}), length({_FOLD.format('b')})) = 0 THEN 0D WHEN least(length({_FOLD.format('a')}), length({_FOLD.format('b')})) = 0 THEN 1D ELSE levenshtein({_FOLD.format('a')}, {_FOLD.format('b')}) / greatest(length({_FOLD.format('a')}), length({_FOLD.format('b')})) END"


def _with(expression: str, a: str, b: str) -> str:
    return f"({expression})".replace("coalesce(a,", f"coalesce({a},").replace("coalesce(b,", f"coalesce({b},")


_BETWEEN = _with(_DISTANCE, "prediction", "t")
_TOKENS = "filter(split(" + _NORM + ", ' '), w -> w <> '')"
_P, _T = _TOKENS.format("prediction"), _TOKENS.format("t")
_COMMON = "aggregate(array_intersect(x.p, x.g), 0, (s, w) -> s + least(size(x.p) - size(array_remove(x.p, w)), size(x.g) - size(array_remove(x.g, w))))"
_F1 = f"coalesce(array_max(transform(transform(truths, t -> named_struct('p', {_P}, 'g', {_T})), x -> CASE WHEN {_COMMON} > 0 THEN 2D * {_COMMON} / (size(x.p) + size(x.g)) ELSE 0D END)), 0D)"
_RULES = (r"(?iU)(?:answer|정답)\\s*[:\\-]?\\s*\\(?([A-Ha-h])\\)?", r"(?U)^\\s*\\(?([A-Ha-h])\\)?[.):\\s]", r"\\(([A-Ha-h])\\)", "^([A-Ha-h])$", r"(?U)\\b([A-Ha-h])\\b", "^([A-Ha-h])")
_LETTER = "upper(coalesce(" + ", ".join(f"nullif(regexp_extract({_STRIP.format('prediction')}, '{r}', 1), '')" for r in _RULES) + ", ''))"
FUNCTIONS = {
    "edit_distance(a STRING, b STRING) RETURNS DOUBLE": _DISTANCE,
    "anls(prediction STRING, truths ARRAY<STRING>) RETURNS DOUBLE": f"coalesce(array_max(transform(truths, t -> CASE WHEN {_BETWEEN} > 0.5D THEN 0D ELSE 1D - {_BETWEEN} END)), 0D)",
    "normalized(a STRING) RETURNS STRING": _NORM.format("a"),
    "token_f1(prediction STRING, truths ARRAY<STRING>) RETURNS DOUBLE": _F1,
    "mcq_letter(prediction STRING) RETURNS STRING": _LETTER,
    "exact_match(prediction STRING, truths ARRAY<STRING>) RETURNS DOUBLE": f"CAST(coalesce(exists(truths, t -> {_NORM.format('t')} = {_NORM.format('prediction')}), false) AS DOUBLE)",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
