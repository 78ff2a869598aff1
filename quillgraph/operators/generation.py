"""Questions and answers from a model: prompts, rounds of sampling, and what is kept of the outputs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_answer, clean_content, clean_question, fill, fill_by, names_in, text
from ..sources.scratch import staged
from ..templates import ANSWER_PROMPT, COMMON_RULES, LANGUAGE_NAMES, QUESTION_PROMPTS
from .enrichment import Backend, model
from .evaluation import fallback_question
from .pairs import best_generations, usable_bundle

NO_CONTENT, IMAGE_HINT = "(nothing)", "(A picture comes with this.)"
CONTENT_CHARS, GOLD_CHARS = 500, 200


def language_name(language: str) -> str:
    return LANGUAGE_NAMES.get(language, language)


def question_prompt(language: str = "ko", template: str | None = None, with_context: bool = True) -> Column:
    """The prompt of a described path: by its first edge, or from a template of one's own.

    All names are filled at once, so texts that hold names in braces stay as they are.  A template of one's own that has
    an unknown name gives way to the default one.
    """
    first, last = F.get("nodes", F.lit(0)), F.element_at("nodes", -1)
    edge = F.get("edge_types", F.lit(0))
    content = lambda x: F.coalesce(F.nullif(clean_content(x["content"], CONTENT_CHARS), F.lit("")), F.lit(NO_CONTENT))
    values = {
        "common_rules": fill(COMMON_RULES, {"language": F.lit(language_name(language))}), "language": F.lit(language_name(language)), "src_type": first["node_type"], "dst_type": last["node_type"],
        "edge_type": F.coalesce(edge, F.lit("SINGLE")), "difficulty": F.col("difficulty").cast("string"),
        "image_hint": F.when(F.size("image_paths") > 0, IMAGE_HINT).otherwise(""), "kg_context": F.col("context") if with_context else F.lit(""),
        "gold_answer": F.substring(text(F.col("gold_answer")), 1, GOLD_CHARS), "src_content": content(first), "dst_content": content(last),
    }
    values = {k: text(v) for k, v in values.items()}
    if template:
        return fill(known_names(template, set(values), QUESTION_PROMPTS["DEFAULT"]), values)
    return fill_by(F.coalesce(edge, F.lit("SINGLE")), QUESTION_PROMPTS, "DEFAULT", values)


def answer_prompt(question: Column, language: str = "ko", template: str = ANSWER_PROMPT) -> Column:
    """The prompt of a question; a template that has an unknown name gives way to the default one."""
    return fill(known_names(template, {"language", "question"}, ANSWER_PROMPT), {"language": F.lit(language_name(language)), "question": text(question)})


def known_names(template: str, names: set[str], default: str) -> str:
    unknown = [n for n in names_in(template) if n not in names]
    if unknown:
        warnings.warn(f"unknown names {unknown} in a prompt; known are {sorted(names)}", stacklevel=3)
    return default if unknown else template


def infer_n(prompts: DataFrame, name: str, factory: Callable[[], Backend], temperature: float) -> DataFrame:
    """id, at and raw: `need` outputs for each prompt (id, prompt, images, need); a failed call gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = model(name, factory)
        for rows in batches:
            out = []
            for id_, prompt, images, need in zip(rows["id"], rows["prompt"], rows["images"], rows["need"]):
                try:
                    raws = backend.infer_n(prompt, list(images) if images is not None else [], int(need), temperature)
                except Exception:  # as if the model had said nothing
                    raws = []
                out += [(id_, at, raw) for at, raw in enumerate(raws)]
            yield pd.DataFrame(out, columns=["id", "at", "raw"])

    return prompts.select("id", "prompt", "images", "need").mapInPandas(run, "id string, at int, raw string")


def sampled(prompts: DataFrame, name: str, factory: Callable[[], Backend], n: int, temperatures: tuple[float, ...], clean: Callable[[Column], Column]) -> DataFrame:
    """id, attempt and text: up to n different outputs of each prompt (id, prompt, images).

    Each round asks, at its temperature, for what is still missing; what differs in white space only is one output.
    Outputs are cleaned as they are written, so each is cleaned once.
    """
    found, kept = None, None
    short = prompts.withColumn("need", F.lit(n))
    for number, temperature in enumerate(temperatures):
        raw = infer_n(short, name, factory, temperature)
        new = staged(raw.select("id", (F.lit(number * 1_000_000) + F.col("at")).alias("attempt"), clean(F.col("raw")).alias("text")), "outputs")
        found = new if found is None else found.unionByName(new)
        kept = best_generations(found, n, F.col("text"))
        have = kept.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("have"))
        short = prompts.join(have, "id", "left").withColumn("need", n - F.coalesce("have", F.lit(0))).where("need > 0").drop("have")
    return kept


def questions(paths: DataFrame, name: str, factory: Callable[[], Backend], n: int = 3, temperature: float = 0.8, language: str = "ko", template: str | None = None) -> DataFrame:
    """try, attempt, question and question_source: up to n questions on each described path, or the rule-based one.

    The first round is cooler than the two after it, which fill up what it lacks.
    """
    prompts = paths.select(F.col("try").cast("string").alias("id"), question_prompt(language, template).alias("prompt"), F.col("image_paths").alias("images"))
    got = sampled(prompts, name, factory, n, (max(0.3, temperature - 0.3), temperature, temperature), clean_question)
    edge, first, last = F.get("edge_types", F.lit(0)), F.get("nodes", F.lit(0)), F.element_at("nodes", -1)
    rows = paths.select("try", fallback_question(edge, first["node_type"], last["node_type"]).alias("rule"))
    joined = rows.join(got.select(F.col("id").cast("bigint").alias("try"), "attempt", "text"), "try", "left")
    return joined.select("try", F.coalesce("attempt", F.lit(0)).alias("attempt"), F.coalesce("text", "rule").alias("question"), F.when(F.col("text").isNull(), "fallback").otherwise("auto").alias("question_source"))


def answers(asked: DataFrame, name: str, factory: Callable[[], Backend], n: int = 3, temperature: float = 0.9, language: str = "ko", template: str = ANSWER_PROMPT) -> DataFrame:
    """id, candidates and is_usable: up to n different answers to each question (id, question, images), ever hotter while some are missing."""
    prompts = asked.select(F.col("id").cast("string").alias("id"), answer_prompt(F.col("question"), language, template).alias("prompt"), "images")
    got = sampled(prompts, name, factory, n, (temperature, min(1.2, temperature + 0.2), min(1.5, temperature + 0.5)), clean_answer)
    lists = got.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "text"))), lambda x: x["text"]).alias("candidates"))  # at most n each
    joined = prompts.select("id").join(lists, "id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return joined.withColumn("is_usable", usable_bundle(F.col("candidates")))
