"""Evaluation: metrics over predictions, held-out splits, drafts and frozen evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import counted_anls, mcq_accuracy, short_distances, word_scores
from ..functions.sampling import hash_order
from ..functions.text import GOLD_LENGTH, fill, fill_by, has_text, is_usable_gold, label_kind, particle, squeeze, strip, strip_caption_label, text
from ..schema import VISUAL_TYPES
from .order import numbered

HELD_OUT, DRAFT_CONTEXT, KG_GOLD, KG_LEAST = 40, 800, 200, 10
# What a node is called, the questions of drafts, and the fallback questions.
NODE_NAMES = {"Figure": "그림", "Table": "표", "Equation": "수식", "TextBlock": "본문", "Concept": "개념", "Claim": "주장", "Paper": "논문"}
TARGET_KINDS = {"Figure": "figure", "Table": "table", "Equation": "equation"}
DRAFT_QUESTIONS = {
    "HAS_CAPTION": "{target_eun} 무엇을 나타내는가?",
    "QUANTIFIES": "{target}에 제시된 수치는 얼마인가?",
    "DEFINES": "{target}에서 설명하는 개념은 무엇으로 정의되는가?",
    "REFERENCES": "본문이 참조하는 {target_eun} 무엇을 보여주는가?",
    "COMPARES": "{target}에서 비교되는 두 대상의 차이는 무엇인가?",
    "SUPPORTS": "{target_i} 뒷받침하는 주장은 무엇인가?",
    "SINGLE": "{target_eun} 무엇을 나타내는가?",
}
FALLBACK_QUESTIONS = {
    "HAS_CAPTION": "이 {src_eun} 무엇을 보여주는지 설명해 주세요.",
    "REFERENCES": "본문에서 언급한 내용을 이 {dst_i} 어떻게 뒷받침하는지 설명해 주세요.",
    "QUANTIFIES": "이 자료에 제시된 주요 수치와 그 의미를 설명해 주세요.",
    "DEFINES": "이 문서에서 해당 개념을 어떻게 정의하고 있는지 설명해 주세요.",
    "COMPARES": "이 자료에서 비교되는 두 대상의 차이를 설명해 주세요.",
    "SUPPORTS": "이 근거가 주장을 어떻게 뒷받침하는지 설명해 주세요.",
    "CONTRADICTS": "이 두 내용 사이의 차이점은 무엇인지 설명해 주세요.",
    "SAME_CONCEPT": "두 논문이 이 개념을 각각 어떻게 다루는지 비교해 주세요.",
    "SINGLE": "이 {src_eun} 무엇을 보여주는지 설명해 주세요.",
    "DEFAULT": "이 자료들이 어떤 관계인지 설명해 주세요.",
}


def _from(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def scored(predictions: DataFrame) -> DataFrame:
    """question_type, prediction and ground_truths with anls, accuracy and f1.

    Accuracy is the chosen letter for multiple choice (first truth), exact match otherwise.
    """
    p, g = F.col("prediction"), F.col("ground_truths")
    lower = {"_lower": F.lower(text(p)), "_truths": F.transform(g, lambda t: F.lower(text(t)))}
    compared = {"_distances": short_distances("_lower", "_truths"), "_words": word_scores("_lower", "_truths")}
    choice = (F.col("question_type") == "MCQ") & (F.size(g) > 0)
    accuracy = F.when(choice, mcq_accuracy(p, F.get(g, F.lit(0)))).otherwise(F.col("_words.same").cast("double"))
    scores = {"anls": counted_anls(p, g, F.col("_distances")), "accuracy": accuracy, "f1": F.col("_words.f1")}
    return predictions.withColumns(lower).withColumns(compared).withColumns(scores).drop(*lower, *compared)


def batch_metrics(predictions: DataFrame) -> DataFrame:
    """One row: the means of the three metrics, rounded to four places, 0 without predictions."""
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in ("anls", "accuracy", "f1")]
    return scored(predictions).agg(*means, F.count(F.lit(1)).alias("n"))


def rate(scores: DataFrame, column: str) -> DataFrame:
    """One row: rate, correct (whole) and total of a score."""
    return scores.agg(F.round(F.coalesce(F.avg(column), F.lit(0.0)), 4).alias("rate"), F.floor(F.coalesce(F.sum(column), F.lit(0.0))).alias("correct"), F.count(F.lit(1)).alias("total"))


def evaluated(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Items joined with predictions by question_id; a missing prediction is empty."""
    return scored(items.join(predictions.select("question_id", "prediction"), "question_id", "left").withColumn("prediction", text(F.col("prediction"))))


def split(papers: DataFrame, held_out: int = HELD_OUT, seed: int = 42) -> DataFrame:
    """paper_id and split: the first papers of a hashed order are held out, never all of them.

    One more than is held out is looked at; if there are no more papers than that, the last of them is collected.
    """
    known = papers.select("paper_id").distinct()
    key = hash_order(seed, F.col("paper_id"))
    first = known.select("paper_id", key.alias("key")).orderBy("key", "paper_id").limit(held_out + 1)
    place = F.row_number().over(Window.orderBy("key", "paper_id"))  # at most held_out + 1 rows
    n = F.count(F.lit(1)).over(Window.partitionBy())
    held = first.withColumn("place", place).withColumn("n", n).where("place < n").select("paper_id", F.lit("held_out").alias("split"))
    return known.join(held, "paper_id", "left").withColumn("split", F.coalesce("split", F.lit("collect")))


def extended_split(known: DataFrame, papers: DataFrame) -> DataFrame:
    """A split with new papers; they are collected, and the held-out ones stay."""
    new = papers.select("paper_id").distinct().join(known, "paper_id", "left_anti")
    return known.select("paper_id", "split").unionByName(new.withColumn("split", F.lit("collect")))


def overlap(held_out: DataFrame, collected: DataFrame) -> DataFrame:
    """Papers that are on both sides, sorted: none, if nothing leaks."""
    return held_out.select("paper_id").intersect(collected.select("paper_id")).orderBy("paper_id")


def confirmed(draft: DataFrame, ids: DataFrame, collected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chosen items of a draft, the ids that it lacks, and the papers that leak."""
    chosen = draft.join(ids.select("question_id").distinct(), "question_id", "left_semi")
    missing = ids.select("question_id").distinct().join(draft, "question_id", "left_anti")
    return chosen, missing, overlap(chosen, collected)


def statistics(items: DataFrame) -> DataFrame:
    """dimension, value and n: total, papers, with_image, and counts by type and difficulty."""
    totals = items.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("paper_id").alias("papers"), F.count_if(F.coalesce(F.size("image_paths"), F.lit(0)) > 0).alias("with_image"))
    out = totals.select(F.expr("stack(3, 'total', total, 'papers', papers, 'with_image', with_image)").alias("dimension", "n")).select("dimension", F.lit(None).cast("string").alias("value"), "n")
    values = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in ("question_type", "difficulty")])).alias("x")
    return out.unionByName(items.select(values).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n")))


def sample(items: DataFrame, n: int, seed: int = 42, key: str = "question_id") -> DataFrame:
    return items.orderBy(hash_order(seed, F.col(key)), key).limit(n)


# The question on a figure or table, and on one that only a model has described.
GRAPH_QUESTION, DESCRIBED_QUESTION, DESCRIBED = "What does this {kind} show or describe?", "Based on the description, what is the main finding shown?", "[VLM]"


def from_graph(nodes: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Items on figures and tables: n drawn first, then those with too little content dropped; numbered from 1 in the order drawn."""
    visual = nodes.where(F.col("node_type").isin(*VISUAL_TYPES)).withColumn("key", hash_order(seed, F.col("node_id"))).orderBy("key", "node_id").limit(n)
    rows = visual.where(F.length(strip(text(F.col("content")))) >= KG_LEAST)
    number = F.row_number().over(Window.orderBy("key", "node_id"))  # at most n rows
    question = F.when(F.col("content").startswith(DESCRIBED), DESCRIBED_QUESTION).otherwise(fill(GRAPH_QUESTION, {"kind": F.lower("node_type")}))
    return rows.select(
        F.format_string("kg_%06d", number).alias("question_id"), question.alias("question"), F.lit("VQA").alias("question_type"),
        F.array(F.substring("content", 1, KG_GOLD)).alias("ground_truths"), F.when(F.col("image_path").isNotNull(), F.array("image_path")).otherwise(F.array().cast("array<string>")).alias("image_paths"),
        F.col("content").alias("context"), "paper_id", F.lit(1).alias("difficulty"), "node_id",
    )


def target(nodes: Column) -> Column:
    """The node that a question is about: the first that can be seen, else the first."""
    seen = F.filter(nodes, lambda x: x["node_type"].isin("Figure", "Table", "Equation"))
    return F.coalesce(F.get(seen, F.lit(0)), F.get(nodes, F.lit(0)))


def draft_items(paths: DataFrame, require_hangul: bool = True) -> DataFrame:
    """Question, truths and context of described paths whose gold answer can be used."""
    raw = squeeze(text(F.col("gold_answer")))
    kind = _from(TARGET_KINDS, F.col("target_type"), F.lit(None).cast("string"))
    rows = paths.withColumn("raw", raw).withColumn("target_type", target(F.col("nodes"))["node_type"])
    rows = rows.where((F.col("raw") != "") & ~F.coalesce(label_kind(F.col("raw")) != kind, F.lit(False)))
    rows = rows.withColumn("gold", strip_caption_label(F.col("raw"))).where(F.length("gold").between(*GOLD_LENGTH) & is_usable_gold(F.col("gold"), require_hangul))
    name = F.when(F.col("target_type").isin(*TARGET_KINDS), _from(NODE_NAMES, F.col("target_type"), F.lit("자료"))).otherwise("자료")
    edge = F.coalesce(F.get("edge_types", F.lit(0)), F.lit("SINGLE"))
    this = F.concat(F.lit("이 "), name)
    question = fill_by(edge, DRAFT_QUESTIONS, "SINGLE", {"target_eun": F.concat(this, particle(name, "은", "는")), "target_i": F.concat(this, particle(name, "이", "가")), "target": this})
    truths = F.array_distinct(F.array("gold", "raw"))
    return rows.select("try", "paper_id", question.alias("question"), "question_type", truths.alias("ground_truths"), "image_paths", F.substring("context", 1, DRAFT_CONTEXT).alias("context"), "difficulty", "path")


def round_robin(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to n items, one paper after another: each paper's first, then each one's second, and so on; numbered ids."""
    own = F.row_number().over(Window.partitionBy("paper_id").orderBy(hash_order(seed, F.col("item_id")), "item_id"))
    dealt = items.withColumn("turn", own).orderBy("turn", "paper_id").limit(n)
    number = F.row_number().over(Window.orderBy("turn", "paper_id")) - 1  # at most n rows
    return dealt.withColumn("question_id", F.format_string("eko_%06d", number.cast("int")))


def fallback_question(first_edge: Column, src_type: Column, dst_type: Column) -> Column:
    """The rule-based question on a path, without a model."""
    src, dst = (_from(NODE_NAMES, t, F.lit("자료")) for t in (src_type, dst_type))
    return fill_by(F.coalesce(first_edge, F.lit("SINGLE")), FALLBACK_QUESTIONS, "DEFAULT", {"src_eun": F.concat(src, particle(src, "은", "는")), "dst_i": F.concat(dst, particle(dst, "이", "가"))})


def prompt(template: str, values: dict[str, Column], longest: int = 500) -> Column:
    """A prompt from a template; a name without a value gets an empty text."""
    return fill(template, {k: F.substring(text(v), 1, longest) for k, v in values.items()}, missing=F.lit(""))


def collectable(papers: DataFrame, languages: DataFrame, language: str | None, held_out: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The papers to collect from: of the language, not held out, the first `limit` by name."""
    out = papers.select("paper_id").distinct()
    if language is not None:
        out = out.join(languages.where(F.col("language") == language), "paper_id", "left_semi")
    if held_out is not None:
        out = out.join(held_out.select("paper_id").distinct(), "paper_id", "left_anti")
    out = out.orderBy("paper_id")
    return out.limit(limit) if limit else out


def step_paper(papers: DataFrame, step: int = 1) -> DataFrame:
    """Each paper with the one that is `step` places on, around the end."""
    ranked = numbered(papers.select("paper_id").distinct(), ["paper_id"])
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    there = ranked.select(F.col("paper_id").alias("next_paper_id"), F.col("place").alias("next_place"))
    ranked = ranked.crossJoin(n)  # one row
    return ranked.withColumn("next_place", F.pmod(F.col("place") + step, F.col("n"))).join(there, "next_place").select("paper_id", "next_paper_id")


def of_type(items: DataFrame, question_type: str) -> DataFrame:
    return items.where(F.col("question_type") == question_type)


def of_difficulty(items: DataFrame, difficulty: int) -> DataFrame:
    return items.where(F.col("difficulty") == difficulty)


def readable(items: DataFrame) -> DataFrame:
    """Items that can be asked: with a question and at least one truth."""
    return items.where(has_text(F.col("question")) & (F.size("ground_truths") > 0))
