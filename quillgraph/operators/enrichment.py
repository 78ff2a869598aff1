"""The relational parts of model enrichment.  Model responses come in as a table; a model itself is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import concept_lines, enriched, relation
from ..schema import CONCEPT_CONFIDENCE, CONCEPT_WEIGHT, RELATION_CONFIDENCE, RELATION_WEIGHT

MOST_TEXTS, NEAR_TEXTS, LONG_TEXT, CONCEPT_TEXT = 30, 3, 50, 100


class Backend(Protocol):
    """What a model must offer; it is loaded once in each Python worker."""

    def load(self) -> None: ...
    def infer(self, prompt: str, images: list[str], temperature: float) -> str: ...
    def infer_n(self, prompt: str, images: list[str], n: int, temperature: float) -> list[str]: ...
    def encode(self, texts: list[str]) -> list[list[float]]: ...
    def logprob(self, prompt: str, images: list[str], answer: str) -> float: ...
    def set_adapter_enabled(self, enabled: bool) -> None: ...
    def unload(self) -> None: ...


_models: dict[str, Backend] = {}


def model(name: str, factory: Callable[[], Backend]) -> Backend:
    """The worker's model of this name, loaded once."""
    if name not in _models:
        _models[name] = factory()
        _models[name].load()
    return _models[name]


def unload(name: str | None = None) -> None:
    """Lets go of one model of this process, or of all."""
    for key in [name] if name is not None else list(_models):
        if (held := _models.pop(key, None)) is not None and hasattr(held, "unload"):
            held.unload()


def embed(nodes: DataFrame, name: str, factory: Callable[[], Backend]) -> DataFrame:
    """node_id and embedding of nodes' contents; the model has encode(list of texts), which gives a vector for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = model(name, factory)
        for rows in batches:
            vectors = encoder.encode([x or "" for x in rows["content"]])
            yield pd.DataFrame({"node_id": rows["node_id"], "embedding": [[float(x) for x in v] for v in vectors]})

    return nodes.select("node_id", "content").mapInPandas(run, "node_id string, embedding array<float>")


def infer(prompts: DataFrame, name: str, factory: Callable[[], Backend], temperature: float = 0.0) -> DataFrame:
    """Prompts (id, prompt, images) with a response; a failed call gives an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = model(name, factory)
        for rows in batches:
            out = []
            for prompt, images in zip(rows["prompt"], rows["images"]):
                try:
                    out.append(backend.infer(prompt, list(images) if images is not None else [], temperature))
                except Exception:  # a model's failure is an empty response, as an evaluation expects
                    out.append("")
            yield pd.DataFrame({"id": rows["id"], "response": out})

    return prompts.mapInPandas(run, "id string, response string")


def log_probabilities(rows: DataFrame, policy: tuple[str, Callable[[], Backend]], reference: tuple[str, Callable[[], Backend]]) -> DataFrame:
    """pair_id with the four log-probabilities that the loss needs, from rows (pair_id, question, image_paths, chosen, rejected)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {"policy": model(*policy), "ref": model(*reference)}
        for part in batches:
            out = {"pair_id": part["pair_id"]}
            for who, backend in models.items():
                for answer in ("chosen", "rejected"):
                    said = zip(part["question"], part["image_paths"], part[answer])
                    out[f"{who}_{answer}"] = [float(backend.logprob(q, list(i) if i is not None else [], a)) for q, i, a in said]
            yield pd.DataFrame(out)

    columns = rows.select("pair_id", "question", "image_paths", "chosen", "rejected")
    return columns.mapInPandas(run, "pair_id string, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")


def visual_nodes(nodes: DataFrame) -> DataFrame:
    """All figures and tables with an image, however many a paper has."""
    return nodes.where(F.col("node_type").isin("Figure", "Table") & F.col("image_path").isNotNull())


def concept_sources(nodes: DataFrame, most: int = MOST_TEXTS) -> DataFrame:
    plain = ~F.coalesce("is_caption", F.lit(False)) & ~F.coalesce("is_section", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("seq"))
    return nodes.where((F.col("node_type") == "TextBlock") & (F.length("content") > CONCEPT_TEXT) & plain).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def visual_text_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """text_id and visual_id to be related: the pairs that references give; in papers without any, for every figure the first texts near.

    Near means the same page, or the pages beside it if the page has no text; the range join runs on page keys.  The first
    texts of some pages are among the first texts of each, so a figure meets no more of a page, however full it is.
    """
    seen = nodes.where(F.col("node_type").isin("Figure", "Table")).select(F.col("node_id").alias("dst_id"), "paper_id")
    sources = nodes.select(F.col("node_id").alias("src_id"))
    referred = edges.where("edge_type = 'REFERENCES'").join(seen, "dst_id").join(sources, "src_id", "left_semi").select("paper_id", F.col("src_id").alias("text_id"), F.col("dst_id").alias("visual_id"))
    visual = visual_nodes(nodes).join(referred.select("paper_id").distinct(), "paper_id", "left_anti")
    visual = visual.select("paper_id", F.col("node_id").alias("visual_id"), F.col("page").alias("own_page"), F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"))
    texts = nodes.where((F.col("node_type") == "TextBlock") & (F.length("content") > LONG_TEXT)).select("paper_id", "page", F.col("node_id").alias("text_id"), "seq")
    first = F.row_number().over(Window.partitionBy("paper_id", "page").orderBy("seq", "text_id"))
    texts = texts.withColumn("first", first).where(F.col("first") <= NEAR_TEXTS).drop("first")
    near = visual.join(texts, ["paper_id", "page"]).withColumn("same", F.col("page") == F.col("own_page"))
    on_page = F.max("same").over(Window.partitionBy("visual_id"))
    near = near.withColumn("on_page", on_page).where("same or not on_page")
    rank = F.row_number().over(Window.partitionBy("visual_id").orderBy("seq", "text_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= NEAR_TEXTS).select("paper_id", "text_id", "visual_id")
    return referred.unionByName(near)


def described_nodes(nodes: DataFrame, responses: DataFrame) -> DataFrame:
    """Nodes whose content gets a model's description (node_id, response)."""
    joined = nodes.join(responses.select("node_id", "response"), "node_id", "left")
    return joined.withColumn("content", F.when(F.col("response").isNotNull(), enriched(F.col("content"), F.col("response"))).otherwise(F.col("content"))).select(*nodes.columns)


def relation_edges(pairs: DataFrame) -> DataFrame:
    """Edges from pairs with a model's response (text_id, visual_id, response, seq)."""
    return pairs.select(
        F.col("text_id").alias("src_id"), F.col("visual_id").alias("dst_id"), relation(F.col("response")).alias("edge_type"),
        F.lit(RELATION_WEIGHT).alias("weight"), F.lit(RELATION_CONFIDENCE).alias("confidence"), F.lit("vlm_relation").alias("method"),
        F.substring("response", 1, 50).alias("evidence"), "seq",
    )


def concepts(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept nodes and DEFINES edges from responses (paper_id, node_id, page, seq, response)."""
    lines = responses.select("paper_id", "node_id", "page", "seq", F.posexplode(concept_lines(F.col("response"))).alias("line", "content"))
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("seq", "line"))
    named = lines.withColumn("n", number).withColumn("concept_id", F.concat_ws("", "paper_id", F.lit("__concept_"), F.col("n").cast("string")))
    nodes = named.select(F.col("concept_id").alias("node_id"), F.lit("Concept").alias("node_type"), "paper_id", "page", "content", F.col("n").cast("bigint").alias("seq"))
    edges = named.select(
        F.col("node_id").alias("src_id"), F.col("concept_id").alias("dst_id"), F.lit("DEFINES").alias("edge_type"), F.lit(CONCEPT_WEIGHT).alias("weight"),
        F.lit(CONCEPT_CONFIDENCE).alias("confidence"), F.lit("vlm_extraction").alias("method"), F.lit(None).cast("string").alias("evidence"), F.col("n").cast("bigint").alias("seq"),
    )
    return nodes, edges
