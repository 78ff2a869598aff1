"""Parsed elements to the structural graph of a paper: papers, sections, text blocks, figures, tables and captions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, is_title, section_depth, strip, text
from ..schema import CAPTION_WEIGHT, CONTAINS_WEIGHT
from .order import scanned

ORDER = ("page_pos", "kind_rank", "elem_pos")
KINDS = ("sec", "text", "fig", "tab")
#: seq of a node or edge within its paper: the element's number, then the caption after its figure or table
_STEP = 2


def _numbered(elements: DataFrame, least_confidence: float) -> DataFrame:
    """Elements in reading order with their running numbers and the section they stand in."""
    kept = elements.where((F.col("element_type") != "author") & (F.coalesce("confidence", F.lit(1.0)) >= least_confidence))
    words = F.col("element_type").isin("title", "text")

    def of_kinds(rows: DataFrame) -> DataFrame:
        t = F.col("_stripped")  # a column of its own, so that it is stripped once, not for each rule
        rows = rows.withColumn("_stripped", F.when(words, strip(text(F.col("content")))))
        kind = F.when(words & is_title(t), "sec").when(words & (t != ""), "text").when(F.col("element_type") == "figure", "fig").when(F.col("element_type") == "table", "tab")
        return rows.withColumn("kind", kind).drop("_stripped")

    sums = {f"n_{k}": (F.col("kind") == k).cast("long") for k in KINDS} | {"position": F.lit(1).cast("long")}
    counted = scanned(kept, ["paper_id"], list(ORDER), sums, made=of_kinds, kept=F.col("kind").isNotNull())
    n = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"n_{k}")) for k in KINDS])
    named = lambda kind, n: F.concat_ws("", F.col("paper_id"), F.lit("__"), kind, F.lit("_"), n.cast("string"))
    # the section that a row stands in is the last one so far, so its number is the count of sections
    section = F.when(F.col("n_sec") > 0, named(F.lit("sec"), F.col("n_sec")))
    return counted.withColumn("n", n).withColumn("node_id", named(F.col("kind"), F.col("n"))).withColumn("section", section).drop(*[f"n_{k}" for k in KINDS])


def structural_graph(elements: DataFrame, least_confidence: float = 0.4, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges.  Counters and the current section come from a scan over ranges, so a paper may have any length.

    `keep` may write the numbered elements out, from which both follow, so that they are not numbered twice.
    """
    numbered = _numbered(elements, least_confidence)
    numbered = keep(numbered) if keep else numbered
    kind = F.col("kind")
    captioned = kind.isin("fig", "tab") & has_text(F.col("caption"))
    caption_id = F.concat_ws("", F.col("paper_id"), F.lit("__cap_"), kind, F.lit("_"), F.col("n").cast("string"))
    root = F.concat(F.col("paper_id"), F.lit("__paper"))
    seq = F.col("position") * _STEP

    def node(id_: Column, type_: Column, content: Column, seq: Column, **more: Column) -> Column:
        rest = {"image_path": "string", "section_title": "string", "depth": "int", "is_section": "boolean", "is_caption": "boolean", "confidence": "double", "has_image": "boolean"}
        tail = [more.get(k, F.lit(None)).cast(t).alias(k) for k, t in rest.items()]
        return F.struct(id_.alias("node_id"), type_.alias("node_type"), content.alias("content"), seq.cast("bigint").alias("seq"), *tail)

    is_section = kind == "sec"
    own = node(
        F.col("node_id"),
        F.when(kind == "fig", "Figure").when(kind == "tab", "Table").otherwise("TextBlock"),
        F.when(kind == "fig", text(F.col("caption"))).when(kind == "tab", F.coalesce("content", "caption", F.lit(""))).otherwise(F.col("content")),
        seq,
        image_path=F.when(kind.isin("fig", "tab"), F.col("image_path")),
        section_title=F.when(is_section, F.col("content")),
        depth=F.when(is_section, section_depth(F.col("content"))),
        is_section=F.when(is_section, True),
        confidence=F.when(~is_section, F.col("confidence")),
        has_image=F.when(kind == "fig", F.col("image_path").isNotNull()),
    )
    caption = node(caption_id, F.lit("TextBlock"), F.col("caption"), seq + 1, is_caption=F.lit(True))
    nodes = numbered.select("paper_id", "page", F.explode(F.when(captioned, F.array(own, caption)).otherwise(F.array(own))).alias("x")).select("x.node_id", "x.node_type", "paper_id", "page", "x.content", "x.image_path", "x.seq", "x.section_title", "x.depth", "x.is_section", "x.is_caption", "x.confidence", "x.has_image")
    papers = elements.select("paper_id").distinct()
    nothing = {"image_path": "string", "section_title": "string", "depth": "int", "is_section": "boolean", "is_caption": "boolean", "confidence": "double", "has_image": "boolean"}
    paper_nodes = papers.select(root.alias("node_id"), F.lit("Paper").alias("node_type"), "paper_id", F.lit(0).alias("page"), F.col("paper_id").alias("content"), F.lit(0).cast("bigint").alias("seq"), *[F.lit(None).cast(t).alias(k) for k, t in nothing.items()])

    def edge(src: Column, dst: Column, type_: str, weight: float, seq: Column) -> Column:
        return F.struct(src.alias("src_id"), dst.alias("dst_id"), F.lit(type_).alias("edge_type"), F.lit(weight).alias("weight"), seq.cast("bigint").alias("seq"))

    parent = F.when(is_section, root).otherwise(F.coalesce("section", root))
    contains = edge(parent, F.col("node_id"), "CONTAINS", CONTAINS_WEIGHT, seq)
    has_caption = edge(F.col("node_id"), caption_id, "HAS_CAPTION", CAPTION_WEIGHT, seq + 1)
    edges = numbered.select("paper_id", F.explode(F.when(captioned, F.array(contains, has_caption)).otherwise(F.array(contains))).alias("x"))
    edges = edges.select("x.src_id", "x.dst_id", "x.edge_type", "x.weight", F.lit(1.0).alias("confidence"), F.lit("rule").alias("method"), F.lit(None).cast("string").alias("evidence"), "x.seq")
    return paper_nodes.unionByName(nodes), edges
