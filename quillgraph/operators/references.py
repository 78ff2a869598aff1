"""Edges from texts to the figures, tables and equations of the same paper that they mention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import KOREAN_AUGMENTATION, has_text, references
from ..schema import REFERENCE_CONFIDENCE, REFERENCE_WEIGHT

KINDS = ("Figure", "Table", "Equation")


def ordinals(nodes: DataFrame) -> DataFrame:
    """The place of each figure, table and equation among its kind in the paper."""
    order = Window.partitionBy("paper_id", "node_type").orderBy("seq")
    return nodes.where(F.col("node_type").isin(*KINDS)).select("paper_id", F.col("node_type").alias("kind"), F.row_number().over(order).cast("string").alias("number"), F.col("node_id").alias("dst_id"))


def _edges(mentions: DataFrame, method: str, evidence: Column) -> DataFrame:
    return mentions.select(
        "src_id", "dst_id", F.lit("REFERENCES").alias("edge_type"), F.lit(REFERENCE_WEIGHT).alias("weight"),
        F.lit(REFERENCE_CONFIDENCE).alias("confidence"), F.lit(method).alias("method"), evidence.alias("evidence"), "seq",
    )


def _mentions(nodes: DataFrame, found: Column) -> DataFrame:
    texts = nodes.where((F.col("node_type") == "TextBlock") & has_text(F.col("content")))
    return texts.select("paper_id", F.col("node_id").alias("src_id"), "seq", F.posexplode(found).alias("at", "mention")).select("paper_id", "src_id", "seq", "at", "mention.kind", "mention.number")


def _named(numbers: Column, kind: str) -> Column:
    return F.transform(numbers, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("number")))


def _of_kinds(find: Callable[[str], Column]) -> Column:
    return F.concat(*[_named(find(k), k) for k in KINDS])


def reference_edges(nodes: DataFrame, korean: bool = False) -> DataFrame:
    """An edge for each mention, in order (seq, at): an equi-join on paper, kind and number.

    A letter after the number of a figure or table is left out.
    """
    mentions = _mentions(nodes, _of_kinds(lambda k: references(F.col("content"), k, korean)))
    mentions = mentions.withColumn("mentioned", F.col("number")).withColumn("number", F.when(F.col("kind") == "Equation", F.col("number")).otherwise(F.regexp_replace("number", "[a-zA-Z]$", "")))
    return _edges(mentions.join(ordinals(nodes), ["paper_id", "kind", "number"]), "rule", F.concat_ws(" ", F.lit("ref"), F.lower("kind"), "mentioned"))


def augmented_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Further edges by the broader Korean patterns, where the pair has no reference yet; numbers come from node ids."""
    found = _of_kinds(lambda k: F.array_distinct(F.regexp_extract_all("content", F.lit(KOREAN_AUGMENTATION[k]), F.lit(1))))
    targets = nodes.where(F.col("node_type").isin(*KINDS)).select("paper_id", F.col("node_type").alias("kind"), F.regexp_extract("node_id", r"__(?:fig|tab|eq)_(\d+)$", 1).alias("number"), F.col("node_id").alias("dst_id")).where("number <> ''")
    known = edges.where("edge_type = 'REFERENCES'").select("src_id", "dst_id")
    label = F.when(F.col("kind") == "Figure", "그림").when(F.col("kind") == "Table", "표").otherwise("식")
    new = _mentions(nodes, found).join(targets, ["paper_id", "kind", "number"]).where("src_id <> dst_id").join(known, ["src_id", "dst_id"], "left_anti")
    return _edges(new, "rule_ko", F.concat_ws(" ", F.lit("ref"), label, "number"))
