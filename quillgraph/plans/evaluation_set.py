"""The life of an evaluation set: draft from held-out papers, confirmation, and the check that it stays as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze, text
from ..operators.evaluation import confirmed, draft_items, round_robin
from ..operators.paths import sample_paths
from ..sources.files import digests, write_json


def draft(nodes: DataFrame, edges: DataFrame, split: DataFrame, n: int = 120, max_hops: int = 2, seed: int = 42, require_hangul: bool = True) -> DataFrame:
    """Items on paths that stay inside held-out papers, one paper after another."""
    held = split.where("split = 'held_out'").select("paper_id")
    own = nodes.join(held, "paper_id", "left_semi")
    paths = sample_paths(own, edges, 30 * n, max_hops, seed)
    items = draft_items(paths, require_hangul).withColumn("item_id", F.array_join("path", " "))
    return round_robin(items, n, seed)


def confirm(items: DataFrame, ids: DataFrame, split: DataFrame, path: str) -> DataFrame:
    """Writes the chosen items; refuses if ids are missing or a collected paper is among them.  Gives the files' digests."""
    chosen, missing, leaked = confirmed(items, ids, split.where("split = 'collect'"))
    for problem, rows in (("ids that the draft lacks", missing), ("papers that are collected from", leaked)):
        if some := [r[0] for r in rows.limit(5).collect()]:
            raise ValueError(f"{problem}: {some}")
    write_json(chosen.drop("try", "path", "item_id", "turn"), path)
    return frozen(items.sparkSession, path)


def frozen(spark: SparkSession, path: str) -> DataFrame:
    return digests(spark, f"{path}/part-*")


def unchanged(spark: SparkSession, path: str, before: DataFrame) -> str:
    """`ok`, `changed`, or `missing`, against the digests that confirm gave."""
    try:
        now = {tuple(r) for r in frozen(spark, path).collect()}
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return "missing"
        raise
    return "ok" if now == {tuple(r) for r in before.collect()} else "changed"


def identical(a: Column, b: Column) -> Column:
    """Whether two answers differ in white space only."""
    return squeeze(text(a)) == squeeze(text(b))
