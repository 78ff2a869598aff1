"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps; its result is written as Parquet and read
again as the next stage's documents.  The last stage gives a row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import jaccard, langid, mixing, packing, substring
from quillgraph.llm.common import staged, table
from quillgraph.llm.queries import vocabulary
from quillgraph.sources.scratch import owned


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on."""
    return langid.accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates goes on."""
    return jaccard.unique_documents(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; documents that are left without words go too."""
    return substring.cleaned_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document goes on as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: its sequence and place."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("packed", packed)]

#: Model fits, random rounding and best-fit packing cannot be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has written on its way, and its input, go as soon as its result is written."""
    docs = table(spark, sf_dir)
    with owned(spark) as own:
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), name)
            own.release(keep=docs)
        return STAGES[-1][1](spark, docs, sf_dir)
