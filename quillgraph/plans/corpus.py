"""From layouts to a graph: structure, references, similarity, concepts, across papers, Korean references, in this order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrichment import concepts, described_nodes, relation_edges
from ..operators.graph import upsert_edges, upsert_nodes
from ..operators.references import augmented_references, reference_edges
from ..operators.similarity import BY_PAPER, cross_candidates, cross_document_edges, semantic_candidates, semantic_edges
from ..operators.structure import structural_graph
from ..sources.scratch import staged

_STAGE = 1 << 40


@dataclass
class Options:
    korean: bool = True
    semantic: bool = False
    semantic_threshold: float = 0.75
    semantic_top_k: int = 10
    cross_document: bool = False
    cross_threshold: float = 0.85


@dataclass
class Responses:
    """What a model has said: of figures and tables (node_id, response), of pairs (text_id, visual_id, response, seq), of texts (paper_id, node_id, page, seq, response)."""

    descriptions: DataFrame | None = None
    relations: DataFrame | None = None
    concepts: DataFrame | None = None


def build(elements: DataFrame, options: Options | None = None, embeddings: DataFrame | None = None, responses: Responses | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; of equal edges the last stage's stays.  embeddings: node_id, embedding (concepts' too, for links across papers).

    The structural graph is written out once, as every later stage reads it.
    """
    options, responses = options or Options(), responses or Responses()
    nodes, structure = (staged(x, "structure") for x in structural_graph(elements))
    later = lambda df, stage: df.withColumn("seq", F.col("seq") + F.lit(stage * _STAGE))
    tables = [structure, later(reference_edges(nodes, options.korean), 1)]
    vectors = lambda some: some.join(embeddings.select("node_id", "embedding"), "node_id")
    if embeddings is not None and options.semantic:  # before a model's concepts are there
        tables.append(later(semantic_edges(vectors(semantic_candidates(nodes)), options.semantic_threshold, options.semantic_top_k), 2))
    if responses.descriptions is not None:
        nodes = described_nodes(nodes, responses.descriptions)
    if responses.relations is not None:
        tables.append(later(relation_edges(responses.relations), 3))
    if responses.concepts is not None:
        found, defined = concepts(responses.concepts)
        nodes = upsert_nodes(nodes, later(found, 3))
        tables.append(later(defined, 3))
    if embeddings is not None and options.cross_document:
        tables.append(later(cross_document_edges(vectors(cross_candidates(nodes)), options.cross_threshold, BY_PAPER), 4))
    edges = upsert_edges(nodes, *tables)
    if options.korean:
        edges = staged(edges, "edges")
        edges = upsert_edges(nodes, edges, later(augmented_references(nodes, edges), 5))
    return nodes, edges
