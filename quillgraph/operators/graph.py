"""The graph as two tables, nodes and edges: upserts, neighbours, subgraphs, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ("src_id", "dst_id", "edge_type")


def latest(rows: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """The last row of each key: the aggregate keeps one row for each key and task before the shuffle."""
    names = rows.columns
    last = F.max_by(F.struct(*names), order).alias("last")
    return rows.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(last).select("last.*")


def upsert_nodes(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return latest(out, ("node_id",))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("node_id")  # a semi join asks for no more than one
    return edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select(*edges.columns)


def upsert_edges(nodes: DataFrame, *tables: DataFrame) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return latest(with_endpoints(out, nodes), EDGE_KEY)


def merge(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Graphs one after another: the last one's row wins for each key."""
    ranked = [(n.withColumn("graph", F.lit(i)), e.withColumn("graph", F.lit(i))) for i, (n, e) in enumerate(graphs)]

    def all_of(part: int, keys: tuple[str, ...]) -> DataFrame:
        out = ranked[0][part]
        for more in ranked[1:]:
            out = out.unionByName(more[part], allowMissingColumns=True)
        return latest(out.withColumn("order", F.struct("graph", "seq")), keys, "order").drop("graph", "order")

    return all_of(0, ("node_id",)), all_of(1, EDGE_KEY)


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def of_paper(nodes: DataFrame, paper_id: str) -> DataFrame:
    return nodes.where(F.col("paper_id") == paper_id)


def node_rows(properties: DataFrame) -> DataFrame:
    """Nodes from flat property maps (column `n`), as a graph database gives them: meta_* keys become metadata, as texts."""
    key = lambda name: F.try_element_at("n", F.lit(name))
    meta = F.transform_keys(F.map_filter("n", lambda k, v: k.startswith("meta_")), lambda k, v: F.substring(k, 6, 10_000))
    return properties.select(
        F.coalesce(key("id"), key("node_id")).alias("node_id"), key("node_type").alias("node_type"), key("paper_id").alias("paper_id"),
        F.coalesce(key("page").try_cast("int"), F.lit(-1)).alias("page"), F.coalesce(key("content"), F.lit("")).alias("content"), key("image_path").alias("image_path"), meta.alias("metadata"),
    )


def neighbors(edges: DataFrame, nodes: DataFrame, node_id: str | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """src_id, edge_type and the columns of the node at the other end, once for each edge."""
    out = edges if node_id is None else edges.where(F.col("src_id") == node_id)
    out = out if edge_types is None else out.where(F.col("edge_type").isin(*edge_types))
    return out.select("src_id", "edge_type", F.col("dst_id").alias("node_id")).join(nodes, "node_id")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of `ids` (node_id) and the edges among them."""
    kept = nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")
    return kept, with_endpoints(edges, kept)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node, edge), type and n; type is null for the totals."""
    count = F.count(F.lit(1)).alias("n")
    by_node = nodes.rollup(F.col("node_type").alias("type")).agg(count).select(F.lit("node").alias("kind"), "type", "n")
    by_edge = edges.rollup(F.col("edge_type").alias("type")).agg(count).select(F.lit("edge").alias("kind"), "type", "n")
    return by_node.unionByName(by_edge)


def corpus_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: papers, visual nodes, and references found by the Korean patterns."""
    of_nodes = nodes.agg(F.countDistinct(F.when(F.col("node_type") == "Paper", F.col("paper_id"))).alias("total_papers"), F.count_if(F.col("node_type").isin("Figure", "Table")).alias("visual_nodes"), F.count(F.lit(1)).alias("total_nodes"))
    of_edges = edges.agg(F.count_if(F.col("method") == "rule_ko").alias("korean_ref_edges"), F.count(F.lit(1)).alias("total_edges"))
    return of_nodes.crossJoin(of_edges)  # one row each


def papers(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'Paper'").select("paper_id").distinct()


def paper_images(nodes: DataFrame, paper_id: str, limit: int = 50) -> DataFrame:
    """Figures, then tables, that have an image."""
    visual = nodes.where((F.col("paper_id") == paper_id) & F.col("node_type").isin("Figure", "Table") & F.col("image_path").isNotNull())
    return visual.orderBy("node_type", "seq").limit(limit).select("node_id", "image_path")
