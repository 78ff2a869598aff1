"""Graph paths: random walks, sampled evidence paths, and what is read off a path.

Walks take one look-up for each hop: a hash chooses a place among a node's successors, and only the edge at that place is
met, so a node with any number of successors costs one row for each walk.  Choices are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sampling import hash_order, uniform
from ..functions.text import CONTENT_WORD, clean_content, has_text, shortened, strip, text
from ..schema import EDGE_DIFFICULTY, EDGE_QUESTION_TYPE, VISUAL_TYPES, lookup
from ..sources.scratch import staged
from .order import scanned

START_TYPES = ("Figure", "Table", "Concept", "Claim", "TextBlock")
VISUAL_FACTOR, MOST_IMAGES, CONTEXT_CHARS = 10, 4, 300
CAPTION_ID = r"__cap_(fig|tab|eq)_\d+$"


def is_caption(nodes_id: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | nodes_id.rlike(CAPTION_ID)


def random_walk(starts: DataFrame, edges: DataFrame, hops: int = 3, seed: int = 42, weight: str = "weight") -> DataFrame:
    """start_id and path: each hop takes an out-edge with a chance in proportion to its weight; nodes may be met again.

    Out-edges stand in order of (dst_id, edge_type) with running sums of their weights; a walk at a node draws a point in
    their sum and carries the edge whose range holds it, from a scan of edges and walks together.  Edges without a
    positive weight are not taken.
    """
    some = edges.where(F.col(weight) > 0).select(F.col("src_id").alias("at"), "dst_id", "edge_type", F.col(weight).cast("double").alias("weight"))
    ends = staged(scanned(some, ["at"], ["dst_id", "edge_type"], {"to": F.col("weight")}), "ends")
    totals = ends.groupBy("at").agg(F.max("to").alias("total"))
    none, stop = F.lit(None).cast("string"), F.array().cast("array<string>")
    ranges = ends.select("at", (-F.col("to")).alias("place"), F.lit(0).alias("kind"), none.alias("start_id"), "dst_id", stop.alias("path"))
    walks = starts.select(F.col("node_id").alias("start_id"), F.array("node_id").alias("path"), F.col("node_id").alias("at"))
    for hop in range(hops):
        walks = staged(walks, "walks")  # used twice below: without a table plans would double with each hop
        point = uniform(seed, F.lit("walk"), F.lit(hop), F.col("start_id")) * F.col("total")
        drawn = walks.join(totals, "at", "left")
        points = drawn.where("total is not null").select("at", (-point).alias("place"), F.lit(1).alias("kind"), "start_id", none.alias("dst_id"), "path")
        met = scanned(ranges.unionByName(points), ["at"], ["place", "kind", "start_id"], {}, {"next": F.col("dst_id")}).where("kind = 1")
        ended = drawn.where("total is null").select("start_id", "path", none.alias("at"))
        walks = met.select("start_id", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at")).unionByName(ended)
    return walks.select("start_id", "path")


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes: the first that was written."""
    return edges.groupBy("src_id", "dst_id").agg(F.min_by("edge_type", F.struct("seq", "edge_type")).alias("edge_type"))


def expand(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """All simple paths of exactly `hops` hops: path and edge_types."""
    paths = starts.select(F.array("node_id").alias("path"), F.array().cast("array<string>").alias("edge_types"), F.col("node_id").alias("at"))
    out = first_edges(edges).select(F.col("src_id").alias("at"), F.col("dst_id").alias("next"), "edge_type")
    for _ in range(hops):
        paths = paths.join(out, "at").where(~F.array_contains("path", F.col("next")))
        paths = paths.select(F.concat("path", F.array("next")).alias("path"), F.concat("edge_types", F.array("edge_type")).alias("edge_types"), F.col("next").alias("at"))
    return paths.drop("at")


def recursive_paths(spark: SparkSession, starts: str, edges: str, hops: int) -> DataFrame:
    """The same paths as `expand` gives, from two views by a recursive query: path and edge_types."""
    return spark.sql(f"""
        WITH RECURSIVE walked(path, edge_types, at, hop) AS (
            SELECT array(node_id), CAST(array() AS ARRAY<STRING>), node_id, 0 FROM {starts}
            UNION ALL
            SELECT concat(w.path, array(e.dst_id)), concat(w.edge_types, array(e.edge_type)), e.dst_id, w.hop + 1
            FROM walked w JOIN {edges} e ON e.src_id = w.at
            WHERE w.hop < {int(hops)} AND NOT array_contains(w.path, e.dst_id)
        ) SELECT path, edge_types FROM walked WHERE hop = {int(hops)}""")


def start_nodes(nodes: DataFrame, excluded: DataFrame | None = None, paper_id: str | None = None, prefer_visual: bool = True, skip_captions: bool = True) -> DataFrame:
    """The nodes that a path may start at, with `weight` (visual nodes count ten times)."""
    out = nodes.where(F.col("node_type").isin(*START_TYPES) & (has_text(F.col("content")) | F.col("image_path").isNotNull()))
    if paper_id is not None:
        out = out.where(F.col("paper_id") == paper_id)
    if excluded is not None:
        out = out.join(excluded.select("paper_id").distinct(), "paper_id", "left_anti")
    if skip_captions:
        out = out.where(~((F.col("node_type") == "TextBlock") & is_caption(F.col("node_id"), F.col("is_caption"))))
    factor = F.when(F.col("node_type").isin(*VISUAL_TYPES), float(VISUAL_FACTOR)).otherwise(1.0) if prefer_visual else F.lit(1.0)
    return out.withColumn("weight", factor)


def walk_paths(tries: DataFrame, edges: DataFrame, max_hops: int, seed: int = 42) -> DataFrame:
    """For each try (try, start_id, hops) a path that visits no node twice: uniform over new successors, edge weights unused.

    Successors of the nodes that walks have come to are numbered.  A walk draws a place among those that it has not met: its own nodes, a few, are
    looked up among the successors and passed over.
    """
    walks = tries.select("try", "hops", F.array("start_id").alias("path"), F.array().cast("array<string>").alias("edge_types"), F.col("start_id").alias("at"))
    for hop in range(max_hops):
        walks = staged(walks, "walks")  # used more than once below: without a table plans would double with each hop
        here = walks.where(F.col("hops") > hop).select(F.col("at").alias("src_id")).distinct()
        steps = scanned(first_edges(edges.join(here, "src_id", "left_semi")), ["src_id"], ["dst_id"], {"n": F.lit(1).cast("long")})
        steps = staged(steps.select(F.col("src_id").alias("at"), F.col("dst_id").alias("next"), "edge_type", "n"), "steps")
        degrees = steps.groupBy("at").agg(F.max("n").alias("degree"))
        own = walks.where(F.col("hops") > hop).select("try", "at", F.explode("path").alias("next")).join(steps, ["at", "next"])
        met = own.groupBy("try").agg(F.array_sort(F.collect_list("n")).alias("met"))  # at most a path's nodes
        placed = walks.join(degrees, "at", "left").join(met, "try", "left").withColumn("met", F.coalesce("met", F.array().cast("array<bigint>")))
        new = F.coalesce("degree", F.lit(0)) - F.size("met")
        rank = F.ceil(uniform(seed, F.lit("walk"), F.lit(hop), F.col("try")) * new)
        place = F.aggregate("met", rank, lambda at, n: F.when(n <= at, at + 1).otherwise(at))
        placed = placed.withColumn("n", F.when((F.col("hops") > hop) & (new > 0), place)).drop("degree", "met")
        went = F.col("next").isNotNull()
        walks = placed.join(steps, ["at", "n"], "left").select(
            "try", "hops",
            F.when(went, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"),
            F.when(went, F.concat("edge_types", F.array("edge_type"))).otherwise(F.col("edge_types")).alias("edge_types"),
            F.col("next").alias("at"),
        )
    return walks.select("try", "path", "edge_types")


def difficulty(edge_types: Column, table: dict[str, int] = EDGE_DIFFICULTY) -> Column:
    levels = F.transform(edge_types, lambda e: lookup(table, e, 2))
    return F.coalesce(F.array_max(levels), F.lit(1))


def question_type(edge_types: Column, table: dict[str, str] = EDGE_QUESTION_TYPE) -> Column:
    return lookup(table, F.coalesce(F.get(edge_types, F.lit(0)), F.lit("CONTAINS")), "VQA")


def described(paths: DataFrame, nodes: DataFrame, levels: dict[str, int] = EDGE_DIFFICULTY, kinds: dict[str, str] = EDGE_QUESTION_TYPE) -> DataFrame:
    """Paths (try, path, edge_types) with their nodes and what is read off them; levels and kinds tell difficulty and question type by edge."""
    flat = paths.select("try", "path", "edge_types", F.posexplode("path").alias("at", "node_id"))
    # contents are cleaned here, once for each node of a path, and not again for each rule and line that shows them
    details = F.struct("at", "node_id", "node_type", "paper_id", "page", "content", "image_path", "plain")
    members = flat.join(nodes.select("node_id", "node_type", "paper_id", "page", "content", "image_path"), "node_id").withColumn("plain", clean_content(F.col("content")))
    out = members.groupBy("try", "path", "edge_types").agg(F.array_sort(F.collect_list(details)).alias("nodes"))
    types = F.col("edge_types")
    return out.select(
        "try", "path", "edge_types", "nodes", F.get("nodes", F.lit(0))["paper_id"].alias("paper_id"),
        difficulty(types, levels).alias("difficulty"), question_type(types, kinds).alias("question_type"),
        gold_answer(F.col("nodes"), types).alias("gold_answer"), context(F.col("nodes"), types).alias("context"),
        images(F.col("nodes")).alias("image_paths"), provenance(F.col("path"), types).alias("kg_provenance"),
    )


def drawn_starts(starts: DataFrame, tries: DataFrame, seed: int) -> DataFrame:
    """try, start_id and hops: each try (try, u, hops) falls on the start whose range of the summed weights holds u.

    Starts stand in hash order with running sums of their weights.  Starts by the end of their range and tries by their
    point are sorted together, the last first, and a try carries the start that it has passed last: a search in ranges
    that are scanned apart, so no try meets more than one start.
    """
    hashed = hash_order(seed, F.col("node_id"))
    bucket = F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint"), F.lit(1024))
    placed = starts.select("node_id", "weight", bucket.alias("bucket"), hashed.alias("hashed"), F.lit(0).alias("all"))
    ends = scanned(placed, ["all"], ["bucket", "hashed", "node_id"], {"to": F.col("weight")})
    total = starts.agg(F.sum("weight").alias("total"))  # one row
    points = tries.crossJoin(total).where("total > 0").select(F.lit(0).alias("all"), (-F.col("u") * F.col("total")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("node_id"), "try", "hops")
    both = ends.select("all", (-F.col("to")).alias("at"), F.lit(0).alias("kind"), "node_id", F.lit(None).cast("bigint").alias("try"), F.lit(None).cast("int").alias("hops")).unionByName(points)
    met = scanned(both, ["all"], ["at", "kind", "try"], {}, {"start_id": F.col("node_id")})
    return met.where("kind = 1 and start_id is not null").select("try", "start_id", "hops")


def sample_paths(
    nodes: DataFrame, edges: DataFrame, n: int, max_hops: int = 3, seed: int = 42, excluded: DataFrame | None = None,
    paper_id: str | None = None, prefer_visual: bool = True, require_image: bool = False, difficulty_is: int | None = None, skip_captions: bool = True,
    levels: dict[str, int] = EDGE_DIFFICULTY, kinds: dict[str, str] = EDGE_QUESTION_TYPE,
) -> DataFrame:
    """Up to n different paths out of 12 n tries, each with a weighted start and 1 to max_hops hops.

    Starts get ranges of the unit interval by their weights, and each try falls into one: see `drawn_starts`.
    """
    starts = start_nodes(nodes, excluded, paper_id, prefer_visual, skip_captions)
    tries = nodes.sparkSession.range(12 * n).select(F.col("id").alias("try"), uniform(seed, F.lit("start"), F.col("id")).alias("u"), (F.floor(uniform(seed, F.lit("hops"), F.col("id")) * max_hops - 1e-12) + 1).cast("int").alias("hops"))
    drawn = drawn_starts(starts, tries, seed)
    out = described(walk_paths(drawn, edges, max_hops, seed), nodes, levels, kinds)
    if require_image:
        out = out.where(F.size("image_paths") > 0)
    if difficulty_is is not None:
        out = out.where(F.col("difficulty") == difficulty_is)
    first = out.groupBy("path").agg(F.min("try").alias("try"))
    return out.join(first.select("try"), "try", "left_semi").orderBy("try").limit(n)


def images(nodes: Column) -> Column:
    some = F.filter(nodes, lambda x: x["image_path"].isNotNull())
    return F.slice(F.array_distinct(F.transform(some, lambda x: x["image_path"])), 1, MOST_IMAGES)


def gold_answer(nodes: Column, edge_types: Column) -> Column:
    """The answer that a path's last node gives, by its last edge; nodes have their cleaned content as `plain`."""
    at = F.size(nodes)
    content = F.get(nodes, at - 1)["plain"]
    before = F.get(nodes, at - 2)["plain"]
    last = F.coalesce(F.try_element_at(edge_types, F.lit(-1)), F.lit(""))
    start = F.substring(content, 1, 100)
    nonempty = lambda c: F.nullif(c, F.lit(""))
    number = F.coalesce(nonempty(F.regexp_extract(content, r"(?U)\d+\.?\d*", 0)), start)
    sentences = F.filter(F.transform(F.split(content, r"\."), strip), lambda s: s != "")
    sentence = F.coalesce(F.get(sentences, F.lit(0)), start)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(CONTENT_WORD), F.lit(0)))
    common = F.slice(F.array_sort(F.array_intersect(words(before), words(content))), 1, 5)
    shared = F.coalesce(nonempty(F.array_join(common, " ")), start)
    return F.when(last.isin("QUANTIFIES", "MEASURES"), number).when(last == "DEFINES", sentence).when((last == "SAME_CONCEPT") & (at >= 2), shared).otherwise(content)


def context(nodes: Column, edge_types: Column) -> Column:
    """A path in lines: each node's type, page and content (cleaned, `plain`), and the edges between."""

    def line(x: Column, i: Column) -> Column:
        page = F.when(x["page"] >= 0, F.format_string(" (p.%d)", x["page"])).otherwise("")
        image = F.when(x["image_path"].isNotNull(), " (이미지 있음)").otherwise("")
        content = F.replace(shortened(x["plain"], CONTEXT_CHARS), F.lit("\n"), F.lit(" "))
        own = F.concat(F.lit("["), x["node_type"], F.lit("]"), page, image, F.lit(" "), content)
        edge = F.get(edge_types, i)
        return F.when(edge.isNotNull(), F.concat(own, F.lit("\n   --"), edge, F.lit("-->"))).otherwise(own)

    return F.array_join(F.transform(nodes, line), "\n")


def provenance(path: Column, edge_types: Column) -> Column:
    return F.struct(
        F.get(path, F.lit(0)).alias("src_node"), F.coalesce(F.get(edge_types, F.lit(0)), F.lit("")).alias("edge"),
        F.when(F.size(path) > 1, F.element_at(path, -1)).otherwise("").alias("dst_node"), F.size(edge_types).alias("hop"),
        path.alias("path"), edge_types.alias("edges"),
    )


def summary(nodes: Column, edge_types: Column) -> Column:
    """One line: node types, edges, level and question type."""
    types = F.array_join(F.transform(nodes, lambda x: F.concat(F.lit("["), x["node_type"], F.lit("]"))), " → ")
    edges = F.when(F.size(edge_types) > 0, F.array_join(edge_types, " / ")).otherwise("single-node")
    return F.concat(types, F.lit("  ("), edges, F.lit(", L"), difficulty(edge_types).cast("string"), F.lit(", "), question_type(edge_types), F.lit(")"))


def path_from_node(nodes: DataFrame, edges: DataFrame, node_id: str, max_hops: int = 1, seed: int = 42, excluded: DataFrame | None = None) -> DataFrame:
    start = nodes.where(F.col("node_id") == node_id)
    if excluded is not None:
        start = start.join(excluded.select("paper_id").distinct(), "paper_id", "left_anti")
    tries = start.select(F.lit(0).cast("bigint").alias("try"), F.col("node_id").alias("start_id"), F.lit(max_hops).alias("hops"))
    return described(walk_paths(tries, edges, max_hops, seed), nodes).where((F.size("path") > 1) | (text(F.col("context")) != ""))
