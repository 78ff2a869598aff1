"""Registered queries of single steps: upserts, look-ups, candidates, confirmed items, graph stores, and what stand-in models say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrichment, evaluation, generation, graph, similarity
from ..sources import files
from ..sources.scratch import shared_path
from .catalogue import ELEMENTS, KEY_GRAPH, key_graph, query, read, structural
from .operations import Repeater

# --- graph -------------------------------------------------------------------------------------------------------------


@query("""SELECT 'u' || user_id AS node_id, arg_max(event_type, event_id) AS content, max(event_id) AS seq FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def graph_upsert_nodes(spark, sf_dir):
    """Nodes written in three tables: of each id the last one written counts."""
    rows = read(spark, sf_dir, "events").where("user_id is not null").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node_id"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"))
    return graph.upsert_nodes(*[rows.where(F.col("seq") % 3 == i) for i in (2, 0, 1)])


@query(f"WITH {KEY_GRAPH} SELECT node_id, node_type FROM nodes WHERE node_id = 'n7'")
def graph_one_node(spark, sf_dir):
    return graph.node(key_graph(spark, sf_dir)[0], "n7").select("node_id", "node_type")


@query(f"""WITH {ELEMENTS}, s AS (SELECT node_id, node_type, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS n, least(length(content), 512) AS chars FROM nodes)
SELECT 'within' AS scope, node_id, chars FROM s WHERE node_type <> 'Paper' AND n > 20 UNION ALL SELECT 'across', node_id, chars FROM s WHERE node_type IN ('Concept', 'Claim', 'TextBlock') AND n >= 30""")
def similarity_candidates(spark, sf_dir):
    """The nodes that are compared within and across papers, with the length of what is compared."""
    nodes = structural(spark, sf_dir)[0]
    told = lambda scope, some: some.select(F.lit(scope).alias("scope"), "node_id", F.length("content").cast("bigint").alias("chars"))
    return told("within", similarity.semantic_candidates(nodes)).unionByName(told("across", similarity.cross_candidates(nodes)))


@query(f"""WITH {KEY_GRAPH}, one AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges)
SELECT s.store, s.state, CASE WHEN s.state = 'saved' THEN nodes ELSE 0 END AS nodes, CASE WHEN s.state = 'saved' THEN edges ELSE 0 END AS edges
FROM one, (SELECT unnest(['parquet', 'json', 'parquet', 'json']) AS store, unnest(['saved', 'saved', 'cleared', 'cleared']) AS state) s""")
def graph_stores(spark, sf_dir):
    """The graph in each store that keeps it in parts, and what is left after it was cleared."""
    nodes, edges = key_graph(spark, sf_dir)
    nodes = nodes.withColumn("seq", F.lit(0).cast("bigint"))
    edges = edges.withColumns({"confidence": F.lit(1.0), "seq": F.lit(0).cast("bigint")})

    def counted(store: str, state: str, path: str) -> DataFrame:
        of = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        n, e = files.load_graph(spark, store, path)
        return of(n, "nodes").crossJoin(of(e, "edges")).select(F.lit(store).alias("store"), F.lit(state).alias("state"), "nodes", "edges")  # one row each

    out = []
    for store in ("parquet", "json"):
        kept, cleared = shared_path(spark, "kept"), shared_path(spark, "cleared")
        files.save_graph(store, nodes, edges, kept)
        files.save_graph(store, nodes, edges, cleared)
        files.clear_graph(store, nodes, edges, cleared)
        out += [counted(store, "saved", kept), counted(store, "cleared", cleared)]
    return reduce(DataFrame.unionByName, out)


# --- evaluation --------------------------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT 'q' || doc_id AS question_id, 'p' || coalesce(source, 'none') AS paper_id, doc_id FROM documents),
w AS (SELECT DISTINCT 'q' || (3 * doc_id) AS question_id FROM documents), c AS (SELECT * FROM i WHERE question_id IN (SELECT question_id FROM w)), o AS (SELECT DISTINCT paper_id FROM i WHERE doc_id % 50 = 1)
SELECT 'chosen' AS kind, question_id AS id FROM c UNION ALL SELECT 'missing', question_id FROM w WHERE question_id NOT IN (SELECT question_id FROM i)
UNION ALL SELECT DISTINCT 'leak', paper_id FROM c WHERE paper_id IN (SELECT paper_id FROM o)""")
def eval_confirmed(spark, sf_dir):
    """Of a draft the items that were confirmed, ids that it lacks, and papers that are collected from too."""
    d = read(spark, sf_dir, "documents")
    named = lambda number: F.concat(F.lit("q"), number.cast("string")).alias("question_id")
    draft = d.select(named(F.col("doc_id")), F.concat(F.lit("p"), F.coalesce("source", F.lit("none"))).alias("paper_id"), "doc_id")
    chosen, missing, leak = evaluation.confirmed(draft, d.select(named(3 * F.col("doc_id"))), draft.where("doc_id % 50 = 1"))
    told = lambda kind, some, column: some.select(F.lit(kind).alias("kind"), F.col(column).alias("id"))
    return told("chosen", chosen, "question_id").unionByName(told("missing", missing, "question_id")).unionByName(told("leak", leak, "paper_id"))


# --- models ------------------------------------------------------------------------------------------------------------


class Shouter:
    """A stand-in for a model: says a prompt in capitals, and fails on some."""

    def load(self) -> None:
        pass

    def infer(self, prompt: str, images: list[str], temperature: float) -> str:
        if prompt.endswith("7"):
            raise RuntimeError("no")
        return f"{prompt.upper()} {len(images)}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(x)), float(x.count("e"))] for x in texts]

    def infer_n(self, prompt: str, images: list[str], n: int, temperature: float) -> list[str]:
        return [] if prompt.endswith("7") else [f"Question: what does {prompt} mean here?", f"Question:  what does {prompt} mean here?", "?"]


@query("SELECT 'd' || doc_id AS id, CASE WHEN n_chars % 10 = 7 THEN '' ELSE upper('say ' || coalesce(lang, '') || ' ' || n_chars) || ' ' || doc_id % 2 END AS response FROM documents")
def model_responses(spark, sf_dir):
    """What a model says to each document's prompt; a failed call is an empty response."""
    d = F.col("doc_id")
    images = F.when(d % 2 == 1, F.array(F.lit("i.png")))
    prompts = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), d.cast("string")).alias("id"), F.concat_ws(" ", F.lit("say"), F.coalesce("lang", F.lit("")), F.col("n_chars").cast("string")).alias("prompt"), images.alias("images"))
    return enrichment.infer(prompts, "shouter", Shouter)


@query("SELECT 'd' || doc_id AS node_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS chars, CAST(length(regexp_replace(coalesce(text, ''), '[^e]', '', 'g')) AS DOUBLE) AS es FROM documents")
def model_vectors(spark, sf_dir):
    """The vectors that a model gives to whole texts."""
    nodes = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), F.col("text").alias("content"))
    got = enrichment.embed(nodes, "shouter", Shouter)
    return got.select("node_id", F.get("embedding", F.lit(0)).cast("double").alias("chars"), F.get("embedding", F.lit(1)).cast("double").alias("es"))


@query("SELECT 'd' || doc_id AS id, 'about ' || coalesce(source, '') || ' one' AS first, 'about ' || coalesce(source, '') || ' two' AS second, true AS is_usable FROM documents")
def generated_answers(spark, sf_dir):
    """Two different answers to each question; repeats that differ in white space only do not count."""
    asked = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("about "), F.coalesce("source", F.lit(""))).alias("question"), F.array().cast("array<string>").alias("images"))
    got = generation.answers(asked, "repeater", Repeater, 2, template="{question}")
    return got.select("id", F.get("candidates", F.lit(0)).alias("first"), F.get("candidates", F.lit(1)).alias("second"), "is_usable")


@query("""SELECT doc_id AS try, CASE WHEN n_chars % 10 = 7 THEN '이 자료에 제시된 주요 수치와 그 의미를 설명해 주세요.' ELSE 'what does ' || coalesce(lang, 'none') || ' ' || n_chars || ' mean here?' END AS question,
CASE WHEN n_chars % 10 = 7 THEN 'fallback' ELSE 'auto' END AS question_source FROM documents""")
def generated_questions(spark, sf_dir):
    """Questions on paths: what the model asks, once however often it says it, or the rule-based question where it says nothing."""
    node = lambda kind: F.struct(F.lit(kind).alias("node_type"), F.lit("x").alias("content"))
    paths = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("try"), F.array(node("Figure"), node("Claim")).alias("nodes"), F.array(F.lit("QUANTIFIES")).alias("edge_types"), F.lit(1).alias("difficulty"),
        F.array().cast("array<string>").alias("image_paths"), F.concat_ws(" ", F.coalesce("lang", F.lit("none")), F.col("n_chars").cast("string")).alias("context"), F.lit("").alias("gold_answer"),
    )
    return generation.questions(paths, "shouter", Shouter, 2, template="{kg_context}").select("try", "question", "question_source")
