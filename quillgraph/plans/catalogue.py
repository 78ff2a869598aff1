"""The registered queries of the engine on the star-schema, event, document and conversation tables, with their SQL.

The tables hold no layouts, so queries derive graph-shaped input from their columns by fixed rules, the same in Spark
and in SQL; the operators are those that real input goes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics, text
from ..operators import enrichment, evaluation, graph, paths, references, similarity, structure, training
from ..operators import pairs as pair_log
from ..sources import layout
from ..sources.scratch import staged
from ..streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as papers -----------------------------------------------------------------------------------------------


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is an element: every seventh a figure, every eleventh a table, some lines numbered, some with references."""
    # texts of one file go to all tasks, in the partitioning that the operators' windows ask for, so that this is their only shuffle
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), "text").repartition("paper_id")
    rows = docs.select("paper_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    p = F.col("pos")
    kind = F.when(p % 7 == 3, "figure").when(p % 11 == 5, "table").otherwise("text")
    title = F.when(p % 9 == 0, F.concat(F.floor(p / 9 + 1).cast("string"), F.lit(". "))).otherwise("")
    mention = F.when(p % 5 == 0, F.concat(F.lit(" see Fig. "), (p % 3 + 1).cast("string"), F.lit(","))).otherwise("")
    return rows.select(
        "paper_id", (F.floor(p / 10) + 1).cast("int").alias("page"), F.floor(p / 10).cast("int").alias("page_pos"),
        F.when(kind == "text", 2).when(kind == "figure", 3).otherwise(4).alias("kind_rank"), p.alias("elem_pos"), kind.alias("element_type"),
        F.when(kind == "text", F.concat(title, F.col("line"), mention)).otherwise(F.col("line")).alias("content"),
        F.when(kind == "figure", F.concat(F.lit("img"), p.cast("string"))).alias("image_path"),
        (F.lit(0.3) + F.lit(0.1) * (p % 8)).alias("confidence"), F.when(kind == "figure", F.col("line")).alias("caption"),
    )


ELEMENTS = r"""
lines AS (
    SELECT 'd' || doc_id AS paper_id, unnest(range(len(a))) AS pos, unnest(a) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
),
elements AS (
    SELECT paper_id, pos, line, pos // 10 + 1 AS page, pos // 10 AS page_pos, 0.3::DOUBLE + 0.1::DOUBLE * (pos % 8) AS confidence,
           CASE WHEN pos % 7 = 3 THEN 'figure' WHEN pos % 11 = 5 THEN 'table' ELSE 'text' END AS kind
    FROM lines
),
written AS (
    SELECT *, CASE WHEN kind <> 'text' THEN line
                   ELSE (CASE WHEN pos % 9 = 0 THEN (pos // 9 + 1) || '. ' ELSE '' END) || line || (CASE WHEN pos % 5 = 0 THEN ' see Fig. ' || (pos % 3 + 1) || ',' ELSE '' END) END AS content
    FROM elements
),
stripped AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM written WHERE confidence >= 0.4),
typed AS (
    SELECT *, CASE WHEN kind = 'figure' THEN 'fig' WHEN kind = 'table' THEN 'tab'
                   WHEN regexp_matches(t, '^(\d+\.?\d*\.?\d*)\s+(.+)$')
                     OR lower(t) IN ('abstract', 'introduction', 'conclusion', 'related work', 'background', 'discussion', 'acknowledgment', 'acknowledgements', 'references')
                     OR (upper(t) = t AND lower(t) <> t AND length(t) < 60) THEN 'sec'
                   WHEN t <> '' THEN 'text' END AS k,
           CASE kind WHEN 'text' THEN 2 WHEN 'figure' THEN 3 ELSE 4 END AS rank
    FROM stripped
),
counted AS (
    SELECT *, count(*) OVER (PARTITION BY paper_id, k ORDER BY page_pos, rank, pos) AS n,
           count(*) OVER (PARTITION BY paper_id ORDER BY page_pos, rank, pos) AS position
    FROM typed WHERE k IS NOT NULL
),
named AS (SELECT *, paper_id || '__' || k || '_' || n AS node_id FROM counted),
placed AS (
    SELECT *, last_value(CASE WHEN k = 'sec' THEN node_id END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page_pos, rank, pos ROWS UNBOUNDED PRECEDING) AS section
    FROM named
),
nodes AS (
    SELECT node_id, CASE k WHEN 'fig' THEN 'Figure' WHEN 'tab' THEN 'Table' ELSE 'TextBlock' END AS node_type, paper_id, page, content, k, t, 2 * position AS seq,
           CASE WHEN k = 'fig' THEN 'img' || pos END AS image_path
    FROM placed
    UNION ALL
    SELECT paper_id || '__cap_fig_' || n, 'TextBlock', paper_id, page, line, 'cap', t, 2 * position + 1, NULL FROM placed WHERE k = 'fig' AND t <> ''
    UNION ALL
    SELECT DISTINCT paper_id || '__paper', 'Paper', paper_id, 0, paper_id, 'paper', paper_id, 0, NULL FROM elements
),
edges AS (
    SELECT CASE WHEN k = 'sec' THEN paper_id || '__paper' ELSE coalesce(section, paper_id || '__paper') END AS src_id, node_id AS dst_id, 'CONTAINS' AS edge_type, 2 * position AS seq FROM placed
    UNION ALL
    SELECT node_id, paper_id || '__cap_fig_' || n, 'HAS_CAPTION', 2 * position + 1 FROM placed WHERE k = 'fig' AND t <> ''
),
mentions AS (
    SELECT paper_id, node_id AS src_id, 'Figure' AS kind, unnest(regexp_extract_all(content, '(?i)\b(?:Fig(?:ure)?s?\.?\s*|fig(?:ure)?s?\.?\s*)(\d+[a-zA-Z]?)\b', 1)) AS number FROM nodes WHERE node_type = 'TextBlock'
    UNION ALL
    SELECT paper_id, node_id, 'Table', unnest(regexp_extract_all(content, '(?i)\b(?:Tab(?:le)?s?\.?\s*)(\d+[a-zA-Z]?)\b', 1)) FROM nodes WHERE node_type = 'TextBlock'
),
ordinals AS (
    SELECT paper_id, node_type AS kind, CAST(row_number() OVER (PARTITION BY paper_id, node_type ORDER BY seq) AS VARCHAR) AS number, node_id AS dst_id
    FROM nodes WHERE node_type IN ('Figure', 'Table')
),
refs AS (
    SELECT m.src_id, o.dst_id FROM mentions m JOIN ordinals o
    ON m.paper_id = o.paper_id AND m.kind = o.kind AND regexp_replace(m.number, '[a-zA-Z]$', '') = o.number
)
"""


def structural(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, each read from one written table, so that what uses them twice does not parse texts twice."""
    return structure.structural_graph(elements(spark, sf_dir), keep=lambda numbered: staged(numbered, "elements"))


@query(f"WITH {ELEMENTS} SELECT node_id, node_type, paper_id, CAST(page AS INTEGER) AS page, content, CAST(CASE WHEN k = 'sec' THEN length(regexp_extract(t, '^(\\d+\\.?\\d*\\.?\\d*)\\s+(.+)$', 1)) - length(replace(regexp_extract(t, '^(\\d+\\.?\\d*\\.?\\d*)\\s+(.+)$', 1), '.', '')) + 1 ELSE 0 END AS INTEGER) AS depth FROM nodes")
def graph_structural_nodes(spark, sf_dir):
    nodes, _ = structural(spark, sf_dir)
    return nodes.select("node_id", "node_type", "paper_id", "page", "content", F.coalesce("depth", F.lit(0)).alias("depth"))


@query(f"WITH {ELEMENTS} SELECT src_id, dst_id, edge_type FROM edges")
def graph_contains_edges(spark, sf_dir):
    nodes, edges = structural(spark, sf_dir)
    return graph.with_endpoints(edges, nodes).select("src_id", "dst_id", "edge_type")


@query(f"WITH {ELEMENTS} SELECT src_id, dst_id, count(*) AS n_mentions FROM refs GROUP BY src_id, dst_id")
def graph_reference_edges(spark, sf_dir):
    nodes, _ = structural(spark, sf_dir)
    return references.reference_edges(nodes).groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n_mentions"))


@query(f"""WITH {ELEMENTS},
all_edges AS (SELECT src_id, dst_id, edge_type FROM edges UNION SELECT src_id, dst_id, 'REFERENCES' FROM refs)
SELECT 'node' AS kind, coalesce(node_type, 'total') AS type, count(*) AS n FROM nodes GROUP BY ROLLUP (node_type)
UNION ALL SELECT 'edge', coalesce(edge_type, 'total'), count(*) FROM all_edges GROUP BY ROLLUP (edge_type)""")
def graph_stats_by_type(spark, sf_dir):
    nodes, edges = structural(spark, sf_dir)
    edges = graph.upsert_edges(nodes, edges, references.reference_edges(nodes))
    return graph.statistics(nodes, edges).withColumn("type", F.coalesce("type", F.lit("total")))


@query(f"WITH {ELEMENTS} SELECT count(DISTINCT paper_id) AS papers, CAST(count(*) FILTER (node_type IN ('Figure', 'Table')) AS BIGINT) AS visual_nodes, count(*) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, CAST(0 AS BIGINT) AS korean_ref_edges FROM nodes")
def graph_corpus_stats(spark, sf_dir):
    return graph.corpus_statistics(*structural(spark, sf_dir)).withColumnRenamed("total_papers", "papers")


@query(f"WITH {ELEMENTS} SELECT paper_id, count(*) FILTER (k = 'sec') AS n_sections, count(*) FILTER (k = 'text') AS n_texts FROM nodes GROUP BY paper_id")
def section_headings(spark, sf_dir):
    nodes, _ = structural(spark, sf_dir)
    plain = (F.col("node_type") == "TextBlock") & F.col("is_section").isNull() & F.col("is_caption").isNull()
    return nodes.groupBy("paper_id").agg(F.count_if(F.coalesce("is_section", F.lit(False))).alias("n_sections"), F.count_if(plain).alias("n_texts"))


@query(f"""WITH {ELEMENTS},
referred AS (SELECT o.paper_id, r.src_id AS text_id, r.dst_id AS visual_id FROM refs r JOIN ordinals o ON o.dst_id = r.dst_id),
v AS (SELECT * FROM nodes WHERE image_path IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM referred)),
near AS (
    SELECT v.paper_id, t.node_id AS text_id, v.node_id AS visual_id, t.seq, t.page = v.page AS same, bool_or(t.page = v.page) OVER (PARTITION BY v.node_id) AS on_page
    FROM v JOIN nodes t ON t.paper_id = v.paper_id AND abs(t.page - v.page) <= 1 AND t.node_type = 'TextBlock' AND length(t.content) > 50
),
top AS (SELECT *, row_number() OVER (PARTITION BY visual_id ORDER BY seq, text_id) AS place FROM near WHERE same OR NOT on_page)
SELECT paper_id, text_id, visual_id FROM referred UNION ALL SELECT paper_id, text_id, visual_id FROM top WHERE place <= 3""")
def visual_text_pairs(spark, sf_dir):
    nodes, _ = structural(spark, sf_dir)
    return enrichment.visual_text_pairs(nodes, references.reference_edges(nodes))


_HTML = r"""array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace({0}, '</t[dh]>\s*', ' | ', 'g'), '</tr>\s*', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'),
    lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g'), ' |'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"""
_CLEAN = r"CASE WHEN contains({0}, '<') AND contains({0}, '>') THEN " + _HTML + r" ELSE regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g') END"
_WORDS = r"regexp_extract_all({0}, '[가-힣]{{2,}}|[A-Za-z]{{4,}}|\d+(?:\.\d+)?')"


def _clean(column: str) -> str:
    return _CLEAN.format(column)


def _shown(column: str) -> str:
    """Cleaned content as a line of the context shows it."""
    return f"replace(CASE WHEN length({column}) > 300 THEN {column}[1:300] || '…' ELSE {column} END, chr(10), ' ')"


PATHS = f"""
e AS MATERIALIZED (
    SELECT e.src_id, e.dst_id, {_clean("regexp_replace(s.content, '^\\s+|\\s+$', '', 'g')")} AS a, {_clean("regexp_replace(d.content, '^\\s+|\\s+$', '', 'g')")} AS b,
           s.node_type AS src_type, d.node_type AS dst_type, s.page AS src_page, d.page AS dst_page, s.image_path AS src_image, d.image_path AS dst_image, s.paper_id,
           CASE d.seq % 4 WHEN 0 THEN 'QUANTIFIES' WHEN 1 THEN 'DEFINES' WHEN 2 THEN 'SAME_CONCEPT' ELSE 'HAS_CAPTION' END AS edge
    FROM edges e JOIN known s ON s.node_id = e.src_id JOIN known d ON d.node_id = e.dst_id
),
w AS (
    SELECT *, CASE WHEN edge = 'QUANTIFIES' THEN regexp_extract(b, '\\d+\\.?\\d*') END AS number,
           CASE WHEN edge = 'DEFINES' THEN list_filter(list_transform(string_split(b, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1] END AS sentence,
           CASE WHEN edge = 'SAME_CONCEPT' THEN array_to_string(list_sort(list_distinct(list_intersect({_WORDS.format("a")}, {_WORDS.format("b")})))[1:5], ' ') END AS common
    FROM e
),
described AS (
    SELECT *, CASE edge WHEN 'QUANTIFIES' THEN coalesce(nullif(number, ''), b[1:100]) WHEN 'DEFINES' THEN coalesce(sentence, b[1:100])
                        WHEN 'SAME_CONCEPT' THEN coalesce(nullif(common, ''), b[1:100]) ELSE b END AS gold_answer,
           CAST(CASE edge WHEN 'SAME_CONCEPT' THEN 4 WHEN 'HAS_CAPTION' THEN 1 ELSE 2 END AS INTEGER) AS difficulty,
           CASE edge WHEN 'SAME_CONCEPT' THEN 'InstructionFollowing' ELSE 'VQA' END AS question_type,
           '[' || src_type || '] (p.' || src_page || ')' || CASE WHEN src_image IS NOT NULL THEN ' (이미지 있음)' ELSE '' END || ' ' || {_shown("a")} || chr(10) || '   --' || edge || '-->' || chr(10)
           || '[' || dst_type || '] (p.' || dst_page || ')' || CASE WHEN dst_image IS NOT NULL THEN ' (이미지 있음)' ELSE '' END || ' ' || {_shown("b")} AS context
    FROM w
)"""


def described_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each structural edge as a path of two nodes, its type dealt out by the place of its end."""
    nodes, edges = structural(spark, sf_dir)
    at = nodes.select(F.col("node_id").alias("dst_id"), F.col("seq").alias("at"))
    edge = F.when(F.col("at") % 4 == 0, "QUANTIFIES").when(F.col("at") % 4 == 1, "DEFINES").when(F.col("at") % 4 == 2, "SAME_CONCEPT").otherwise("HAS_CAPTION")
    walked = edges.join(at, "dst_id").select(F.xxhash64("src_id", "dst_id").alias("try"), F.array("src_id", "dst_id").alias("path"), F.array(edge).alias("edge_types"))
    return paths.described(walked, nodes).where(F.size("nodes") == 2)


@query(f"WITH {ELEMENTS}, known AS MATERIALIZED (SELECT * FROM nodes), {PATHS} SELECT src_id, dst_id, edge, gold_answer, md5(context) AS context_md5, difficulty, question_type FROM described")
def path_gold_and_context(spark, sf_dir):
    got = described_edges(spark, sf_dir)
    return got.select(F.get("path", F.lit(0)).alias("src_id"), F.get("path", F.lit(1)).alias("dst_id"), F.get("edge_types", F.lit(0)).alias("edge"), "gold_answer", F.md5("context").alias("context_md5"), "difficulty", "question_type")


@query(f"""WITH {ELEMENTS}, known AS MATERIALIZED (SELECT * FROM nodes), {PATHS}
SELECT src_id AS src_node, edge, dst_id AS dst_node, CAST(1 AS INTEGER) AS hop, array_to_string(list_distinct(list_filter([src_image, dst_image], lambda x: x IS NOT NULL)), ' ') AS images,
       '[' || src_type || '] → [' || dst_type || ']  (' || edge || ', L' || difficulty || ', ' || question_type || ')' AS summary FROM described""")
def path_provenance(spark, sf_dir):
    got = described_edges(spark, sf_dir)
    p = F.col("kg_provenance")
    return got.select(p["src_node"].alias("src_node"), p["edge"].alias("edge"), p["dst_node"].alias("dst_node"), p["hop"].alias("hop"), F.array_join("image_paths", " ").alias("images"), paths.summary(F.col("nodes"), F.col("edge_types")).alias("summary"))


def _draw(keys: str) -> str:
    """SQL for the uniform number of some keys."""
    return f"(CAST('0x' || md5('{keys})[1:13] AS BIGINT) + 1)::DOUBLE / 4503599627370496.0"


def _hop(number: int) -> str:
    """A hop of the walks w0, w1, ...: the place that is drawn among new successors."""
    return f"""
s{number} AS (
    SELECT try, dst_id AS next, edge_type AS type FROM (
        SELECT w.try, f.dst_id, f.edge_type, row_number() OVER (PARTITION BY w.try ORDER BY f.dst_id) AS place, count(*) OVER (PARTITION BY w.try) AS new
        FROM w{number} w JOIN f ON f.src_id = w.at WHERE w.hops > {number} AND NOT list_contains(w.path, f.dst_id)
    ) q WHERE place = ceil({_draw(f"42|walk|{number}|' || try")} * new)
),
w{number + 1} AS MATERIALIZED (
    SELECT w.try, w.hops, CASE WHEN next IS NULL THEN w.path ELSE list_append(w.path, next) END AS path, CASE WHEN next IS NULL THEN w.types ELSE list_append(w.types, type) END AS types, next AS at
    FROM w{number} w LEFT JOIN s{number} s ON s.try = w.try
)"""


_DRAW = "(CAST('0x' || md5('42|{}|' || i)[1:13] AS BIGINT) + 1)::DOUBLE / 4503599627370496.0"


@query(f"""WITH {ELEMENTS}, known AS MATERIALIZED (SELECT * FROM nodes),
every AS (SELECT src_id, dst_id, edge_type, seq FROM edges UNION ALL SELECT DISTINCT r.src_id, r.dst_id, 'REFERENCES', n.seq FROM refs r JOIN known n ON n.node_id = r.src_id),
f AS MATERIALIZED (SELECT src_id, dst_id, arg_min(edge_type, (seq, edge_type)) AS edge_type FROM every GROUP BY src_id, dst_id),
starts AS (
    SELECT node_id, CASE WHEN node_type IN ('Figure', 'Table') THEN 10 ELSE 1 END AS weight, md5('42|' || node_id) AS h FROM known
    WHERE node_type <> 'Paper' AND k <> 'cap' AND (regexp_replace(content, '\\s', '', 'g') <> '' OR image_path IS NOT NULL)
),
dealt AS MATERIALIZED (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % 1024 AS bucket, sum(weight) OVER (PARTITION BY CAST('0x' || h[1:8] AS BIGINT) % 1024 ORDER BY h, node_id ROWS UNBOUNDED PRECEDING) AS upto FROM starts),
mass AS (SELECT bucket, max(upto) AS mass FROM dealt GROUP BY bucket),
ranges AS MATERIALIZED (SELECT *, sum(mass) OVER (ORDER BY bucket) AS high, sum(mass) OVER () AS total FROM mass),
tries AS (SELECT i AS try, {_DRAW.format("start")} AS u, CAST(floor({_DRAW.format("hops")} * 3 - 1e-12) + 1 AS INTEGER) AS hops FROM range(600) t(i)),
met AS (SELECT try, hops, bucket, u * total - (high - mass) AS point FROM tries JOIN ranges ON u * total > high - mass AND u * total <= high),
w0 AS MATERIALIZED (
    SELECT try, any_value(hops) AS hops, [min(node_id)] AS path, CAST([] AS VARCHAR[]) AS types, min(node_id) AS at
    FROM met JOIN dealt ON dealt.bucket = met.bucket AND point > upto - weight AND point <= upto GROUP BY try
),{_hop(0)},{_hop(1)},{_hop(2)},
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY try) AS copy FROM w3) WHERE copy = 1 ORDER BY try LIMIT 50),
ends AS (SELECT c.*, regexp_replace(n.content, '^\\s+|\\s+$', '', 'g') AS b FROM chosen c JOIN known n ON n.node_id = c.path[-1])
SELECT split_part(path[1], '__', 1) AS paper_id, array_to_string(path, ' ') AS path, CAST(CASE WHEN list_contains(types, 'REFERENCES') THEN 2 ELSE 1 END AS INTEGER) AS difficulty,
       CASE WHEN types[1] = 'REFERENCES' THEN 'Reasoning' ELSE 'VQA' END AS question_type, {_clean("b")} AS gold_answer FROM ends""")
def path_samples(spark, sf_dir):
    nodes, edges = structural(spark, sf_dir)
    edges = staged(graph.upsert_edges(nodes, edges, references.reference_edges(nodes)), "edges")
    return paths.sample_paths(nodes, edges, 50).select("paper_id", F.array_join("path", " ").alias("path"), "difficulty", "question_type", "gold_answer")


# --- keys as a graph ---------------------------------------------------------------------------------------------------


def key_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions contain nations, nations contain customers."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r, n, c = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    up = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    nodes = region.select(r.alias("node_id"), F.lit("region").alias("node_type")).unionByName(nation.select(n.alias("node_id"), F.lit("nation").alias("node_type"))).unionByName(customer.select(c.alias("node_id"), F.lit("customer").alias("node_type")))
    edges = nation.select(up("r", "n_regionkey").alias("src_id"), n.alias("dst_id"), F.lit("CONTAINS").alias("edge_type"), (F.col("n_nationkey") % 5 + 1).cast("double").alias("weight"), F.col("n_nationkey").cast("bigint").alias("seq"))
    return nodes, edges.unionByName(customer.select(up("n", "c_nationkey").alias("src_id"), c.alias("dst_id"), F.lit("CONTAINS").alias("edge_type"), (F.col("c_custkey") % 5 + 1).cast("double").alias("weight"), F.col("c_custkey").alias("seq")))


KEY_GRAPH = """
nodes AS (
    SELECT 'r' || r_regionkey AS node_id, 'region' AS node_type FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer
),
edges AS (
    SELECT 'r' || n_regionkey AS src_id, 'n' || n_nationkey AS dst_id, 'CONTAINS' AS edge_type, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS weight FROM nation
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS', CAST(c_custkey % 5 + 1 AS DOUBLE) FROM customer
)
"""


@query(f"WITH {KEY_GRAPH} SELECT e.src_id, e.edge_type, n.node_id, n.node_type FROM edges e JOIN nodes n ON n.node_id = e.dst_id WHERE e.edge_type = 'CONTAINS'")
def graph_neighbors(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    return graph.neighbors(edges, nodes, edge_types=["CONTAINS"]).select("src_id", "edge_type", "node_id", "node_type")


@query(f"WITH {KEY_GRAPH}, kept AS (SELECT 'n' || n_nationkey AS id FROM nation UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0) SELECT src_id, dst_id FROM edges WHERE src_id IN (SELECT id FROM kept) AND dst_id IN (SELECT id FROM kept)")
def graph_induced_subgraph(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    ids = nodes.where("node_type = 'nation'").select("node_id").unionByName(rich)
    return graph.subgraph(nodes, edges, ids)[1].select("src_id", "dst_id")


@query("""WITH r AS (SELECT 'u' || user_id AS node_id, event_type, event_id, event_type <> 'error' AS late FROM events)
SELECT node_id, arg_max(event_type, event_id + CASE WHEN late THEN 1000000000000 ELSE 0 END) AS content, arg_max(event_id, event_id + CASE WHEN late THEN 1000000000000 ELSE 0 END) AS seq FROM r GROUP BY node_id""")
def graph_merge_upsert(spark, sf_dir):
    """Two graphs merged: in the later one are all events but errors, and its rows win whatever their places are."""
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node_id"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"))
    none = spark.createDataFrame([], "src_id string, dst_id string, edge_type string, seq bigint")
    return graph.merge([(rows.where("content = 'error'"), none), (rows.where("content <> 'error'"), none)])[0]


@query(f"WITH {KEY_GRAPH} SELECT a.src_id || ' ' || a.dst_id || ' ' || b.dst_id AS path, 'CONTAINS CONTAINS' AS edge_types FROM edges a JOIN edges b ON b.src_id = a.dst_id WHERE a.src_id LIKE 'r%'")
def graph_paths_2hop(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    got = paths.expand(nodes.where("node_type = 'region'"), edges, 2)
    return got.select(F.array_join("path", " ").alias("path"), F.array_join("edge_types", " ").alias("edge_types"))


@query(f"""WITH {KEY_GRAPH},
c AS (SELECT *, sum(weight) OVER (PARTITION BY src_id ORDER BY dst_id, edge_type) AS upto, sum(weight) OVER (PARTITION BY src_id) AS total FROM (SELECT src_id, dst_id, 'CONTAINS' AS edge_type, weight FROM edges)),
hop0 AS (SELECT s.node_id AS start_id, c.dst_id AS one FROM nodes s JOIN c ON c.src_id = s.node_id AND upto >= {_draw("7|walk|0|' || s.node_id")} * total AND upto - weight < {_draw("7|walk|0|' || s.node_id")} * total WHERE s.node_type = 'region'),
hop1 AS (SELECT h.start_id, one, c.dst_id AS two FROM hop0 h JOIN c ON c.src_id = h.one AND upto >= {_draw("7|walk|1|' || h.start_id")} * total AND upto - weight < {_draw("7|walk|1|' || h.start_id")} * total)
SELECT start_id, start_id || ' ' || one || ' ' || two AS path FROM hop1""")
def graph_random_walk(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    return paths.random_walk(nodes.where("node_type = 'region'"), edges, 3, seed=7).select("start_id", F.array_join("path", " ").alias("path"))


# --- vectors -----------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("node_id"), F.col("label").cast("string").alias("paper_id"), F.col("vec_id").alias("seq"), "embedding", F.lit("TextBlock").alias("node_type"))


_UNIT = "v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings)"


@query(f"""WITH {_UNIT},
p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j DESC) AS place FROM p WHERE s >= 0.2)
SELECT 'v' || i AS src_id, 'v' || j AS dst_id, 'SUPPORTS' AS edge_type FROM r WHERE place <= 5""")
def semantic_topk_edges(spark, sf_dir):
    return similarity.semantic_edges(vectors(spark, sf_dir), 0.2, 5).select("src_id", "dst_id", "edge_type")


@query(f"""WITH {_UNIT}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, 'v' || vec_id AS node_id, coalesce(CAST(label AS VARCHAR), '') AS paper FROM v)
SELECT a.node_id AS src_id, b.node_id AS dst_id FROM o a JOIN o b ON a.label IS DISTINCT FROM b.label AND (a.paper, a.seq, a.node_id) < (b.paper, b.seq, b.node_id) WHERE list_dot_product(a.e, b.e) >= 0.3""")
def crossdoc_edges(spark, sf_dir):
    """seq is a place within the paper, so that equal places meet; the order is that of the corpus plan."""
    seq = F.row_number().over(Window.partitionBy("paper_id").orderBy("seq"))
    return similarity.cross_document_edges(vectors(spark, sf_dir).withColumn("seq", seq), 0.3, similarity.BY_PAPER).select("src_id", "dst_id")


@query("""WITH v AS (SELECT vec_id, label, list_transform(range(64), lambda k: CAST(embedding[k + 1] AS DOUBLE) + CASE WHEN vec_id % 20 = k THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
SELECT 'v' || a.vec_id AS src_id, 'v' || b.vec_id AS dst_id FROM u a JOIN u b ON a.label IS DISTINCT FROM b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.95""")
def crossdoc_clustered_edges(spark, sf_dir):
    """Edges of vectors that lie in twenty clusters, at a threshold for which most pairs of balls are too far apart."""
    moved = F.transform("embedding", lambda x, k: x.cast("double") + F.when(F.col("seq") % 20 == k, 4.0).otherwise(0.0))
    pairs = similarity.similar_pairs(vectors(spark, sf_dir).withColumn("embedding", moved), 0.95, per_paper=False)
    return pairs.select("src_id", "dst_id")



# --- text --------------------------------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT conv_id, turn, list_slice(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 5), 1, 3) AS lines FROM conversations),
l AS (SELECT conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM c)
SELECT 'v' || conv_id || '__concept_' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS node_id, trim(line, ' -•*') AS content FROM l""")
def concept_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("paper_id"), F.concat_ws("_", "conv_id", "turn").alias("node_id"), F.lit(0).alias("page"), F.col("turn").alias("seq"), F.col("text").alias("response"))
    return enrichment.concepts(rows)[0].select("node_id", "content")


_LANGUAGE = "CASE WHEN len(regexp_extract_all(t, '[A-Za-z가-힣]')) < 50 THEN 'unknown' WHEN len(regexp_extract_all(t, '[가-힣]')) / len(regexp_extract_all(t, '[A-Za-z가-힣]')) >= 0.15 THEN 'ko' ELSE 'en' END"


@query(f"SELECT {_LANGUAGE} AS language, count(*) AS n FROM (SELECT substr(coalesce(text, ''), 1, 6000) AS t FROM documents) GROUP BY 1")
def doc_language_ratio(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(text.language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CASE WHEN lang = 'fr' THEN 'cached' ELSE {_LANGUAGE} END AS language FROM (SELECT doc_id, lang, substr(coalesce(text, ''), 1, 6000) AS t FROM documents)")
def language_incremental_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("paper_id", F.col("doc_id").cast("string"))
    known = docs.where("lang = 'fr'").select("paper_id", F.lit("cached").alias("language"))
    element = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit(1.0).alias("confidence"))
    pages = docs.select("paper_id", F.array(F.struct(F.array(element).alias("text_elements"))).alias("pages"))
    return layout.paper_languages(pages, known).select(F.col("paper_id").cast("bigint").alias("doc_id"), "language")


_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"""WITH c AS (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '</t[dh]>{_SPACE}*', ' | ', 'g'), '</tr>{_SPACE}*', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS cells, html FROM pages
),
l AS (
    SELECT page_id, html, list_filter(list_transform(string_split_regex(cells, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
        lambda x: regexp_replace(trim(regexp_replace(x, '{_SPACE}+', ' ', 'g'), ' |'), '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS lines FROM c
)
SELECT page_id, CASE WHEN contains(html, '<') AND contains(html, '>') THEN md5(array_to_string(lines, chr(10))) ELSE md5(regexp_replace(regexp_replace(coalesce(html, ''), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')) END AS text_md5 FROM l""")
def html_clean_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.clean_content(F.col("html"))).alias("text_md5"))


_LABEL = r"(?i)^\s*[<〈\[【(]?\s*(Fig(?:ure)?\.?|Table|그\s?림|표|사진|도표|수식|식)\s*\.?\s*(\d+(?:[-.]\d+)?)?\s*[>〉\]】)]?\s*[.:、,]?\s*"


@query(rf"""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Fig. ' || (doc_id % 9) || '. ' WHEN 1 THEN '<Table ' || (doc_id % 9) || '-1> ' WHEN 2 THEN '그림 ' || (doc_id % 9) || ': ' ELSE '' END
    || regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), '^ +| +$', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, lower(trim(regexp_extract(t, '{_LABEL}', 1))) AS said, trim(regexp_replace(t, '{_LABEL}', '')) AS rest FROM c)
SELECT doc_id, CASE WHEN said IN ('fig', 'fig.', 'figure', 'figure.', '그림', '그 림', '사진', '도표') THEN 'figure' WHEN said IN ('table', '표') THEN 'table' WHEN said IN ('수식', '식') THEN 'equation' ELSE 'none' END AS kind,
       CASE WHEN rest <> '' THEN rest ELSE trim(t) END AS caption FROM k""")
def caption_label_strip(spark, sf_dir):
    rest = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", ""), "^ +| +$", "")
    number = (F.col("doc_id") % 9).cast("string")
    m = F.col("doc_id") % 4
    label = F.when(m == 0, F.concat(F.lit("Fig. "), number, F.lit(". "))).when(m == 1, F.concat(F.lit("<Table "), number, F.lit("-1> "))).when(m == 2, F.concat(F.lit("그림 "), number, F.lit(": "))).otherwise("")
    caption = F.concat(label, rest)
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.label_kind(caption), F.lit("none")).alias("kind"), text.strip_caption_label(caption).alias("caption"))


@query("""WITH q AS (SELECT doc_id, ['HAS_CAPTION', 'REFERENCES', 'CONTAINS', 'SINGLE'][doc_id % 4 + 1] AS edge, ['Figure', 'Table', 'Claim'][doc_id % 3 + 1] AS src FROM documents),
n AS (SELECT *, CASE src WHEN 'Figure' THEN '그림' WHEN 'Table' THEN '표' ELSE '주장' END AS name FROM q)
SELECT doc_id, CASE edge WHEN 'REFERENCES' THEN '본문에서 언급한 내용을 이 ' || name || (CASE src WHEN 'Table' THEN '가' ELSE '이' END) || ' 어떻게 뒷받침하는지 설명해 주세요.'
    WHEN 'CONTAINS' THEN '이 자료들이 어떤 관계인지 설명해 주세요.' ELSE '이 ' || name || (CASE src WHEN 'Table' THEN '는' ELSE '은' END) || ' 무엇을 보여주는지 설명해 주세요.' END AS question FROM n""")
def question_fallback(spark, sf_dir):
    edge = F.element_at(F.array(*map(F.lit, ("HAS_CAPTION", "REFERENCES", "CONTAINS", "SINGLE"))), (F.col("doc_id") % 4 + 1).cast("int"))
    src = F.element_at(F.array(*map(F.lit, ("Figure", "Table", "Claim"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", evaluation.fallback_question(edge, src, src).alias("question"))


# --- metrics -----------------------------------------------------------------------------------------------------------

_ANSWERS = r"""a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, unnest(range(greatest(1, (length(t) + 59) // 60))) AS part FROM a),
p AS (SELECT doc_id, part, substr(t, part * 60 + 1, 60) AS prediction, [substr(t, part * 60 + 3, 60), substr(t, part * 60 + 1, 45) || ' and'] AS truths FROM c)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in pieces of 60 characters, as answers are short; the truths are two edited versions of each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")  # texts of one file go to all tasks
    rows = docs.select("doc_id", F.posexplode(text.in_pieces(F.col("text"), 60, 2)).alias("part", "piece"))
    piece = lambda start, n: F.substring("piece", start, n)
    return rows.select("doc_id", "part", piece(1, 60).alias("prediction"), F.array(piece(3, 60), F.concat(piece(1, 45), F.lit(" and"))).alias("ground_truths"), F.lit("VQA").alias("question_type"))


#: DuckDB's distance counts bytes: letters beyond ASCII become single bytes that no text has.
_BEYOND = "éóèñçüêäößíáúàâîôûëïœæ"
_BYTES = " || ".join(f"chr({1 + i + (i >= 8) * 6})" for i in range(len(_BEYOND)))
_FOLD = rf"translate(lower(regexp_replace({{}}, '^\s+|\s+$', '', 'g')), '{_BEYOND}', {_BYTES})"
_ANLS = (
    f"list_max(list_transform(list_transform(truths, lambda g: {_FOLD.format('g')}), lambda g: CASE WHEN greatest(length({_FOLD.format('prediction')}), length(g)) = 0 THEN 1.0 "
    f"WHEN least(length({_FOLD.format('prediction')}), length(g)) = 0 THEN 0.0 WHEN levenshtein({_FOLD.format('prediction')}, g) / greatest(length({_FOLD.format('prediction')}), length(g))::DOUBLE > 0.5 THEN 0.0 "
    f"ELSE 1 - levenshtein({_FOLD.format('prediction')}, g) / greatest(length({_FOLD.format('prediction')}), length(g))::DOUBLE END))"
)
_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"
_EXACT = f"CAST(list_contains(list_transform(truths, lambda g: {_NORM.format('g')}), {_NORM.format('prediction')}) AS DOUBLE)"
_TOKENS = "list_filter(string_split(" + _NORM + ", ' '), lambda w: w <> '')"
_TOKENISED = f"k AS (SELECT *, {_TOKENS.format('prediction')} AS pt, list_transform(truths, lambda g: {_TOKENS.format('g')}) AS gt FROM p)"
_COMMON = "list_sum(list_transform(list_distinct(pt), lambda u: least(len(list_filter(pt, lambda w: w = u)), len(list_filter(g, lambda w: w = u)))))"
_F1 = f"list_max(list_transform(gt, lambda g: CASE WHEN coalesce({_COMMON}, 0) = 0 THEN 0.0 ELSE 2.0 * {_COMMON} / (len(pt) + len(g)) END))"


@query(f"WITH {_ANSWERS} SELECT doc_id, CAST(part AS INTEGER) AS part, round({_ANLS}, 6) AS anls FROM p")
def metric_anls(spark, sf_dir):
    return evaluation.scored(answers(spark, sf_dir)).select("doc_id", "part", F.round("anls", 6).alias("anls"))


@query(f"WITH {_ANSWERS} SELECT doc_id, CAST(part AS INTEGER) AS part, {_EXACT} AS exact FROM p")
def metric_exact_match(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", "part", metrics.exact_match(F.col("prediction"), F.col("ground_truths")).alias("exact"))


@query(f"WITH {_ANSWERS}, {_TOKENISED} SELECT doc_id, CAST(part AS INTEGER) AS part, round({_F1}, 6) AS f1 FROM k")
def metric_token_f1(spark, sf_dir):
    return evaluation.scored(answers(spark, sf_dir)).select("doc_id", "part", F.round("f1", 6).alias("f1"))


@query(f"WITH {_ANSWERS}, {_TOKENISED} SELECT round(avg({_ANLS}), 4) AS anls, round(avg({_EXACT}), 4) AS accuracy, round(avg({_F1}), 4) AS f1, count(*) AS n FROM k")
def metric_all(spark, sf_dir):
    return evaluation.batch_metrics(answers(spark, sf_dir))


@query("""WITH p AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'So it goes. The final answer is: ' || (n_chars % 97) || '%' WHEN doc_id % 3 = 1 THEN 'Some text' || chr(10) || (n_chars % 97) ELSE 'ANSWER: ' || (n_chars % 97) || ',000' END AS said, n_chars % 89 AS truth FROM documents),
n AS (SELECT doc_id, truth, n_chars % 97 * CASE WHEN doc_id % 3 = 2 THEN 1000.0 ELSE 1.0 END AS got FROM p)
SELECT doc_id, CAST(CASE WHEN got = truth THEN 1 WHEN truth = 0 THEN (abs(got) <= 0.05)::INT ELSE (abs(got - truth) / truth <= 0.05)::INT END AS DOUBLE) AS relaxed FROM n""")
def metric_relaxed(spark, sf_dir):
    m, n = F.col("doc_id") % 3, (F.col("n_chars") % 97).cast("string")
    said = F.when(m == 0, F.concat(F.lit("So it goes. The final answer is: "), n, F.lit("%"))).when(m == 1, F.concat(F.lit("Some text\n"), n)).otherwise(F.concat(F.lit("ANSWER: "), n, F.lit(",000")))
    return read(spark, sf_dir, "documents").select("doc_id", metrics.relaxed_accuracy(said, F.array((F.col("n_chars") % 89).cast("string"))).alias("relaxed"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[^\x20-\x7e]', 'x', 'g')) AS t FROM conversations)
SELECT conv_id, turn, upper(coalesce(nullif(regexp_extract(t, '(?i)(?:answer)\s*[:\-]?\s*\(?([A-Ha-h])\)?', 1), ''), nullif(regexp_extract(t, '^\s*\(?([A-Ha-h])\)?[.):\s]', 1), ''), nullif(regexp_extract(t, '\(([A-Ha-h])\)', 1), ''),
    nullif(regexp_extract(t, '^([A-Ha-h])$', 1), ''), nullif(regexp_extract(t, '\b([A-Ha-h])\b', 1), ''), nullif(regexp_extract(t, '^([A-Ha-h])', 1), ''), '')) AS letter FROM t""")
def metric_mcq(spark, sf_dir):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]", "x")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.mcq_letter(t).alias("letter"))


@query()
def metric_crossdoc_score(spark, sf_dir):
    rows = metrics.with_crossdoc_score(answers(spark, sf_dir), F.col("prediction"), F.col("ground_truths"))
    return rows.select("doc_id", "part", F.round("crossdoc.score", 6).alias("score"), "crossdoc.method")


# --- the pair log ------------------------------------------------------------------------------------------------------

_TYPES = "['VQA', 'Reasoning', 'MCQ', 'InstructionFollowing']"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of pairs: a user is a pair, an error deletes it."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*map(F.lit, ("VQA", "Reasoning", "MCQ", "InstructionFollowing"))), (u % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.format_string("kdpo_%06d", u).alias("pair_id"), F.concat(F.lit("q "), (e % 50).cast("string")).alias("question"), F.concat(F.lit("a"), (e % 7).cast("string")).alias("chosen"),
        F.when(e % 7 == 3, F.concat(F.lit(" a"), (e % 7).cast("string"))).otherwise(F.concat(F.lit("b"), (e % 5).cast("string"))).alias("rejected"),
        F.lit("ko").alias("lang"), kind.alias("question_type"), F.when(u % 2 == 0, "auto").otherwise("user").alias("question_source"), F.lit("base").alias("model_version"), (u % 3).cast("int").alias("difficulty"),
        F.when(e % 3 == 0, F.array(F.concat(F.lit("img"), e.cast("string")))).otherwise(F.array().cast("array<string>")).alias("image_paths"),
        F.when(F.col("event_type") == "error", "deleted").otherwise("active").alias("status"), e.alias("log_seq"),
    )


_LOG = f"""log AS (
    SELECT 'kdpo_' || lpad(user_id::VARCHAR, 6, '0') AS pair_id, 'q ' || (event_id % 50) AS question, 'a' || (event_id % 7) AS chosen, CASE WHEN event_id % 7 = 3 THEN ' a' || (event_id % 7) ELSE 'b' || (event_id % 5) END AS rejected,
           {_TYPES}[user_id % 4 + 1] AS question_type, CASE WHEN user_id % 2 = 0 THEN 'auto' ELSE 'user' END AS question_source, user_id % 3 AS difficulty, event_id % 3 = 0 AS has_image,
           CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'active' END AS status, event_id AS log_seq
    FROM events
),
state AS (SELECT *, first_value(log_seq) OVER (PARTITION BY pair_id ORDER BY log_seq) AS first_seq FROM log QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY log_seq DESC) = 1),
active AS (SELECT * FROM state WHERE status = 'active'),
valid AS (SELECT * FROM active WHERE trim(chosen) <> trim(rejected))"""


@query(f"WITH {_LOG} SELECT pair_id, question, chosen, rejected, log_seq, first_seq FROM active")
def pairs_latest_state(spark, sf_dir):
    return pair_log.latest_state(event_log(spark, sf_dir)).select("pair_id", "question", "chosen", "rejected", "log_seq", "first_seq")


@query(f"""WITH {_LOG} SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM active UNION ALL SELECT 'deleted', '', count(*) FROM state WHERE status = 'deleted' UNION ALL SELECT 'with_image', '', count(*) FROM active WHERE has_image
UNION ALL SELECT 'question_type', question_type, count(*) FROM active GROUP BY 2 UNION ALL SELECT 'question_source', question_source, count(*) FROM active GROUP BY 2 UNION ALL SELECT 'model_version', 'base', count(*) FROM active HAVING count(*) > 0 UNION ALL SELECT 'difficulty', difficulty::VARCHAR, count(*) FROM active GROUP BY 2""")
def pairs_stats(spark, sf_dir):
    return pair_log.statistics(pair_log.latest_state(event_log(spark, sf_dir), include_deleted=True)).withColumn("value", F.coalesce("value", F.lit("")))


@query(f"WITH {_LOG} SELECT t AS question_type, count(pair_id) AS n FROM (SELECT unnest({_TYPES}) AS t) LEFT JOIN active ON question_type = t GROUP BY t")
def pairs_counts_by_type(spark, sf_dir):
    return pair_log.counts_by_type(pair_log.latest_state(event_log(spark, sf_dir)))


@query(f"WITH {_LOG}, k AS (SELECT pair_id, first_value(pair_id) OVER (PARTITION BY question, trim(chosen), trim(rejected) ORDER BY first_seq) AS duplicate_of FROM active) SELECT * FROM k WHERE pair_id <> duplicate_of")
def pairs_dedup_key(spark, sf_dir):
    return pair_log.duplicates(pair_log.latest_state(event_log(spark, sf_dir)))


@query("""SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'question is empty' WHEN turn % 5 = 4 THEN 'chosen or rejected is empty' WHEN turn % 5 = 3 THEN 'chosen equals rejected' WHEN role = 'system' THEN 'language differs from the configured one' WHEN turn % 5 = 2 THEN 'question type is not allowed' ELSE 'ok' END AS error FROM conversations""")
def pairs_validation(spark, sf_dir):
    m = F.col("turn") % 5
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.when(m == 4, "").otherwise("yes").alias("chosen"), F.when(m == 3, "yes").otherwise("no").alias("rejected"), F.when(F.col("role") == "system", "en").otherwise("ko").alias("lang"), F.when(m == 2, "Essay").otherwise("VQA").alias("question_type"), F.array().cast("array<string>").alias("image_paths"))
    return rows.select("conv_id", "turn", F.coalesce(pair_log.first_error("ko"), F.lit("ok")).alias("error"))


@query("SELECT max(user_id) + 1 AS next_number FROM events")
def pairs_next_id(spark, sf_dir):
    return pair_log.next_number(event_log(spark, sf_dir), "pair_id", pair_log.PAIR_PREFIX)


@query(f"WITH {_LOG} SELECT CASE WHEN has_image THEN 'img' || log_seq ELSE '' END AS image, question AS prompt, chosen, rejected FROM active")
def pairs_export_flat(spark, sf_dir):
    return pair_log.export(pair_log.latest_state(event_log(spark, sf_dir)), "flat", {"question": "prompt"})


@query(f"WITH {_LOG} SELECT CAST(has_image AS INTEGER) AS n_images, 'user' AS prompt_role, CAST(has_image AS INTEGER) + 1 AS prompt_parts, question AS prompt_text, chosen AS chosen_text, rejected AS rejected_text FROM active")
def pairs_export_chat(spark, sf_dir):
    rows = pair_log.export(pair_log.latest_state(event_log(spark, sf_dir)), "chat")
    last = lambda c: F.element_at(F.col(c)[0]["content"], -1)["text"]
    return rows.select(F.size("images").alias("n_images"), F.col("prompt")[0]["role"].alias("prompt_role"), F.size(F.col("prompt")[0]["content"]).alias("prompt_parts"), last("prompt").alias("prompt_text"), last("chosen").alias("chosen_text"), last("rejected").alias("rejected_text"))


@query(f"""WITH {_LOG}, s AS (SELECT question_type, 40 - count(*) AS shortfall FROM valid GROUP BY question_type HAVING count(*) < 40), c AS (SELECT least(120, count(*)) AS since, count(*) AS n_valid FROM valid)
SELECT since >= 100 AND (SELECT count(*) FROM s) = 0 AS should_train, CASE WHEN since < 100 THEN 'count' WHEN (SELECT count(*) FROM s) > 0 THEN 'type' ELSE 'ready' END AS reason, since, 100 AS threshold, greatest(0, 100 - since) AS remaining, n_valid FROM c""")
def trigger_decision(spark, sf_dir):
    got = training.decision(pair_log.latest_state(event_log(spark, sf_dir)), since_last_train=120, train_count=1, least=40)
    return got.select("should_train", "reason", "since", "threshold", "remaining", "n_valid")


@query(f"WITH {_LOG} SELECT question_type, 40 - count(*) AS shortfall FROM valid GROUP BY question_type HAVING count(*) < 40")
def type_shortfall(spark, sf_dir):
    valid = pair_log.training_pairs(pair_log.latest_state(event_log(spark, sf_dir)))
    return training.type_shortfall(valid, 40)


# --- checkpoints and training ------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT 'e' || user_id % 7 AS checkpoint, CASE WHEN event_type = 'error' THEN 'tie' WHEN event_id % 3 = 0 THEN 'trained' WHEN event_id % 3 = 1 THEN 'base' ELSE 'odd' END AS verdict FROM events),
c AS (SELECT coalesce(checkpoint, 'all') AS checkpoint, count(*) AS n, count(*) FILTER (verdict = 'trained') AS wins, count(*) FILTER (verdict = 'base') AS base_wins, count(*) FILTER (verdict = 'tie') AS ties FROM v GROUP BY ROLLUP (checkpoint))
SELECT *, round(wins / nullif(wins + base_wins, 0)::DOUBLE, 4) AS win_rate FROM c""")
def comparison_winrate(spark, sf_dir):
    e = F.col("event_id")
    verdict = F.when(F.col("event_type") == "error", "Tie").when(e % 3 == 0, "TRAINED").when(e % 3 == 1, "base").otherwise("odd")
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("e"), (F.col("user_id") % 7).cast("string")).alias("checkpoint"), verdict.alias("verdict"))
    return training.comparison_stats(rows).withColumn("checkpoint", F.coalesce("checkpoint", F.lit("all")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as training records; some lack a metric."""
    k = F.col("o_orderkey")
    values = F.array(F.struct(F.lit("anls").alias("k"), ((k % 1000) / 1000).alias("v")), F.struct(F.lit("accuracy").alias("k"), ((k % 777) / 777).alias("v")), F.struct(F.lit("f1").alias("k"), F.when(k % 4 != 0, (k % 321) / 321).alias("v")))
    kept = F.filter(values, lambda x: x["v"].isNotNull())
    return read(spark, sf_dir, "orders").select(F.format_string("adapter_epoch%03d", k).alias("checkpoint"), (k % 50).cast("double").alias("loss"), F.map_from_entries(kept).alias("eval"), k.alias("seq"))


_HISTORY = "h AS (SELECT 'adapter_epoch' || (CASE WHEN o_orderkey < 1000 THEN lpad(o_orderkey::VARCHAR, 3, '0') ELSE o_orderkey::VARCHAR END) AS checkpoint, CAST(o_orderkey % 50 AS DOUBLE) AS loss, o_orderkey % 1000 / 1000.0::DOUBLE AS anls, o_orderkey % 777 / 777.0::DOUBLE AS accuracy, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 321 / 321.0::DOUBLE END AS f1, o_orderkey AS seq FROM orders)"


@query(f"WITH {_HISTORY}, s AS (SELECT checkpoint, round((anls + accuracy + coalesce(f1, 0)) / (CASE WHEN f1 IS NULL THEN 2 ELSE 3 END), 4) AS score FROM h) SELECT checkpoint, score FROM s ORDER BY score DESC, checkpoint DESC LIMIT 1")
def best_checkpoint(spark, sf_dir):
    return training.best_checkpoint(history(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT seq, checkpoint, metric, round(value, 6) AS value FROM (SELECT seq, checkpoint, unnest(['anls', 'accuracy', 'f1']) AS metric, unnest([anls, accuracy, f1]) AS value FROM h) WHERE value IS NOT NULL")
def metric_series_long(spark, sf_dir):
    return training.metric_rows(history(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"WITH {_HISTORY} SELECT seq, checkpoint, loss, round(anls, 6) AS anls, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM h")
def metric_series_wide(spark, sf_dir):
    return training.metric_series(history(spark, sf_dir)).withColumns({m: F.round(m, 6) for m in training.METRICS})


def log_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    scaled = {"policy_chosen": -F.col("l_quantity") / 10, "policy_rejected": -F.col("l_extendedprice") / 10000, "ref_chosen": -F.col("l_discount") * 10, "ref_rejected": -F.col("l_tax") * 10}
    return rows.select(F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("step"), *[v.alias(k) for k, v in scaled.items()])


_LOSS = "x AS (SELECT l_returnflag AS run, l_orderkey, l_linenumber AS step, 0.1::DOUBLE * ((-l_quantity / 10 + l_extendedprice / 10000) - (-l_discount * 10 + l_tax * 10)) AS z FROM lineitem), y AS (SELECT *, greatest(-z, 0) + ln(1 + exp(-abs(z))) AS loss FROM x)"


@query(f"WITH {_LOSS} SELECT count(*) AS n, round(avg(loss), 6) AS mean_loss, round(avg((z > 0)::INT), 6) AS reward_accuracy FROM y")
def dpo_loss(spark, sf_dir):
    return training.loss_summary(log_probabilities(spark, sf_dir)).select("n", F.round("mean_loss", 6).alias("mean_loss"), F.round("reward_accuracy", 6).alias("reward_accuracy"))


@query(f"WITH {_LOSS}, s AS (SELECT l_orderkey AS run, CAST(place AS INTEGER) AS step, sum(loss) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING) / place AS running_loss FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY z) AS place FROM y)) SELECT run, step, round(running_loss, 5) AS running_loss FROM s WHERE step % 2 = 0")
def dpo_loss_curve(spark, sf_dir):
    rows = training.margin(log_probabilities(spark, sf_dir).drop("run", "step")).withColumnRenamed("order", "run")
    rows = rows.withColumn("step", F.row_number().over(Window.partitionBy("run").orderBy("logits")))
    return training.loss_curve(rows, ["run"], every=2).withColumn("running_loss", F.round("running_loss", 5))


# --- evaluation sets ---------------------------------------------------------------------------------------------------


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"))


_SPLIT = "s AS (SELECT paper_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || paper_id), paper_id) <= 40 THEN 'held_out' ELSE 'collect' END AS split FROM (SELECT DISTINCT 'd' || doc_id AS paper_id FROM documents))"


@query(f"WITH {_SPLIT} SELECT * FROM s")
def split_held_out(spark, sf_dir):
    return evaluation.split(papers(spark, sf_dir))


@query("""WITH k AS (SELECT paper_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || paper_id), paper_id) <= 40 THEN 'held_out' ELSE 'collect' END AS split FROM (SELECT DISTINCT 'd' || doc_id AS paper_id FROM documents WHERE lang = 'en'))
SELECT paper_id, split FROM k UNION ALL SELECT DISTINCT 'd' || doc_id, 'collect' FROM documents WHERE lang IS DISTINCT FROM 'en'""")
def split_incremental(spark, sf_dir):
    first = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"))
    return evaluation.extended_split(evaluation.split(first), papers(spark, sf_dir))


@query(f"WITH {_SPLIT} SELECT s.paper_id FROM s JOIN labels l ON s.paper_id = 'd' || l.doc_id WHERE split = 'held_out' GROUP BY s.paper_id")
def eval_leak_check(spark, sf_dir):
    held = evaluation.split(papers(spark, sf_dir)).where("split = 'held_out'")
    labelled = read(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"))
    return evaluation.overlap(held, labelled)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("VQA", "Reasoning", "MCQ"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("question_id"), kind.alias("question_type"), F.col("source").alias("paper_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("difficulty"), F.when(F.col("lang") == "en", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("image_paths"))


@query("""SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM documents UNION ALL SELECT 'papers', '', count(DISTINCT source) FROM documents UNION ALL SELECT 'with_image', '', count(*) FROM documents WHERE lang = 'en'
UNION ALL SELECT 'question_type', ['VQA', 'Reasoning', 'MCQ'][doc_id % 3 + 1], count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'difficulty', (doc_id % 4 + 1)::VARCHAR, count(*) FROM documents GROUP BY 2""")
def eval_dataset_stats(spark, sf_dir):
    return evaluation.statistics(items(spark, sf_dir)).withColumn("value", F.coalesce("value", F.lit("")))


@query("SELECT 'i' || doc_id AS question_id, source AS paper_id FROM documents ORDER BY md5('42|i' || doc_id), doc_id LIMIT 25")
def eval_sample(spark, sf_dir):
    return evaluation.sample(items(spark, sf_dir), 25).select("question_id", "paper_id")


@query("""WITH t AS (SELECT source AS paper_id, 'i' || doc_id AS item_id, row_number() OVER (PARTITION BY source ORDER BY md5('42|i' || doc_id), 'i' || doc_id) AS turn FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY turn, paper_id) - 1 AS place FROM t)
SELECT 'eko_' || lpad(place::VARCHAR, 6, '0') AS question_id, paper_id, item_id FROM n WHERE place < 60""")
def eval_draft_round_robin(spark, sf_dir):
    return evaluation.round_robin(items(spark, sf_dir).withColumnRenamed("question_id", "item_id"), 60).select("question_id", "paper_id", "item_id")


@query("SELECT s.source AS paper_id, CASE WHEN lead(s.source) OVER (ORDER BY s.source) IS NULL THEN (SELECT min(source) FROM documents) ELSE lead(s.source) OVER (ORDER BY s.source) END AS next_paper_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s")
def paper_navigation(spark, sf_dir):
    return evaluation.step_paper(read(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("paper_id")))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling_counts(spark, sf_dir):
    return logs.tumbling_counts(read(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
