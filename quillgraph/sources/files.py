"""Graphs, logs and evaluation sets as files.  Parquet is the engine's own format, JSON the one to exchange."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..operators.order import numbered
from ..schema import COMPARISONS, EDGES, EVAL_ITEMS, HISTORY, NODES, PAIRS, field_names
from .commits import Snapshot, Versions, written

_BAD = "_bad"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of JSON lines, a row {"node": ...} or {"edge": ...} each, so that no task holds a whole graph."""
    as_json = lambda df, name: df.select(F.to_json(F.struct(F.struct(*[F.col(c) for c in df.columns]).alias(name))).alias("value"))
    as_json(nodes, "node").unionByName(as_json(edges, "edge")).write.mode("overwrite").text(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines; a missing edge type is CONTAINS, weight and confidence are 1."""
    rows = spark.read.schema(f"node struct<{_struct(NODES)}>, edge struct<{_struct(EDGES)}>").json(path)
    nodes, edges = rows.where("node is not null").select("node.*"), rows.where("edge is not null").select("edge.*")
    return nodes, _edge_defaults(edges)


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def _edge_defaults(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_type", F.coalesce("edge_type", F.lit("CONTAINS"))).withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


DOCUMENT = "nodes array<map<string,string>>, edges array<struct<src_id: string, dst_id: string, edge_type: string, weight: string, confidence: string, metadata: map<string,string>>>"


def read_graph_document(spark: SparkSession, path: str, edge_metadata: bool = True) -> tuple[DataFrame, DataFrame]:
    """One JSON document {nodes, edges}: keys meta_* become metadata, ends of edges are not checked, bad numbers are null.

    edge_metadata=False drops the edges' metadata, as a database export without it does.  What `write_graph_document` wrote
    is read line by line by all tasks; a document from elsewhere may break its lines anywhere and is read by one.
    """
    if exists(spark, f"{path}/{_ROWS}"):
        rows, pairs = _document_rows(spark, path)
    else:
        whole = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
        rows, pairs = whole.select(F.posexplode("nodes").alias("seq", "n")), whole.select(F.posexplode("edges").alias("seq", "e"))
    key = lambda name: F.try_element_at("n", F.lit(name))
    meta = F.transform_keys(F.map_filter("n", lambda k, v: k.startswith("meta_")), lambda k, v: F.substring(k, 6, 10_000))
    inner = F.coalesce(F.from_json(key("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    joined = F.map_from_entries(F.map_entries(F.map_zip_with(inner, meta, lambda k, a, b: F.coalesce(b, a))))
    nodes = rows.select(
        F.coalesce(key("id"), key("node_id")).alias("node_id"), key("node_type").alias("node_type"), key("paper_id").alias("paper_id"),
        F.coalesce(key("page").try_cast("int"), F.lit(-1)).alias("page"), F.coalesce(key("content"), F.lit("")).alias("content"),
        key("image_path").alias("image_path"), F.col("seq").cast("bigint").alias("seq"), joined.alias("metadata"),
    )
    method, evidence = (F.try_element_at("e.metadata", F.lit(k)) if edge_metadata else F.lit(None).cast("string") for k in ("method", "evidence"))
    edges = pairs.select(
        "e.src_id", "e.dst_id", "e.edge_type", F.col("e.weight").try_cast("double").alias("weight"), F.col("e.confidence").try_cast("double").alias("confidence"),
        method.alias("method"), evidence.alias("evidence"), F.col("seq").cast("bigint").alias("seq"),
    )
    return nodes, _edge_defaults(edges)


#: Marks a folder whose files, one after another, are a document with a line for each row; lines of edges begin with a space.
_ROWS = "_rows"


def _document_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The places (seq) and values of nodes and edges of a document that has a line for each row."""
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("place")).where("value like '%}' and value <> ']}'")
    own = lambda start: lines.where(F.col("value").startswith(" ") == start)
    parsed = lambda shape: F.from_json(F.ltrim(F.col("value"), F.lit(" ,")), shape)
    item = DOCUMENT.split("edges array<")[1].removesuffix(">")
    nodes = numbered(own(False), ["place"], "seq").select("seq", parsed("map<string,string>").alias("n"))
    return nodes, numbered(own(True), ["place"], "seq").select("seq", parsed(item).alias("e"))


def write_graph_document(nodes: DataFrame, edges: DataFrame, path: str, file_rows: int = 100_000) -> None:
    """One JSON document {nodes, edges} as `read_graph_document` takes it: a line for each row, in files of about `file_rows` by ranges of its order.

    For exchange with tools that read whole documents: the files one after another, by their names, are the document.
    """
    spark = nodes.sparkSession
    known = [f for f in field_names(NODES) if f in nodes.columns]
    base = ("node_id", "node_type", "paper_id", "page", "content", "image_path")
    values = [F.col("node_id").alias("id"), *[F.col(c) for c in known if c in base], *[F.col(c).alias(f"meta_{c}") for c in known if c not in (*base, "seq")]]
    rows = nodes.select(F.lit(1).alias("part"), "seq", F.col("node_id").alias("key"), F.to_json(F.struct(*values)).alias("line"))
    meta = F.struct(*[F.col(c) for c in ("method", "evidence") if c in edges.columns])
    values = F.struct("src_id", "dst_id", "edge_type", "weight", "confidence", meta.alias("metadata"))
    rows = rows.unionByName(edges.select(F.lit(3).alias("part"), "seq", F.concat_ws(" ", "src_id", "dst_id", "edge_type").alias("key"), F.to_json(values).alias("line")))
    first = rows.groupBy("part").agg(F.min(F.struct("seq", "key")).alias("first"))  # two rows
    marked = rows.join(F.broadcast(first), "part")
    comma = F.concat(F.when(F.col("part") == 3, " ").otherwise(""), F.when(F.struct("seq", "key") == F.col("first"), "").otherwise(","))
    frame = spark.createDataFrame([(0, '{"nodes": ['), (2, '], "edges": ['), (4, "]}")], "part int, line string").select("part", F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("key"), "line")
    lines = marked.select("part", "seq", "key", F.concat(comma, "line").alias("line")).unionByName(frame)
    parts = max(1, -(-rows.count() // file_rows))
    lines.repartitionByRange(parts, "part", "seq", "key").sortWithinPartitions("part", "seq", "key").select("line").write.mode("overwrite").text(path)
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_ROWS}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark).close()


def read_graph_tables(spark: SparkSession, nodes: str, edges: str, where: str | None = None, args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A graph from two tables or views of the catalogue; `where` is a condition on nodes with named parameters, edges keep both ends."""
    from ..operators.graph import with_endpoints

    condition = f" WHERE {where}" if where else ""
    kept = spark.sql(f"SELECT * FROM IDENTIFIER(:quillgraph_nodes){condition}", {"quillgraph_nodes": nodes} | (args or {}))
    every = spark.table(edges)
    return kept, with_endpoints(every, kept) if where else every


#: How a graph is kept, by name: a writer (nodes, edges, path) and a reader (spark, path).
STORES = {"parquet": (write_graph, read_graph), "json": (write_graph_json, read_graph_json), "document": (write_graph_document, read_graph_document)}


def save_graph(store: str, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    _store(store)[0](nodes, edges, path)


def load_graph(spark: SparkSession, store: str, path: str) -> tuple[DataFrame, DataFrame]:
    return _store(store)[1](spark, path)


def clear_graph(store: str, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Leaves an empty graph of the same columns."""
    save_graph(store, nodes.limit(0), edges.limit(0), path)


def _store(name: str) -> tuple:
    if name not in STORES:
        raise ValueError(f"unknown graph store {name!r}; known are {sorted(STORES)}")
    return STORES[name]


def _lines(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """JSON lines in order as `place`; blank and broken lines are left out, and unknown keys kept in `unknown`.

    Published commits count, in their order, after files that lie in the path itself; with a version, those up to it.
    """
    log = Versions(spark, path)
    some = [*log.loose_files(), *log.places(log.snapshot(version))]
    file = F.col("_metadata.file_path")
    commit = F.coalesce(F.nullif(F.regexp_extract(file, r"/commit=(\d+)-[^/]*/", 1), F.lit("")).cast("bigint"), F.lit(0))
    place = F.struct(commit.alias("commit"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    if some:
        raw = spark.read.text(some).select("value", place.alias("place"))
    else:
        raw = spark.createDataFrame([], f"value string, place {PLACE}")
    parsed = raw.where(has_text(F.col("value"))).withColumn("row", F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    known = field_names(schema)
    everything = F.from_json("value", "map<string,string>")
    rest = F.map_filter(everything, lambda k, v: ~k.isin(*known))
    return parsed.where(f"row.{_BAD} is null").select("row.*", rest.alias("unknown"), "place").drop(_BAD)


#: The order of a log.
PLACE = "struct<commit: bigint, file: string, block: bigint, line: bigint>"


def append(rows: DataFrame, path: str, order: list[str] | None = None) -> int:
    """Appends rows as the next commit of a log and gives its number; `order` sorts them (and numbers their files) first.

    Several writers may append: each commit is published whole, under a number of its own.
    """
    return Versions(rows.sparkSession, path).append(written(rows.orderBy(*order) if order else rows))


def read_pairs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The pair log, in order of `log_seq` (a struct of commit, file, block and line); unknown keys go into the notes."""
    rows = _lines(spark, path, PAIRS, version).withColumnRenamed("place", "log_seq")
    extra = F.when(F.size("unknown") > 0, F.to_json("unknown"))
    return rows.withColumn("notes", F.concat_ws(" | ", F.nullif(F.col("notes"), F.lit("")), extra)).withColumn("status", F.coalesce("status", F.lit("active"))).drop("unknown")


def append_pairs(rows: DataFrame, path: str) -> int:
    """Appends to the pair log; rows stay in the order of pair_id, and of log_seq if they have one."""
    return append(_in_log_order(rows), path)


def _in_log_order(rows: DataFrame) -> DataFrame:
    order = [c for c in ("log_seq", "pair_id") if c in rows.columns]
    return rows.orderBy(*order).select(*[c for c in field_names(PAIRS) if c in rows.columns])


def change_pairs(spark: SparkSession, path: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Appends what `compute` makes of the log, as long as nobody has appended meanwhile; else it is computed again.

    So rows that are checked against the log and numbered by it are right for the log that they are added to.  Gives the
    number of rows appended.
    """
    log, n = Versions(spark, path), 0

    def made(base: Snapshot) -> dict | None:
        nonlocal n
        name = f"commit={base.version + 1:012d}-{log.aside()[-32:]}"  # named by no version until it is published
        _in_log_order(compute(read_pairs(spark, path, base.version))).write.mode("errorifexists").json(f"{path}/{name}")
        n = spark.read.text(f"{path}/{name}").count()
        return {"put": {name: name}} if n else None

    log.change(made)
    return n


def append_comparison(rows: DataFrame, path: str, created_at: str | None = None) -> int:
    """Appends comparisons; those without a time get the present one."""
    from .state import stamp

    now = F.lit(created_at or stamp())
    time = F.coalesce("created_at", now) if "created_at" in rows.columns else now
    return append(rows.withColumn("created_at", time), path)


def comparison_places(spark: SparkSession, path: str) -> DataFrame:
    """Comparisons with their place in the log."""
    return _lines(spark, path, COMPARISONS).drop("unknown")


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    return comparison_places(spark, path).drop("place")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of training records, in its order."""
    return spark.read.schema(HISTORY).option("multiLine", True).json(path).withColumn("seq", F.monotonically_increasing_id())


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items: question_text, answer and context_text are accepted for question, ground_truths and context.

    Items without an id get one by their place in the file.
    """
    schema = EVAL_ITEMS + ", question_text string, answer string, context_text string"
    rows = numbered(_lines(spark, path, schema), ["place"], "number")
    truths = F.coalesce("ground_truths", F.when(F.col("answer").isNotNull(), F.array("answer")), F.array().cast("array<string>"))
    out = rows.withColumns({
        "question_id": F.coalesce("question_id", F.format_string("q_%06d", F.col("number"))),
        "question": F.coalesce("question", "question_text", F.lit("")), "ground_truths": truths, "context": F.coalesce("context", "context_text", F.lit("")),
        "question_type": F.coalesce("question_type", F.lit("VQA")), "image_paths": F.coalesce("image_paths", F.array().cast("array<string>")), "difficulty": F.coalesce("difficulty", F.lit(1)),
    })
    return out.select(*field_names(EVAL_ITEMS))


def read_self_play(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered(_lines(spark, path, "question string, type string, chosen string, images array<string>, reward double").where("chosen is not null"), ["place"], "number")
    return rows.select(F.col("question"), F.coalesce("type", F.lit("VQA")).alias("question_type"), F.array("chosen").alias("ground_truths"), F.coalesce("images", F.array().cast("array<string>")).alias("image_paths"), "reward", F.format_string("sp_%06d", "number").alias("question_id"))


def write_split(split: DataFrame, path: str) -> None:
    """paper_id and split as JSON lines."""
    split.select("paper_id", "split").write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("paper_id string, split string").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path and the SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def copied_images(images: DataFrame, root: str, folder: str) -> DataFrame:
    """path, name and copied, for images (path relative to root, name of the copy); files that are missing are left out, and told.

    Each file is written under a name of its own and renamed, so a task that runs again leaves one whole copy.
    """
    import pandas as pd

    def run(batches):
        import uuid

        from pyarrow import fs

        source, top = fs.FileSystem.from_uri(root)
        target, out = fs.FileSystem.from_uri(folder)
        target.create_dir(out, recursive=True)
        for rows in batches:
            done = []
            for path, name in zip(rows["path"], rows["name"]):
                whole = f"{top}/{path}"
                there = source.get_file_info(whole).type == fs.FileType.File
                if there:
                    part = f"{out}/.{uuid.uuid4().hex}"
                    fs.copy_files(whole, part, source_filesystem=source, destination_filesystem=target)
                    target.move(part, f"{out}/{name}")
                done.append(there)
            yield pd.DataFrame({"path": rows["path"], "name": rows["name"], "copied": done})

    return images.select("path", "name").mapInPandas(run, "path string, name string, copied boolean")


def adapters(spark: SparkSession, root: str) -> DataFrame:
    """The adapter folders (with adapter_config.json): name, epoch (-1 without one) and time, newest first."""
    files = spark.read.format("binaryFile").load(f"{root}/*/adapter_config.json").select(F.regexp_extract("path", r"([^/]+)/adapter_config\.json$", 1).alias("name"), F.col("modificationTime").alias("created_at"))
    epoch = F.coalesce(F.nullif(F.regexp_extract("name", r"epoch(\d+)", 1), F.lit("")).try_cast("int"), F.lit(-1))
    return files.withColumn("epoch", epoch).orderBy(F.desc("epoch"), F.desc("created_at"))


def next_adapter(names: DataFrame) -> DataFrame:
    from ..operators.pairs import ADAPTER_PREFIX, next_number

    return next_number(names, "name", ADAPTER_PREFIX).select(F.concat(F.lit(ADAPTER_PREFIX), F.lpad(F.col("next_number").cast("string"), 3, "0")).alias("name"))
