"""Registered queries of logs that several writers share, of keyed state on streams, and of tables laid out for their readers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import pairs as pair_log
from ..sources import files, layout
from ..sources.commits import Versions
from ..sources.scratch import shared_path
from ..streaming import logs, states
from .catalogue import ORACLE_SQL, query, read
from .collection import Collection
from .operations import element_counts, fed_in_halves, paper_layouts

# --- several writers ---------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'trained' ELSE 'base' END AS verdict, count(*) AS n, 2 AS commits, 1 AS commits_of_one FROM events GROUP BY 1")
def log_two_writers(spark, sf_dir):
    """Two writers append to one log at once: each append is a commit of its own, whole and in one order."""
    path, e = shared_path(spark, "log"), F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.lit("a").alias("checkpoint"), F.when(e % 2 == 0, "trained").otherwise("base").alias("verdict"))
    with ThreadPoolExecutor(2) as threads:
        list(threads.map(lambda v: files.append_comparison(rows.where(F.col("verdict") == v), path), ("trained", "base")))
    log = files.comparison_places(spark, path)
    commits = Versions(spark, path).snapshot().version
    return log.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.lit(commits).alias("commits"), F.count_distinct("place.commit").cast("int").alias("commits_of_one"))


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)
SELECT count(*) AS n, count(*) AS ids, max(1 + (SELECT count(*) FROM e)) AS highest FROM e""")
def pairs_two_sessions(spark, sf_dir):
    """Two sessions add pairs to one log at once, each with the other's pairs among its own: no pair twice, no id twice, no gap."""
    path = shared_path(spark, "pairs")
    files.append_pairs(spark.createDataFrame([("kdpo_000001", "first", "a", "b", "active")], "pair_id string, question string, chosen string, rejected string, status string"), path)
    blank = files.read_pairs(spark, path).drop("log_seq", "pair_id", "question", "chosen", "rejected", "status", "lang", "question_type")
    asked = read(spark, sf_dir, "events").where("event_type is not null and user_id is not null").select(F.concat_ws(" ", F.lit("what does"), F.col("user_id").cast("string"), "event_type").alias("question"), (F.col("user_id") % 3).alias("part"))
    new = asked.withColumns({"pair_id": F.lit(None).cast("string"), "chosen": F.lit("one"), "rejected": F.lit("two"), "seq": F.col("question"), "status": F.lit(None).cast("string"), "lang": F.lit("en"), "question_type": F.lit("VQA")})
    new = new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in blank.schema})

    def session(part: int) -> int:
        own = new.where(F.col("part") != part).drop("part")
        return files.change_pairs(spark, path, lambda log: pair_log.added(log, own, "en"))

    with ThreadPoolExecutor(2) as threads:
        added = sum(threads.map(session, (0, 1)))
    log = files.read_pairs(spark, path).where("question <> 'first'")
    number = F.regexp_extract("pair_id", r"(\d+)$", 1).cast("bigint")
    got = log.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("ids"), F.max(number).alias("highest"))
    return got.where(F.col("n") == added)


# --- keyed state -------------------------------------------------------------------------------------------------------


@query("""SELECT 'u' || user_id AS pair_id, max(event_id) AS log_seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def stream_pair_states(spark, sf_dir):
    """The last row of each pair in the engine's state store, over a query that is stopped and started again."""
    checkpoint, out = shared_path(spark, "checkpoint"), shared_path(spark, "changes")
    keyed = lambda e: e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pair_id"), F.col("event_id").alias("log_seq"), "event_type", "value")

    def start(events):
        with states.state_store(spark):
            changes = states.row_changes(keyed(events))
            return logs.in_batches(changes, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), checkpoint, "update")

    fed_in_halves(spark, sf_dir, start)
    return states.stored_states(spark, checkpoint, keyed(read(spark, sf_dir, "events")).schema)


@query("""WITH f AS (SELECT user_id, min(event_id % 2) AS half FROM events WHERE user_id IS NOT NULL GROUP BY 1), n AS (SELECT half, count(*) AS n FROM f GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS calls, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs FROM n WHERE n >= 5""")
def stream_new_pair_calls(spark, sf_dir):
    """Training is due by pairs that are new to the state store, not by rows: later rows of a pair do not count again."""
    calls: list[int] = []
    due = shared_path(spark, "due")

    def start(events):
        keyed = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pair_id"), F.col("event_id").alias("log_seq"))
        with states.state_store(spark):
            return logs.train_when_due(states.row_changes(keyed).where("is_new"), due, 5, calls.append)

    fed_in_halves(spark, sf_dir, start)
    return spark.createDataFrame([(len(calls), sum(calls))], "calls bigint, pairs bigint")


# --- layouts as a data source ------------------------------------------------------------------------------------------


@query(f"SELECT *, CAST(paper_id[2:] AS BIGINT) % 2 + 1 AS batch FROM ({ORACLE_SQL['layout_elements']})")
def layout_stream(spark, sf_dir):
    """Layouts that arrive in two halves, as a stream that is started twice: each is opened once, in the run that found it."""
    root, out, listing, checkpoint = (shared_path(spark, n) for n in ("papers", "elements", "listing", "checkpoint"))
    docs = read(spark, sf_dir, "documents")
    for part in (0, 1):
        paper_layouts(docs.where(F.col("doc_id") % 2 == part)).write.mode("append").json(root)
        stream = layout.source_stream(spark, root, listing)
        write = lambda batch, number: layout.elements(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        logs.in_batches(stream, write, checkpoint).awaitTermination()
    found = spark.read.parquet(out)
    runs = found.select("batch").distinct().select("batch", F.row_number().over(Window.orderBy("batch")).cast("bigint").alias("run"))  # two rows
    counted = found.groupBy("batch", "paper_id", "page", "element_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    return counted.join(runs, "batch").select("paper_id", "page", "element_type", "n", "chars", F.col("run").alias("batch"))


@query(f"SELECT * FROM ({ORACLE_SQL['layout_elements']}) WHERE paper_id IN ('d1', 'd7', 'd40')")
def layout_some_papers(spark, sf_dir):
    """The layouts of three papers: the condition reaches the source, which passes over other papers' lines."""
    root = shared_path(spark, "papers")
    paper_layouts(read(spark, sf_dir, "documents")).write.json(root)
    return element_counts(layout.elements(layout.source(spark, root).where(F.col("paper_id").isin("d1", "d7", "d40"))))


# --- a collection, step by step ----------------------------------------------------------------------------------------


def opened(spark, root: str) -> Collection:
    """A collection whose places lie in the shared folder; its state is a small file of the driver's there."""
    place = shared_path(spark, "collection")
    paths = {"data_root": root, "pairs": f"{place}/pairs", "state": f"{place.removeprefix('file://')}/state.json", "graph": f"{place}/graph"}
    config = {"paths": paths, "model": {"name": "none-hf"}, "language": "en", "kg": {"language": "en", "parser": "source"}, "train": {"first_train_min_pairs": 2, "min_pairs_per_type": 0}}
    return Collection(spark, config)


@query(r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
t AS (SELECT doc_id, array_to_string(list_transform(list_filter(range(len(a)), lambda i: i % 5 < 3), lambda i: a[i + 1]), ' ')[1:6000] AS sample FROM l),
g AS (SELECT doc_id, 'd' || doc_id AS paper_id, CASE WHEN length(regexp_replace(sample, '[^A-Za-z]', '', 'g')) < 50 THEN 'unknown' ELSE 'en' END AS language FROM t),
h AS (SELECT paper_id FROM g WHERE doc_id % 2 = 0 ORDER BY md5('42|' || paper_id), paper_id LIMIT 40)
SELECT paper_id, language, CASE WHEN paper_id IN (SELECT paper_id FROM h) THEN 'held_out' ELSE 'collect' END AS split, language = 'en' AND paper_id NOT IN (SELECT paper_id FROM h) AS collected FROM g""")
def collection_papers(spark, sf_dir):
    """Papers of a collection that grows: languages by the stream, a split that stays as drawn, and what is to be collected."""
    root, docs = shared_path(spark, "papers"), read(spark, sf_dir, "documents")
    collection = opened(spark, root)
    for part in (0, 1):
        paper_layouts(docs.where(F.col("doc_id") % 2 == part)).write.mode("append").json(root)
        languages, split = collection.languages(), collection.split()
    own = collection.papers().select("paper_id", F.lit(True).alias("own"))
    return languages.join(split, "paper_id").join(own, "paper_id", "left").select("paper_id", "language", "split", F.coalesce("own", F.lit(False)).alias("collected"))


@query("""WITH j AS (SELECT 'q ' || doc_id % 400 AS question, 'c ' || coalesce(source, 'none') AS chosen, doc_id,
    CASE WHEN doc_id % 7 = 0 THEN 'c ' || coalesce(source, 'none') WHEN doc_id % 11 = 0 THEN '' ELSE 'r ' || doc_id % 3 END AS rejected FROM documents)
SELECT DISTINCT '' AS picture, question, chosen, rejected FROM j WHERE doc_id % 13 <> 0 AND rejected <> '' AND rejected <> chosen AND question NOT LIKE '%7'""")
def collection_export(spark, sf_dir):
    """Judged pairs saved in two sessions, some of them deleted, and the rest exported and read back."""
    collection, d = opened(spark, shared_path(spark, "papers")), F.col("doc_id")
    chosen = F.concat(F.lit("c "), F.coalesce("source", F.lit("none")))
    rejected = F.when(d % 7 == 0, chosen).when(d % 11 == 0, "").otherwise(F.concat(F.lit("r "), (d % 3).cast("string")))
    judged = read(spark, sf_dir, "documents").select(d.alias("seq"), F.concat(F.lit("q "), (d % 400).cast("string")).alias("question"), chosen.alias("chosen"), rejected.alias("rejected"), F.when(d % 13 == 0, "none").otherwise("VQA").alias("question_type"))
    for part in (0, 1):
        collection.save(judged.where((F.col("seq") % 2 == part) | (F.col("seq") % 3 == 0)))
    collection.delete(collection.active().where("question LIKE '%7'").select("pair_id"), "not wanted")
    collection.config["export"] = {"format": "flat", "field_map": {"image": "picture"}}
    return spark.read.schema("picture string, question string, chosen string, rejected string").json(f"{collection.export(images=False)}/data")
