"""Graph, path, log, training and evaluation operators on a golden mini-corpus and small logs."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.operators import enrichment, evaluation, graph, pairs, paths, references, similarity, structure, training
from quillgraph.plans import corpus
from quillgraph.schema import PAIRS
from quillgraph.sources import files, layout, state
from quillgraph.streaming import logs


def page(number, titles=(), authors=(), texts=(), visuals=(), tables=()):
    say = lambda x: {"text": x} if isinstance(x, str) else x
    return {"page_number": number, "title_elements": list(map(say, titles)), "author_elements": list(map(say, authors)), "text_elements": list(map(say, texts)), "visual_elements": list(visuals), "table_elements": list(tables)}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    one = [
        page(1, ["1. Introduction"], ["Some Author"], ["See Fig. 1 and Table 1.", "", {"text": "unsure", "confidence": 0.39}, {"text": "sure", "confidence": 0.4}], [{"image_path": "images/a.png", "caption": "Fig. 1 a caption"}], [{"caption": "only caption"}]),
        page(2, [], [], ["text on page two, figure 1a again", "2.1.3 Deep", "under deep, Fig. 7"], [{"caption": None}]),
    ]
    two = [page(None, [], [], ["그림 1 에서 보듯", "온도 25", "그림 <1> 그리고 표 1"], [{"image_path": "b.png", "caption": "그림"}], [{"text": "<table><tr><td>x</td></tr></table>"}])]
    for name, pages in {"p1": one, "p2": two}.items():
        (top / name / "images").mkdir(parents=True)
        (top / name / "parsing_paddle.json").write_text(json.dumps({"pages": pages}, ensure_ascii=False))
    (top / "p1/images/a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 200 + b"IEND\xaeB`\x82")
    (top / "p2/images/b.png").write_bytes(b"x" * 50)
    (top / "not_a_paper").mkdir()
    return str(top)


def test_layout(spark, root):
    assert [r[0] for r in layout.list_papers(spark, root).collect()] == ["p1", "p2"]
    rows = layout.elements(layout.layouts(spark, root))
    got = {(r["paper_id"], r["element_type"]) for r in rows.collect()}
    assert ("p1", "author") in got
    kinds = Counter(r["element_type"] for r in rows.where("paper_id = 'p1'").collect())
    assert kinds == {"title": 1, "author": 1, "text": 6, "figure": 2, "table": 1}
    assert rows.where("paper_id = 'p2'").select("page").distinct().collect()[0][0] == -1
    resolved = {r["image_path"] for r in layout.with_images(rows.where("element_type = 'figure'"), spark, root).collect()}
    assert resolved == {"p1/images/a.png", "p2/images/b.png", None}
    known = spark.createDataFrame([("p1", "cached")], "paper_id string, language string")
    assert {tuple(r) for r in layout.paper_languages(layout.layouts(spark, root), known).collect()} == {("p1", "cached"), ("p2", "unknown")}
    assert layout.usable_images(spark, [f"{root}/*/images/*.png"]).count() == 1


def test_structure_and_references(spark, root):
    rows = layout.elements(layout.layouts(spark, root))
    nodes, edges = structure.structural_graph(rows)
    ids = {r["node_id"]: r for r in nodes.collect()}
    assert {k for k in ids if k.startswith("p1")} == {"p1__paper", "p1__sec_1", "p1__text_1", "p1__text_2", "p1__fig_1", "p1__cap_fig_1", "p1__tab_1", "p1__cap_tab_1", "p1__text_3", "p1__sec_2", "p1__text_4", "p1__fig_2"}
    assert ids["p1__sec_2"]["depth"] == 3 and ids["p1__tab_1"]["content"] == "only caption" and ids["p1__fig_1"]["has_image"]
    parents = {r["dst_id"]: r["src_id"] for r in edges.collect()}
    assert parents["p1__text_3"] == "p1__sec_1" and parents["p1__fig_2"] == "p1__sec_2" and parents["p1__sec_2"] == "p1__paper" and parents["p1__cap_fig_1"] == "p1__fig_1" and parents["p2__text_1"] == "p2__paper"
    refs = Counter((r["src_id"], r["dst_id"]) for r in references.reference_edges(nodes).collect())
    assert refs == {("p1__text_1", "p1__fig_1"): 1, ("p1__text_1", "p1__tab_1"): 1, ("p1__cap_fig_1", "p1__fig_1"): 1, ("p1__text_3", "p1__fig_1"): 1}
    korean = references.reference_edges(nodes, korean=True)
    assert ("p2__text_1", "p2__fig_1") in {(r["src_id"], r["dst_id"]) for r in korean.collect()}
    more = {(r["src_id"], r["dst_id"]) for r in references.augmented_references(nodes, korean).collect()}
    assert more == {("p2__text_3", "p2__fig_1")}
    all_nodes, all_edges = corpus.build(rows)
    ends = {r["node_id"] for r in all_nodes.collect()}
    got = all_edges.collect()
    assert all(r["src_id"] in ends and r["dst_id"] in ends for r in got)
    assert len({(r["src_id"], r["dst_id"], r["edge_type"]) for r in got}) == len(got)
    assert graph.corpus_statistics(all_nodes, all_edges).first()["korean_ref_edges"] == 1
    related = enrichment.visual_text_pairs(nodes, references.reference_edges(nodes))
    assert {r["paper_id"] for r in related.collect()} == {"p1"}


def test_all_figures_of_a_paper_meet_the_texts_near(spark):
    """As many figures as a paper has, on full pages, on pages between texts, and away from texts."""
    said = "a text that is long enough to be met, " * 2
    figures = [(f"p{q}__fig_{i}", "Figure", f"p{q}", i // 30, "", f"i{i}.png", 1000 * i) for q in (1, 2) for i in range(240)]
    texts = [(f"p{q}__text_{i}", "TextBlock", f"p{q}", (0, 2, 2, 3)[i % 4] if i < 36 else 7, said, None, 900 * (i * 7 % 40) + 1) for q in (1, 2) for i in range(40)]
    more = [("p1__text_short", "TextBlock", "p1", 5, "short", None, 5), ("p1__fig_bare", "Figure", "p1", 2, "", None, 6), ("p3__fig_1", "Figure", "p3", 1, "", "i.png", 1), ("p3__text_1", "TextBlock", "p3", 1, said, None, 2)]
    rows = figures + texts + more
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, paper_id string, page int, content string, image_path string, seq bigint")
    edges = spark.createDataFrame([("p3__text_1", "p3__fig_1", "REFERENCES")], "src_id string, dst_id string, edge_type string")
    want = {("p3", "p3__text_1", "p3__fig_1")}
    for v in (r for r in rows if r[1] == "Figure" and r[5] and r[2] != "p3"):
        own = [t for t in rows if t[1] == "TextBlock" and t[2] == v[2] and len(t[4]) > 50]
        near = [t for t in own if t[3] == v[3]] or [t for t in own if abs(t[3] - v[3]) <= 1]
        want |= {(v[2], t[0], v[0]) for t in sorted(near, key=lambda t: (t[6], t[0]))[: enrichment.NEAR_TEXTS]}
    got = [tuple(r) for r in enrichment.visual_text_pairs(nodes, edges).collect()]
    assert len(got) == len(want) and set(got) == want
    assert enrichment.visual_nodes(nodes).count() == 481


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(f"n{i}", ("Figure", "TextBlock", "Table", "Claim")[i % 4], f"p{i % 2}", i, f"content {i} words here", f"i{i}.png" if i % 4 == 0 else None, i, None) for i in range(8)], "node_id string, node_type string, paper_id string, page int, content string, image_path string, seq bigint, is_caption boolean")
    edges = spark.createDataFrame([("n0", "n1", "CONTAINS", 1.0, 1), ("n0", "n1", "REFERENCES", 1.0, 0), ("n1", "n2", "SUPPORTS", 3.0, 2), ("n2", "n0", "COMPARES", 1.0, 3), ("n1", "n3", "QUANTIFIES", 0.0, 4), ("n9", "n1", "CONTAINS", 1.0, 5)], "src_id string, dst_id string, edge_type string, weight double, seq bigint")
    return nodes, edges


def test_graph(spark, small):
    nodes, edges = small
    assert graph.with_endpoints(edges, nodes).count() == 5
    kept, among = graph.subgraph(nodes, edges, nodes.where("seq < 2"))
    assert kept.count() == 2 and among.count() == 2
    again = graph.upsert_nodes(nodes, nodes.where("node_id = 'n1'").withColumn("content", F.lit("new")).withColumn("seq", F.lit(99).cast("bigint")))
    assert again.where("node_id = 'n1'").first()["content"] == "new" and again.count() == 8
    assert graph.neighbors(edges, nodes, "n0").count() == 2
    merged_nodes, merged_edges = graph.merge([(nodes, edges), (nodes.withColumn("content", F.lit("late")), edges.limit(0))])
    assert {r[0] for r in merged_nodes.select("content").collect()} == {"late"} and merged_edges.count() == 6
    assert graph.statistics(nodes, edges).where("type is null and kind = 'node'").first()["n"] == 8


def test_paths(spark, small):
    nodes, edges = small
    edges = graph.with_endpoints(edges, nodes)
    assert {tuple(r["edge_types"]) for r in paths.expand(nodes.where("node_id = 'n0'"), edges, 2).collect()} == {("REFERENCES", "SUPPORTS"), ("REFERENCES", "QUANTIFIES")}
    walks = {r["start_id"]: r["path"] for r in paths.random_walk(nodes, edges, 4).collect()}
    assert walks["n0"] == ["n0", "n1", "n2", "n0", "n1"] and walks["n5"] == ["n5"]
    got = paths.sample_paths(nodes, edges, 6, max_hops=3).collect()
    assert [tuple(r["path"]) for r in got] == [tuple(r["path"]) for r in paths.sample_paths(nodes, edges, 6, max_hops=3).collect()]
    assert len({tuple(r["path"]) for r in got}) == len(got) == 6 and all(len(set(r["path"])) == len(r["path"]) for r in got)
    held = spark.createDataFrame([("p0",)], "paper_id string")
    assert {r["paper_id"] for r in paths.sample_paths(nodes, edges, 20, excluded=held).collect()} == {"p1"}
    assert all(r["image_paths"] for r in paths.sample_paths(nodes, edges, 5, require_image=True).collect())
    own = paths.described(spark.createDataFrame([(0, ["n0", "n1"], ["REFERENCES"])], "try bigint, path array<string>, edge_types array<string>"), nodes, {"REFERENCES": 7}, {"REFERENCES": "MCQ"}).first()
    assert (own["difficulty"], own["question_type"]) == (7, "MCQ")
    one = paths.path_from_node(nodes, edges, "n1", 1).first()
    assert one["difficulty"] == 2 and one["context"].startswith("[TextBlock] (p.1) content 1")


def test_similarity(spark):
    rng = __import__("random").Random(4)
    vectors = [(f"v{i}", f"p{i % 3}", i, [rng.gauss(0, 1) for _ in range(4)], ("Claim", "Figure", "TextBlock")[i % 3]) for i in range(40)] + [("zero", "p0", 99, [0.0] * 4, "Claim")]
    df = spark.createDataFrame(vectors, "node_id string, paper_id string, seq bigint, embedding array<double>, node_type string")
    unit = {v[0]: [x / (math.sqrt(sum(y * y for y in v[3])) or 1) for x in v[3]] for v in vectors}
    dot = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b]))
    across = {(a[0], b[0]) for a in vectors for b in vectors if a[2] < b[2] and a[1] != b[1] and dot(a[0], b[0]) >= 0.6}
    for block in (7, 512):
        assert {(r[0], r[1]) for r in similarity.similar_pairs(df, 0.6, False, block).select("src_id", "dst_id").collect()} == across
        within = {(a[0], b[0]) for a in vectors for b in vectors if a[0] != b[0] and a[1] == b[1] and dot(a[0], b[0]) >= 0.6}
        assert {(r[0], r[1]) for r in similarity.similar_pairs(df, 0.6, True, block).select("src_id", "dst_id").collect()} == within
    assert max(Counter(r["src_id"] for r in similarity.semantic_edges(df, 0.1, 3).collect()).values()) == 3


def test_cross_document_links_at_equal_places(spark):
    """Nodes at the same place of different papers are linked, from the earlier paper to the later."""
    schema = "paper_id string, page int, page_pos int, kind_rank int, elem_pos int, element_type string, content string, caption string, image_path string, confidence double"
    rows = spark.createDataFrame([(p, 1, 0, 1, k, "text", f"paragraph {k} of a paper, long enough to be compared", None, None, None) for p in ("b", "c", "a") for k in range(3)], schema)
    vectors = {f"{p}__text_{k + 1}": [float(k == j) for j in range(3)] for p in "abc" for k in range(3)}
    embeddings = spark.createDataFrame(list(vectors.items()), "node_id string, embedding array<double>")
    _, edges = corpus.build(rows, corpus.Options(cross_document=True), embeddings)
    got = Counter((r["src_id"], r["dst_id"]) for r in edges.where("edge_type = 'SAME_CONCEPT'").collect())
    assert got == Counter({(f"{p}__text_{k}", f"{q}__text_{k}"): 1 for k in (1, 2, 3) for p, q in ("ab", "ac", "bc")})


def log_rows(spark, rows):
    base = dict(question="q", chosen="a", rejected="b", paper_id="p", created_at="2024-01-01T00:00:00+09:00", lang="ko", question_source="auto", question_type="VQA", difficulty=1, kg_provenance=None, gold_answer="", image_paths=[], candidates=[], chosen_idx=0, rejected_idx=1, annotator="", model_version="base", notes="", status="active")
    names = ["pair_id", *base]
    return spark.createDataFrame([tuple((base | r)[n] if n != "pair_id" else r["pair_id"] for n in names) + (i,) for i, r in enumerate(rows)], PAIRS.rstrip() + ", log_seq bigint")


def test_pair_log(spark, tmp_path):
    log = log_rows(spark, [
        {"pair_id": "kdpo_000001", "question": "one"}, {"pair_id": "kdpo_000002", "question": "two"}, {"pair_id": "kdpo_000001", "question": "one again"},
        {"pair_id": "kdpo_000003", "status": "deleted"}, {"pair_id": "kdpo_000004", "question": " two "}, {"pair_id": "kdpo_000005", "chosen": "x ", "rejected": "x"},
    ])
    active = pairs.latest_state(log)
    assert {r["pair_id"]: r["question"].strip() for r in active.collect()} == {"kdpo_000001": "one again", "kdpo_000002": "two", "kdpo_000004": "two", "kdpo_000005": "q"}
    assert [tuple(r) for r in pairs.duplicates(active).collect()] == [("kdpo_000004", "kdpo_000002")]
    assert pairs.next_number(log, "pair_id", pairs.PAIR_PREFIX).first()[0] == 6
    new = log_rows(spark, [{"pair_id": None, "question": "two"}, {"pair_id": None, "question": "fresh"}, {"pair_id": None, "question": "fresh "}, {"pair_id": None, "question": "", "chosen": "z"}]).withColumnRenamed("log_seq", "seq")
    got = pairs.added(log, new).collect()
    assert [(r["pair_id"], r["question"]) for r in got] == [("kdpo_000006", "fresh")]
    gone = pairs.tombstones(log, spark.createDataFrame([("kdpo_000002",), ("kdpo_000003",), ("none",)], "pair_id string"), "why").collect()
    assert [(r["pair_id"], r["status"], r["notes"]) for r in gone] == [("kdpo_000002", "deleted", "deleted: why")]
    assert [r["pair_id"] for r in pairs.training_pairs(active, 2).collect()] == ["kdpo_000002", "kdpo_000004"]
    with pytest.raises(ValueError):
        pairs.export(active, "other")
    path = str(tmp_path / "log")
    pairs_out = log.drop("log_seq")
    files.append_pairs(pairs_out, path)
    (tmp_path / "log" / "more.json").write_text('not json\n\n{"pair_id": "kdpo_000009", "odd": 7}\n')
    back = files.read_pairs(spark, path)
    assert back.count() == 7 and json.loads(back.where("pair_id = 'kdpo_000009'").first()["notes"]) == {"odd": "7"}
    names = [r["name"] for r in pairs.exported_images(log_rows(spark, [{"pair_id": "k", "image_paths": ["a/b.png", "c.jpg"]}])).collect()]
    assert names == ["k.png", "k_1.jpg"]


def test_training(spark):
    active = pairs.latest_state(log_rows(spark, [{"pair_id": f"kdpo_{i:06d}", "question_type": "VQA" if i % 3 else "MCQ"} for i in range(30)]))
    assert training.decision(active, 100, 0).first()["reason"] == "count"
    assert training.decision(active, 30, 1, retrain=20, least=15).first()["reason"] == "type"
    assert training.decision(active, 30, 1, retrain=20, least=5).first()["should_train"]
    assert {tuple(r) for r in training.type_shortfall(active, 12, ("MCQ", "Reasoning")).collect()} == {("MCQ", 2), ("Reasoning", 12)}
    loss = spark.createDataFrame([(0.0, 8000.0, 0.0, 0.0, 1), (2.0, 0.0, 0.0, 0.0, 2)], "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double, step int")
    got = training.loss_summary(loss).first()
    assert got["mean_loss"] == pytest.approx((800 + math.log1p(math.exp(-0.2))) / 2) and got["reward_accuracy"] == 0.5
    history = spark.createDataFrame([("a", {"anls": 0.5}), ("b", {"anls": 0.4, "f1": 0.6}), ("c", {}), ("d", None)], "checkpoint string, eval map<string,double>")
    assert tuple(training.best_checkpoint(history).first()) == ("b", 0.5)
    ties = spark.createDataFrame([("a", "tie"), ("a", "TIE")], "checkpoint string, verdict string")
    assert training.comparison_stats(ties).where("checkpoint = 'a'").first()["win_rate"] is None


def test_evaluation(spark):
    papers = spark.createDataFrame([(f"p{i}",) for i in range(10)], "paper_id string")
    split = evaluation.split(papers, 3)
    assert Counter(r["split"] for r in split.collect()) == {"held_out": 3, "collect": 7}
    assert evaluation.split(papers.limit(1), 3).first()["split"] == "collect"
    grown = evaluation.extended_split(split, papers.unionByName(spark.createDataFrame([("new",)], "paper_id string")))
    assert grown.where("paper_id = 'new'").first()["split"] == "collect" and grown.count() == 11
    assert evaluation.overlap(split.where("split = 'held_out'"), split.where("split = 'collect'")).count() == 0
    assert {tuple(r) for r in evaluation.step_paper(papers.limit(3), -1).collect()} == {("p0", "p2"), ("p1", "p0"), ("p2", "p1")}
    nodes = [("Figure", "p", 1, "그림 3 캐시 히트율", None)]
    path = spark.createDataFrame([(0, ["n"], ["HAS_CAPTION"], nodes, "p", 1, "VQA", "그림 3  캐시 히트율", "c", []), (1, ["n"], ["HAS_CAPTION"], nodes, "p", 1, "VQA", "표 3 다른 것", "c", [])], "try int, path array<string>, edge_types array<string>, nodes array<struct<node_type string, paper_id string, page int, content string, image_path string>>, paper_id string, difficulty int, question_type string, gold_answer string, context string, image_paths array<string>")
    got = evaluation.draft_items(path).collect()
    assert [(r["question"], r["ground_truths"]) for r in got] == [("이 그림은 무엇을 나타내는가?", ["캐시 히트율", "그림 3 캐시 히트율"])]
    items = spark.createDataFrame([("q1", "VQA", ["yes"]), ("q2", "MCQ", ["B"])], "question_id string, question_type string, ground_truths array<string>")
    said = spark.createDataFrame([("q2", "Answer: B")], "question_id string, prediction string")
    assert {r["question_id"]: r["accuracy"] for r in evaluation.evaluated(items, said).collect()} == {"q1": 0.0, "q2": 1.0}


def test_files(spark, small, tmp_path):
    nodes, edges = small
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    back, _ = files.read_graph(spark, str(tmp_path / "g"))
    assert back.count() == 8
    files.write_graph_json(nodes, edges, str(tmp_path / "j"))
    a, b = files.read_graph_json(spark, str(tmp_path / "j"))
    assert a.count() == 8 and b.where("confidence = 1.0").count() == 6
    (tmp_path / "d.json").write_text(json.dumps({"nodes": [{"id": "a", "node_type": "Figure", "paper_id": "p", "meta_x": "1"}], "edges": [{"src_id": "a", "dst_id": "zz", "weight": 0.5, "metadata": {"method": "rule"}}]}))
    n, e = files.read_graph_document(spark, str(tmp_path / "d.json"))
    assert n.first()["metadata"] == {"x": "1"} and n.first()["page"] == -1
    assert (e.first()["edge_type"], e.first()["weight"], e.first()["confidence"], e.first()["method"]) == ("CONTAINS", 0.5, 1.0, "rule")
    (tmp_path / "e.jsonl").write_text('{"question_text": "q", "answer": "a", "context_text": "c"}\n{"question_id": "x", "question": "r", "ground_truths": ["b"]}\n')
    got = files.read_eval_items(spark, str(tmp_path / "e.jsonl")).collect()
    assert [(r["question_id"], r["question"], r["ground_truths"], r["context"]) for r in got] == [("q_000000", "q", ["a"], "c"), ("x", "r", ["b"], "")]
    (tmp_path / "a" / "adapter_epoch002").mkdir(parents=True)
    (tmp_path / "a" / "adapter_epoch002" / "adapter_config.json").write_text("{}")
    there = files.adapters(spark, str(tmp_path / "a"))
    assert there.first()["epoch"] == 2 and files.next_adapter(there).first()[0] == "adapter_epoch003"


def test_state(tmp_path):
    counters = state.Counters(tmp_path / "state.json")
    counters.pairs_added(3)
    counters.trained()
    now = counters.snapshot()
    assert (now["total_pairs"], now["pairs_since_last_train"], now["train_count"]) == (3, 0, 1)
    with pytest.raises(FileNotFoundError):
        counters.activate(str(tmp_path / "none"))
    (tmp_path / "state.json").write_text("broken")
    assert counters.snapshot()["total_pairs"] == 0
    assert state.resolved({"a": "${X}", "b": ["${X}"], "c": 1}, {"X": "y"}) == {"a": "y", "b": ["${X}"], "c": 1}
    assert state.merged({"s": {"a": 1, "b": 2}}, {"s": {"b": 3, "a": None}}) == {"s": {"a": 1, "b": 3}}
    assert state.stamp(0) == "1970-01-01T09:00:00+09:00"
    state.restore(tmp_path / "state.json", state.backup(tmp_path / "state.json"))
    assert state.backups(tmp_path / "state.json")


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.parquet(str(tmp_path / "in/e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/e"))
    query = logs.tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {tuple(r) for r in logs.tumbling_counts(events).collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == batch
    rows = stream.select(F.col("user_id").cast("string").alias("pair_id"), F.col("event_id").alias("log_seq"), "event_type")
    logs.latest_state_table(rows, str(tmp_path / "table"), checkpoint=str(tmp_path / "check")).awaitTermination()
    got = logs.read_latest_state(spark, str(tmp_path / "table"), rows.schema)
    assert {(r["pair_id"], r["log_seq"]) for r in got.collect()} == {(str(r[0]), r[1]) for r in events.groupBy("user_id").agg(F.max("event_id")).collect()}
    calls = []
    logs.train_when_due(rows, str(tmp_path / "check2"), 100, calls.append).awaitTermination()
    assert calls and calls[0] >= 100


def test_model_plugin(spark):
    class Echo:
        def load(self):
            self.ready = True

        def infer(self, prompt, images, temperature):
            if prompt == "bad":
                raise RuntimeError("no")
            return prompt.upper()

    prompts = spark.createDataFrame([("1", "hi", ["a"]), ("2", "bad", None)], "id string, prompt string, images array<string>")
    assert {r["id"]: r["response"] for r in enrichment.infer(prompts, "echo", Echo).collect()} == {"1": "HI", "2": ""}
    outputs = spark.createDataFrame([("1", 0, "  "), ("1", 1, "yes"), ("1", 2, "yes "), ("1", 3, "no")], "id string, attempt int, raw string")
    assert [r["text"] for r in pairs.best_generations(outputs, 2, F.trim("raw")).orderBy("attempt").collect()] == ["yes", "no"]


def test_log_order_over_many_appends(spark, tmp_path):
    """The later append wins, whatever its files are named; a tombstone stays."""
    path = str(tmp_path / "log")
    for n in range(10):
        assert files.append_pairs(log_rows(spark, [{"pair_id": f"kdpo_{i:06d}", "question": f"version {n}"} for i in range(n, 12)]).drop("log_seq").repartition(3), path) == n + 1
    log = files.read_pairs(spark, path)
    assert {r["pair_id"]: r["question"] for r in pairs.latest_state(log).collect()} == {f"kdpo_{i:06d}": f"version {min(i, 9)}" for i in range(12)}
    files.append_pairs(pairs.tombstones(log, spark.createDataFrame([("kdpo_000003",)], "pair_id string")), path)
    files.append_pairs(log_rows(spark, [{"pair_id": "kdpo_000004", "question": "b"}, {"pair_id": "kdpo_000004", "question": "a"}]), path)  # rows of one append in their order
    log = files.read_pairs(spark, path)
    active = {r["pair_id"]: r["question"] for r in pairs.latest_state(log).collect()}
    assert "kdpo_000003" not in active and active["kdpo_000004"] == "a" and len(active) == 11
    gone = pairs.pair(log, "kdpo_000003").first()
    assert (gone["status"], gone["question"]) == ("deleted", "version 3")


def test_indices_name_candidates(spark):
    new = log_rows(spark, [
        {"pair_id": None, "question": "x", "candidates": [" one ", "two"], "chosen_idx": 1, "rejected_idx": 0, "chosen": "", "rejected": ""},
        {"pair_id": None, "question": "y", "candidates": ["one", "two"], "chosen_idx": 5, "rejected_idx": 0}, {"pair_id": None, "question": "z"},
    ]).withColumnRenamed("log_seq", "seq")
    got = pairs.added(log_rows(spark, [{"pair_id": "kdpo_000007"}]), new).collect()
    assert sorted((r["pair_id"], r["question"], r["chosen"], r["rejected"]) for r in got) == [("kdpo_000008", "x", "two", "one"), ("kdpo_000009", "z", "a", "b")]


def test_counts_go_on_after_a_restart(spark, tmp_path):
    schema = "pair_id string, log_seq bigint"
    source, calls = tmp_path / "in", []

    def more(n, start):
        spark.createDataFrame([(f"k{(start + i) % 7}", start + i) for i in range(n)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        logs.train_when_due(stream, str(tmp_path / "due"), 25, calls.append).awaitTermination()
        logs.latest_state_table(stream, str(tmp_path / "table"), checkpoint=str(tmp_path / "check"), buckets=4).awaitTermination()

    more(20, 0)
    more(4, 20)
    assert calls == []
    more(3, 24)
    assert calls == [27]
    more(10, 27)
    assert calls == [27]
    got = {r["pair_id"]: r["log_seq"] for r in logs.read_latest_state(spark, str(tmp_path / "table"), StructType.fromDDL(schema)).collect()}
    assert got == {f"k{i}": max(x for x in range(37) if x % 7 == i) for i in range(7)}


def test_places_in_order(spark):
    import random

    from quillgraph.operators.order import numbered

    some = [(f"p{i:03d}",) for i in range(101)]
    random.Random(3).shuffle(some)
    got = numbered(spark.createDataFrame(some, "paper_id string").repartition(7), ["paper_id"]).collect()
    assert sorted((r["place"], r["paper_id"]) for r in got) == list(enumerate(sorted(x for (x,) in some)))


def test_graph_documents_and_accessors(spark, small, tmp_path):
    nodes, edges = small
    full = edges.withColumns({"confidence": F.lit(0.5), "method": F.lit("rule"), "evidence": F.lit("e")})
    path = str(tmp_path / "doc")
    files.write_graph_document(nodes, full, path)
    (part,) = [p for p in (tmp_path / "doc").iterdir() if p.name.startswith("part")]
    document = json.loads(part.read_text())
    assert len(document["nodes"]) == 8 and len(document["edges"]) == 6 and document["nodes"][0]["id"] == "n0"
    a, b = files.read_graph_document(spark, path)
    assert {(r["node_id"], r["content"], r["page"]) for r in a.collect()} == {(r["node_id"], r["content"], r["page"]) for r in nodes.collect()}
    assert {tuple(r) for r in b.select("src_id", "dst_id", "edge_type", "weight", "method").collect()} == {tuple(r) for r in full.select("src_id", "dst_id", "edge_type", "weight", "method").collect()}
    files.write_graph_document(nodes.limit(0), full.limit(0), path)
    assert files.read_graph_document(spark, path)[0].count() == 0
    assert graph.node(nodes, "n3").first()["node_type"] == "Claim" and graph.node(nodes, "zz").count() == 0
    assert graph.of_type(nodes, "Figure", "Table").count() == 4 and graph.of_paper(nodes, "p1").count() == 4
    flat = spark.createDataFrame([({"id": "a", "page": "x", "meta_k": "1", "content": "c"},)], "n map<string,string>")
    assert graph.node_rows(flat).first().asDict() == {"node_id": "a", "node_type": None, "paper_id": None, "page": -1, "content": "c", "image_path": None, "metadata": {"k": "1"}}


def test_recursive_paths_equal_expanded_ones(spark, small):
    nodes, edges = small
    edges = graph.with_endpoints(edges, nodes).dropDuplicates(["src_id", "dst_id"])
    nodes.createOrReplaceTempView("starts")
    edges.createOrReplaceTempView("steps")
    for hops in (1, 2, 3):
        a, b = paths.recursive_paths(spark, "starts", "steps", hops), paths.expand(nodes, edges, hops)
        assert Counter(map(str, a.collect())) == Counter(map(str, b.select("path", "edge_types").collect()))


def test_generated_questions_and_answers(spark, small):
    from quillgraph.operators import generation

    class Talker:
        def load(self):
            self.calls = 0

        def infer_n(self, prompt, images, n, temperature):
            if "content 5" in prompt:
                raise RuntimeError("no")
            if prompt.startswith("ANSWER"):
                return [f"답변: answer {round(temperature, 1)}"] * n  # the same n times: a hotter round has to help
            return ["질문: What is it about?", "짧", "Question: What is it  about?", "1. What else is there?"]

    nodes, edges = small
    walked = spark.createDataFrame([(0, ["n0", "n1"], ["REFERENCES"]), (1, ["n4"], []), (2, ["n5"], [])], "try bigint, path array<string>, edge_types array<string>")
    described = paths.described(walked, nodes)
    prompts = {r["try"]: r["p"] for r in described.select("try", generation.question_prompt("ko").alias("p")).collect()}
    assert "Text:\ncontent 0 words here\n\nTextBlock that the text points to:\ncontent 1 words here\n(A picture comes with this.)" in prompts[0]
    assert "Figure:\n" in prompts[1] and "question in 한국어" in prompts[0] and "{" not in "".join(prompts.values())
    got = generation.questions(described, "talker", Talker, n=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["attempt"]):
        by.setdefault(r["try"], []).append((r["question"], r["question_source"]))
    assert by[0] == by[1] == [("What is it about?", "auto"), ("What else is there?", "auto")]
    assert by[2] == [("이 본문은 무엇을 보여주는지 설명해 주세요.", "fallback")]
    asked = spark.createDataFrame([("a", "q {language}", ["i"]), ("b", "content 5", None)], "id string, question string, images array<string>")
    said = {r["id"]: r for r in generation.answers(asked, "talker", Talker, n=3, template="ANSWER {question}").collect()}
    assert said["a"]["candidates"] == ["answer 0.9", "answer 1.1", "answer 1.4"] and said["a"]["is_usable"]
    assert said["b"]["candidates"] == [] and not said["b"]["is_usable"]


def test_each_output_of_a_model_is_cleaned_once(spark):
    from quillgraph.operators import generation

    class Counter:
        def load(self):
            pass

        def infer_n(self, prompt, images, n, temperature):
            return [f"{prompt} one", f"{prompt}  one"]  # never two, so every round asks again

    cleaned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(raw):
        cleaned.add(1)
        return raw.strip()

    prompts = spark.createDataFrame([("a", "p", []), ("b", "q", [])], "id string, prompt string, images array<string>")
    got = generation.sampled(prompts, "counter", Counter, 2, (0.5, 0.8, 0.8), clean).collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, "p one"), ("b", 0, "q one")]
    assert cleaned.value == 2 * 2 * 3


def test_enriched_corpus(spark, root):
    rows = layout.elements(layout.layouts(spark, root))
    said = corpus.Responses(
        spark.createDataFrame([("p1__fig_1", "a curve")], "node_id string, response string"),
        spark.createDataFrame([("p1__text_1", "p1__fig_1", "It QUANTIFIES this", 1)], "text_id string, visual_id string, response string, seq bigint"),
        spark.createDataFrame([("p1", "p1__text_1", 1, 3, "- a concept here\n- another concept")], "paper_id string, node_id string, page int, seq bigint, response string"),
    )
    nodes, edges = corpus.build(rows, responses=said)
    by = {r["node_id"]: r for r in nodes.collect()}
    assert by["p1__fig_1"]["content"] == "Fig. 1 a caption\n[VLM]: a curve" and by["p1__concept_2"]["content"] == "another concept"
    got = {(r["src_id"], r["dst_id"], r["edge_type"], r["method"]) for r in edges.collect()}
    assert ("p1__text_1", "p1__fig_1", "QUANTIFIES", "vlm_relation") in got and ("p1__text_1", "p1__concept_1", "DEFINES", "vlm_extraction") in got


def test_states_and_items(spark, small, tmp_path):
    nodes, _ = small
    counters = state.Counters(tmp_path / "state.json")
    counters.pairs_added(4)
    counters.record_training(tmp_path / "history.json", {"checkpoint": "adapter_epoch001", "eval": {"anls": 0.5}})
    counters.record_training(tmp_path / "history.json", {"checkpoint": "adapter_epoch002"})
    assert counters.snapshot()["train_count"] == 2 and counters.snapshot()["pairs_since_last_train"] == 0
    history = files.read_history(spark, str(tmp_path / "history.json"))
    assert [r["checkpoint"] for r in history.orderBy("seq").collect()] == ["adapter_epoch001", "adapter_epoch002"]
    assert tuple(training.best_checkpoint(history).first()) == ("adapter_epoch001", 0.5)
    path = str(tmp_path / "comparisons")
    for verdict in ("trained", "BASE", "tie"):
        files.append_comparison(spark.createDataFrame([("adapter_epoch001", verdict)], "checkpoint string, verdict string"), path)
    got = files.read_comparisons(spark, path)
    assert got.where("created_at is null").count() == 0 and training.comparison_stats(got).where("checkpoint is null").first()["win_rate"] == 0.5
    split = evaluation.split(nodes.select("paper_id").distinct(), 1)
    files.write_split(split, str(tmp_path / "split"))
    assert {tuple(r) for r in files.read_split(spark, str(tmp_path / "split")).collect()} == {tuple(r) for r in split.collect()}
    items = evaluation.from_graph(nodes, 3).collect()
    assert [r["question_id"] for r in items] == ["kg_000001", "kg_000002", "kg_000003"]
    assert {r["question"] for r in items} <= {"What does this figure show or describe?", "What does this table show or describe?"}
    assert all(r["context"].startswith(r["ground_truths"][0]) and r["paper_id"] for r in items)
    typed = spark.createDataFrame([("q", "VQA", 1), ("r", "MCQ", 2)], "question_id string, question_type string, difficulty int")
    assert evaluation.of_type(typed, "MCQ").first()["question_id"] == "r" and evaluation.of_difficulty(typed, 1).count() == 1
    ranked = training.with_adapters(spark.createDataFrame([("a",), ("b",)], "checkpoint string"), spark.createDataFrame([("a",)], "name string"))
    assert {tuple(r) for r in ranked.collect()} == {("a", True), ("b", False)}


def test_model_vectors_and_probabilities(spark, small):
    class Model:
        def load(self):
            pass

        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

        def logprob(self, prompt, images, answer):
            return -float(len(answer))

    nodes, _ = small
    got = enrichment.embed(nodes, "vectors", Model)
    assert {r["node_id"]: r["embedding"][0] for r in got.collect()} == {r["node_id"]: float(len(r["content"])) for r in nodes.collect()}
    rows = log_rows(spark, [{"pair_id": "a", "chosen": "xx", "rejected": "yyy"}])
    four = enrichment.log_probabilities(rows, ("policy", Model), ("reference", Model)).first()
    assert four.asDict() == {"pair_id": "a", "policy_chosen": -2.0, "policy_rejected": -3.0, "ref_chosen": -2.0, "ref_rejected": -3.0}
    enrichment.unload()


def test_stores_and_parsers(spark, small, root, tmp_path):
    nodes, edges = small
    full = edges.withColumns({"confidence": F.lit(1.0), "method": F.lit("rule"), "evidence": F.lit("e")})
    for name in files.STORES:
        path = str(tmp_path / name)
        files.save_graph(name, nodes, full, path)
        a, b = files.load_graph(spark, name, path)
        assert a.count() == 8 and b.count() == 6
        files.clear_graph(name, nodes, full, path)
        assert files.load_graph(spark, name, path)[0].count() == 0
    with pytest.raises(ValueError):
        files.save_graph("other", nodes, full, "x")
    assert layout.parsed(spark, root).count() == layout.elements(layout.layouts(spark, root)).count()
    with pytest.raises(ValueError):
        layout.parsed(spark, root, "other")


def test_contents_of_paths_are_cleaned_once(spark, small):
    from quillgraph.operators import paths

    nodes, _ = small
    walked = spark.createDataFrame([(0, ["n0", "n1"], ["SAME_CONCEPT"])], "try bigint, path array<string>, edge_types array<string>")
    plan = paths.described(walked, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</t[dh]>") == 1


def test_graph_documents_are_written_and_read_in_parts(spark, tmp_path):
    import json
    from pathlib import Path

    path = str(tmp_path / "document")
    nodes = spark.range(200).select(F.format_string("n%03d", "id").alias("node_id"), F.lit("Text]}").alias("node_type"), F.lit('a "b}\n ,{').alias("content"), F.col("id").alias("seq"))
    edges = spark.range(199).select(F.format_string("n%03d", "id").alias("src_id"), F.format_string("n%03d", F.col("id") + 1).alias("dst_id"), F.lit("NEXT").alias("edge_type"), (F.col("id") / 4).alias("weight"), F.lit(1.0).alias("confidence"), F.lit("rule").alias("method"), F.lit(None).cast("string").alias("evidence"), F.col("id").alias("seq"))
    files.write_graph_document(nodes, edges, path, file_rows=50)
    written = [p.read_text() for p in sorted(Path(path).glob("part-*"))]
    assert sum("node_type" in x or "src_id" in x for x in written) > 1  # several tasks have written rows
    whole = json.loads("".join(written))
    assert [n["id"] for n in whole["nodes"]] == [f"n{i:03d}" for i in range(200)] and len(whole["edges"]) == 199
    n, e = files.read_graph_document(spark, path)
    assert [tuple(r) for r in n.orderBy("seq").select("seq", "node_id", "node_type", "content").collect()] == [(i, f"n{i:03d}", "Text]}", 'a "b}\n ,{') for i in range(200)]
    assert [tuple(r) for r in e.orderBy("seq").select("seq", "src_id", "weight", "method", "evidence").collect()] == [(i, f"n{i:03d}", i / 4, "rule", None) for i in range(199)]
