"""Configuration, SQL functions, evaluation sets, and the registered queries."""

import shutil

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import metrics, sql
from quillgraph.operators import evaluation
from quillgraph.plans import catalogue, evaluation_set
from quillgraph.sources import config


def test_configuration(tmp_path):
    path = str(tmp_path / "c.json")
    good = {"paths": {"data_root": str(tmp_path), "pairs": str(tmp_path / "no/p.jsonl")}, "model": {"name": "m"}, "train": {"epochs": 1, "learning_rate": 0.5}}
    first = config.save(path, good)
    assert first.ok and len(first.warnings) == 2
    bad = config.save(path, {"train": {"epochs": 0, "dpo_beta": 2}, "export": {"format": "x"}, "eval": {"metrics": ["anls", "odd"]}})
    assert len(bad.errors) == 4
    assert config.load(path)["train"]["epochs"] == 1
    assert not config.checked([]).ok and len(config.checked({}).errors) == 3
    assert config.model_family({"architectures": ["InternVLChatModel"]}, "x") == "internvl"
    assert config.model_family(None, "org/InternVL3-hf") == "hf"
    with pytest.raises(ValueError):
        config.model_family(None, "thing")


def test_yaml_configuration_keeps_comments(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# top\npaths:\n  data_root: /old  # where papers are\n  pairs: ${NOT_SET}\n\n# the model\nmodel:\n  name: m\n  list:\n    - a\n    - b\ntrain:\n  epochs: 1\n")
    result = config.save(str(path), {"paths": {"data_root": str(tmp_path)}, "model": {"name": "n: x", "list": ["c"]}, "train": {"learning_rate": 0.5}, "export": {"format": "rlaif_v"}})
    assert result.ok, result.errors
    text = path.read_text()
    assert "# top" in text and "# where papers are" in text and "# the model" in text
    got = config.load(str(path))
    assert got["paths"] == {"data_root": str(tmp_path), "pairs": "${NOT_SET}"} and got["model"] == {"name": "n: x", "list": ["c"]}
    assert got["train"] == {"epochs": 1, "learning_rate": 0.5} and got["export"] == {"format": "rlaif_v"}
    before = path.read_text()
    assert not config.save(str(path), {"train": {"epochs": 0}}).ok and path.read_text() == before


def test_sql_functions(spark):
    sql.register(spark)
    rows = [(" Kitten", ["sitting", None]), ("a.b!", ["ab", "x"]), ("", []), ("it's \\ {x}", ["its  x"]), ("a b a", ["a a a c"]), ("The answer: (c)", ["c"])]
    spark.createDataFrame(rows, "p string, g array<string>").createOrReplaceTempView("said")
    got = spark.sql("SELECT anls(p, g) AS a, exact_match(p, g) AS e, token_f1(p, g), mcq_letter(p) FROM said").collect()
    p, g = F.col("p"), F.col("g")
    expected = spark.table("said").select(metrics.anls(p, g), metrics.exact_match(p, g), metrics.token_f1(p, g), metrics.mcq_letter(p)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in expected]


def test_evaluation_set(spark, sf, tmp_path):
    nodes, edges = catalogue.structural(spark, sf)
    papers = nodes.select("paper_id").distinct()
    split = evaluation.split(papers, 15)
    items = evaluation_set.draft(nodes, edges, split, n=6, require_hangul=False).cache()
    got = items.collect()
    held = {r["paper_id"] for r in split.where("split = 'held_out'").collect()}
    assert got and {r["paper_id"] for r in got} <= held
    assert [r["question_id"] for r in got] == [f"eko_{i:06d}" for i in range(len(got))]
    path = str(tmp_path / "set")
    before = evaluation_set.confirm(items, items.select("question_id").limit(3), split, path).cache()
    before.count()
    assert evaluation_set.unchanged(spark, path, before) == "ok"
    with pytest.raises(ValueError):
        evaluation_set.confirm(items, spark.createDataFrame([("none",)], "question_id string"), split, path)
    shutil.rmtree(path)
    assert evaluation_set.unchanged(spark, path, before) == "missing"


def test_entry(spark):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(catalogue.QUERIES) >= 50
    assert entry.entry(spark).count() > 0


SMALL = ["graph_reference_edges", "semantic_topk_edges", "html_clean_text", "metric_all", "pairs_stats", "trigger_decision", "dpo_loss", "split_held_out"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = db.sql(catalogue.ORACLE_SQL[name])
    names = sorted(expected.columns)
    got = catalogue.QUERIES[name](spark, sf).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.select(*[f'"{n}"' for n in names]).fetchall()))


def _equal_to_sql(spark, name, folder, tables):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    expected = db.sql(oracle_sql()[name])
    names = sorted(expected.columns)
    got = queries()[name](spark, str(folder)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.select(*[f'"{n}"' for n in names]).fetchall()))


def test_draft_items_of_texts_without_letters(spark, tmp_path):
    texts = ["", None, "123", "Table", "a", "The abc words", "그림 text", " fig word"]
    rows = [(12 * k + i, t, "en", "s", len(t or "")) for k, t in enumerate(texts) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    _equal_to_sql(spark, "draft_items", tmp_path, ["documents"])


def test_near_ties_of_similarity_rank_as_in_sql(spark, tmp_path):
    """Vectors of the same components in other orders are equally near to a constant one, but for the rounding of sums."""
    import random

    rng = random.Random(4)
    base = [rng.random() for _ in range(64)]
    rows = [(0, [1.0] * 64, 1)] + [(i, rng.sample(base, 64), 1) for i in range(1, 200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    _equal_to_sql(spark, "semantic_topk_edges", tmp_path, ["embeddings"])


def test_vectors_without_a_label_have_no_similar_ones(spark, tmp_path):
    rows = [(i, [1.0, float(i % 5), 2.0], None if i % 3 == 0 else i % 2) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    _equal_to_sql(spark, "semantic_topk_edges", tmp_path, ["embeddings"])
