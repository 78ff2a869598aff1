"""A collection from its configuration to an export, with plug-ins in place of models."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from quillgraph.plans.collection import Collection

from .test_operators import root  # noqa: F401  the small corpus


class Talker:
    def load(self):
        pass

    def infer(self, prompt, images, temperature):
        return f"said  {prompt}" if temperature else f"said {prompt}"

    def infer_n(self, prompt, images, n, temperature):
        return ["What is shown here in detail?"] if prompt.endswith("Question:") and n <= 1 else [f"answer number {i} to it" for i in range(n)]


@pytest.fixture
def opened(spark, root, tmp_path):  # noqa: F811
    path = tmp_path / "config.json"
    own = {"data_root": root, "pairs": str(tmp_path / "pairs"), "state": str(tmp_path / "state.json"), "graph": str(tmp_path / "graph")}
    path.write_text(json.dumps({"paths": own, "model": {"name": "some-hf"}, "train": {"first_train_min_pairs": 2, "min_pairs_per_type": 0}, "language": "ko"}))
    return Collection.open(spark, str(path), models={"base": Talker, "tuned": Talker}), str(path)


def test_configuration_with_errors_is_refused(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text("{}")
    with pytest.raises(ValueError, match="paths.data_root is missing"):
        Collection.open(spark, str(path))


def test_a_collection_from_graph_to_export(spark, opened, root, tmp_path):  # noqa: F811
    c, path = opened
    assert {r["paper_id"] for r in c.languages().collect()} == {"p1", "p2"} and c.languages().count() == 2
    held = [r["paper_id"] for r in c.split().where("split = 'held_out'").collect()]
    assert len(held) == 1 and [r["paper_id"] for r in c.split().where("split = 'held_out'").collect()] == held
    mine = ({"p1", "p2"} - set(held)).pop()
    assert c.next_paper(mine) == mine and c.next_paper(held[0]) is None
    assert {r["paper_id"] for r in c.graph()[0].select("paper_id").distinct().collect()} == {"p1", "p2"}
    asked = c.questions("base", 3, n=1).cache()
    assert {r["paper_id"] for r in asked.collect()} == {mine}
    said = c.answers("base", asked, 3)
    assert all(r["is_usable"] and len(r["candidates"]) == 3 for r in said.collect())
    judged = said.withColumns({"chosen_idx": F.lit(0), "rejected_idx": F.lit(1)})
    n = c.save(judged)
    assert n == judged.select("question").distinct().count() and c.save(judged) == 0
    assert c.save(spark.createDataFrame([("q", "a", "b", "VQA"), ("q", "a", "a", "VQA"), ("r", "a", "b", "none")], "question string, chosen string, rejected string, question_type string")) == 1
    assert c.active().count() == n + 1 == c.counters.snapshot()["total_pairs"]
    last = c.active().where("question = 'q'").select("pair_id")
    assert c.delete(last, "test") == 1 and c.delete(last) == 0 and c.active().count() == n == c.counters.snapshot()["total_pairs"]
    c.save(spark.createDataFrame([(f"q{i}", "a", "b", "VQA", ["p1/images/a.png", "p1/none.png"]) for i in range(3)], "question string, chosen string, rejected string, question_type string, image_paths array<string>"))

    decision = c.decision().first()
    assert decision["should_train"] and "학습 조건 충족" in decision["markdown"]
    (tmp_path / "adapter_epoch001").mkdir()
    steps = []

    def trainer(valid, options, on_step):
        on_step(1, 0.5)
        return {"checkpoint": "adapter_epoch001", "loss": 0.5, "adapter": str(tmp_path / "adapter_epoch001")}

    items = spark.createDataFrame([("e1", "one", "VQA", ["said one"], [], "", "p", 1), ("e2", "", "VQA", ["x"], [], "", "p", 1)], "question_id string, question string, question_type string, ground_truths array<string>, image_paths array<string>, context string, paper_id string, difficulty int")
    record = c.train(trainer, lambda record: c.evaluated("tuned", items), lambda step, loss: steps.append((step, loss)))
    assert record["eval"] == {"anls": 1.0, "accuracy": 1.0, "f1": 1.0} and steps == [(1, 0.5)] and record["n_train_pairs"] == n + 3
    assert c.train(trainer) is None and c.counters.snapshot()["active_adapter"].endswith("adapter_epoch001")

    def fails(record):
        raise RuntimeError("no items")

    assert "no items" in c.train(trainer, fails, force=True)["notes"] and len(c.history()) == 2

    prompts = spark.createDataFrame([("1", "hello", None)], "id string, prompt string, images array<string>")
    assert c.compared(prompts, "base", "tuned").first()["identical"]
    assert c.comparisons().where("checkpoint is not null").count() == 0
    c.judge(spark.createDataFrame([("adapter_epoch001", "trained")], "checkpoint string, verdict string"))
    assert c.comparisons().where("checkpoint is null").first()["win_rate"] == 1.0

    later = tmp_path / "more"
    shutil.copytree(root, later)
    shutil.copytree(later / "p1", later / "p3")
    c.config["paths"]["data_root"] = str(later)
    assert {r["paper_id"]: r["split"] for r in c.split().collect()} == {held[0]: "held_out", mine: "collect", "p3": "collect"}
    assert sorted(r["paper_id"] for r in c.languages().collect()) == ["p1", "p2", "p3"]
    assert {c.next_paper(mine), c.next_paper("p3")} == {mine, "p3"}
    c.config["paths"]["data_root"] = root

    out = c.export("rlaif_v")
    assert spark.read.json(f"{out}/data").count() == n + 3 and c.preview(2).count() == 2
    told = spark.read.parquet(f"{out}/copied")
    one = told.where("copied and path = 'p1/images/a.png'").select("name").first()["name"]
    with open(f"{out}/images/{one}", "rb") as copy, open(f"{root}/p1/images/a.png", "rb") as first:
        assert copy.read() == first.read()
    assert told.where("path = 'p1/none.png' and not copied").count() == 3

    assert not c.change(path, {"train": {"epochs": 0}}).ok and c.change(path, {"train": {"epochs": 2}}).ok
    assert c.section("train")["epochs"] == 2
