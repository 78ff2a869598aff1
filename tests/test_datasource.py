"""Layouts by the data source: both forms of folders, pruning, and streams that open each paper once."""

import json
import shutil

from pyspark.sql import functions as F

from quillgraph.sources import datasource, layout
from quillgraph.streaming import logs


def paper(root, name, *texts):
    (root / name).mkdir(parents=True)
    (root / name / datasource.FILE).write_text(json.dumps({"total_pages": 1, "pages": [{"page_number": 1, "text_elements": [{"text": t} for t in texts]}]}), encoding="utf-8")


def contents(df):
    return sorted((r["paper_id"], r["content"]) for r in layout.elements(df).collect())


def test_both_forms_of_a_folder(spark, tmp_path):
    root = tmp_path / "papers (a+b)"
    paper(root, "p1", "one", "그림 1")
    paper(root, "p2", "two")
    (root / "empty").mkdir()
    page = [{"text_elements": [{"text": "three"}]}]
    lines = [json.dumps({"paper_id": "p3", "pages": page}), "", "{broken", "[1]", json.dumps({"pages": page}), json.dumps({"paper_id": "p4", "pages": page})]
    (root / "many.jsonl").write_text("\n".join(lines))
    want = [("p1", "one"), ("p1", "그림 1"), ("p2", "two"), ("p3", "three"), ("p4", "three")]
    for options in ({}, {"partition_bytes": 1}):
        assert contents(layout.source(spark, str(root), **options)) == want
    assert contents(layout.layouts(spark, str(root))) == want[:3]
    some = layout.source(spark, str(root)).where(F.col("paper_id").isin("p1", "p4"))
    assert contents(some) == [*want[:2], want[4]]
    shutil.rmtree(root / "p2")
    assert contents(layout.source(spark, f"file://{root}").where("paper_id = 'p1'")) == want[:2]
    assert contents(layout.source(spark, str(tmp_path / "none"))) == []


def test_a_condition_prunes_the_listing(tmp_path):
    for i in range(4):
        paper(tmp_path, f"p{i}", "x")
    reader = datasource.LayoutReader({"path": str(tmp_path), "partition_bytes": "1"})
    assert len(reader.partitions()) == 4
    left = list(reader.pushFilters([datasource.EqualTo(("paper_id",), "p2"), datasource.EqualTo(("value",), "x")]))
    assert len(left) == 1 and [p.files[0][1] for p in reader.partitions()] == ["p2"]


def test_a_stream_opens_each_paper_once(spark, tmp_path):
    root, seen = tmp_path / "papers", []

    def run():
        stream = layout.source_stream(spark, str(root), str(tmp_path / "listing"))
        logs.in_batches(stream, lambda batch, n: seen.append(contents(batch)), str(tmp_path / "check")).awaitTermination()

    paper(root, "p1", "one")
    paper(root, "p2", "two")
    run()
    (root / "p1" / datasource.FILE).write_text("changed: it would break")  # it is not opened again
    paper(root, "p3", "three")
    run()
    run()
    assert [x for x in seen if x] == [[("p1", "one"), ("p2", "two")], [("p3", "three")]]


def test_images_of_a_folder_with_a_pattern_in_its_name(spark, tmp_path):
    root = tmp_path / "x (a+b).y"
    (root / "p1" / "images").mkdir(parents=True)
    (root / "p1" / "images" / "i 1.png").write_bytes(b"x")
    rows = spark.createDataFrame([("p1", "other/i 1.png"), ("p1", "none.png"), ("p1", None)], "paper_id string, image_path string")
    assert sorted(map(repr, (r["image_path"] for r in layout.with_images(rows, spark, str(root)).collect()))) == ["'p1/images/i 1.png'", "None", "None"]


def test_long_layouts_are_handed_on_a_few_at_a_time(tmp_path):
    with open(tmp_path / "many.jsonl", "w") as out:
        for i in range(60):
            out.write(json.dumps({"paper_id": f"p{i}", "pages": "x" * 300_000}) + "\n")
    reader = datasource.LayoutReader({"path": str(tmp_path)})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert max(b.nbytes for b in batches) < 2 * datasource.BATCH_BYTES
    assert [x for b in batches for x in b.column("paper_id").to_pylist()] == [f"p{i}" for i in range(60)]
