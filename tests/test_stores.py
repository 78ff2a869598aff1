"""Versions of logs and tables under several writers and lost ones, keyed state over restarts, and staged tables by owner."""

import random
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.operators import pairs
from quillgraph.sources import commits, files, scratch
from quillgraph.streaming import logs, states

PAIR = "pair_id string, question string, chosen string, rejected string, status string"


def said(spark, verdicts):
    return spark.createDataFrame([("a", v) for v in verdicts], "checkpoint string, verdict string")


def test_of_two_writers_of_a_version_one_has_to_try_again(spark, tmp_path):
    log = commits.Versions(spark, str(tmp_path / "log"))
    base = log.snapshot()
    assert base == commits.Snapshot()
    log.publish(base, {"a": "a"}, notes={"x": 1})
    with pytest.raises(commits.Conflict):
        log.publish(base, {"b": "b"})
    assert log.snapshot().live == {"a": "a"}
    ready, won = threading.Barrier(4), []

    def write(name):
        other = commits.Versions(spark, str(tmp_path / "log"))
        now = other.snapshot()
        ready.wait()
        try:
            won.append(other.publish(now, {name: name}).version)
        except commits.Conflict:
            won.append(None)

    with ThreadPoolExecutor(4) as threads:
        list(threads.map(write, "cdef"))
    assert sorted(x is None for x in won) == [False, True, True, True] and log.snapshot().version == 2


def test_appends_at_once_are_commits_in_one_order(spark, tmp_path):
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(4) as threads:
        numbers = list(threads.map(lambda n: files.append(said(spark, [f"v{n}"] * 20), path), range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    rows = files.comparison_places(spark, path).groupBy("place.commit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("verdict").alias("v")).collect()
    assert sorted((r["commit"], r["n"], r["v"]) for r in rows) == [(i, 20, 1) for i in range(1, 7)]


def test_a_writer_that_is_lost_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    files.append(said(spark, ["one"]), path)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits.Versions, "_create", lost)
        with pytest.raises(KeyboardInterrupt):
            files.append(said(spark, ["two"]), path)
    assert [r["verdict"] for r in files.read_comparisons(spark, path).collect()] == ["one"]
    assert files.append(said(spark, ["three"]), path) == 2
    assert sorted(r["verdict"] for r in files.read_comparisons(spark, path).collect()) == ["one", "three"]
    assert commits.Versions(spark, path).sweep(hours=-1) == 1  # the lost writer's folder
    assert files.read_comparisons(spark, path).count() == 2


def test_snapshots_of_many_versions(spark, tmp_path):
    log = commits.Versions(spark, str(tmp_path / "log"))
    for i in range(2 * commits.WHOLE + 3):
        log.change(lambda base, i=i: {"put": {f"k{i % 5}": f"f{i}"}, "drop": ["k0"] if i % 5 == 1 else [], "notes": {"last": i}})
    now, then = log.snapshot(), log.snapshot(commits.WHOLE + 1)
    assert now.version == 2 * commits.WHOLE + 3 and now.notes == {"last": 2 * commits.WHOLE + 2}
    assert then.version == commits.WHOLE + 1 and then.notes == {"last": commits.WHOLE}
    for at in (now, then):
        want = {}
        for i in range(at.version):
            want = {k: v for k, v in want.items() if not (i % 5 == 1 and k == "k0")} | {f"k{i % 5}": f"f{i}"}
        assert at.live == want
    assert log.change(lambda base: None) == now
    with pytest.raises(ValueError):
        log.snapshot(10_000)


def test_loose_files_come_before_commits_and_earlier_versions_can_be_read(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "old.jsonl").write_text('{"pair_id": "kdpo_000001", "question": "old", "chosen": "a", "rejected": "b"}\n{"pair_id": "kdpo_000002", "question": "kept", "chosen": "a", "rejected": "b"}\n')
    for n in range(2):
        files.append_pairs(spark.createDataFrame([("kdpo_000001", f"new {n}", "a", "b", "active")], PAIR), str(path))
    latest = lambda version=None: {r["question"] for r in pairs.latest_state(files.read_pairs(spark, str(path), version)).collect()}
    assert latest() == {"new 1", "kept"} and latest(1) == {"new 0", "kept"} and latest(0) == {"old", "kept"}


def test_sessions_that_add_at_once_number_on(spark, tmp_path):
    path = str(tmp_path / "pairs")
    blank = files.read_pairs(spark, path).drop("log_seq", "lang", "question_type", *[c.split()[0] for c in PAIR.split(", ")]).schema

    def session(part):
        own = spark.createDataFrame([(f"question {i}", "one", "two", i) for i in range(part, part + 6)], "question string, chosen string, rejected string, seq long")
        own = own.withColumns({"pair_id": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "lang": F.lit("en"), "question_type": F.lit("VQA")} | {f.name: F.lit(None).cast(f.dataType) for f in blank})
        return files.change_pairs(spark, path, lambda log: pairs.added(log, own, "en"))

    with ThreadPoolExecutor(3) as threads:
        added = list(threads.map(session, (0, 2, 4)))
    rows = files.read_pairs(spark, path).collect()
    assert sum(added) == len(rows) == 10 and {r["question"] for r in rows} == {f"question {i}" for i in range(10)}
    assert sorted(r["pair_id"] for r in rows) == [f"kdpo_{i:06d}" for i in range(1, 11)]
    assert session(0) == 0 and files.read_pairs(spark, path).count() == 10


def test_a_batch_that_is_lost_or_run_again_keeps_the_table(spark, tmp_path, monkeypatch):
    schema, table, source = "pair_id string, log_seq bigint", str(tmp_path / "table"), str(tmp_path / "in")
    read = lambda: {r["pair_id"]: r["log_seq"] for r in logs.read_latest_state(spark, table, StructType.fromDDL(schema)).collect()}

    def run(rows, checkpoint="check"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        logs.latest_state_table(spark.readStream.schema(schema).parquet(source), table, checkpoint=str(tmp_path / checkpoint), buckets=2).awaitTermination()

    run([(f"k{i}", i) for i in range(10)])
    before = read()
    with monkeypatch.context() as m:
        m.setattr(commits.Versions, "publish", lambda *_, **__: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision|division"):
            run([("k1", 50), ("k2", 51)])
    assert read() == before == {f"k{i}": i for i in range(10)}
    run([("k3", 40)])
    assert read() == before | {"k1": 50, "k2": 51, "k3": 40}
    run([("k0", 7)], checkpoint="other")  # a stream of its own sees all files anew, older rows change nothing
    assert read() == before | {"k0": 7, "k1": 50, "k2": 51, "k3": 40}


def test_keyed_state_goes_on_after_a_restart_and_forgets_deleted_keys(spark, tmp_path):
    schema, source, check = "pair_id string, log_seq bigint, status string, at timestamp", str(tmp_path / "in"), str(tmp_path / "check")
    seen, day = [], lambda hour: datetime(2024, 1, 1, hour)

    def run(rows, hour, where=check, **options):
        spark.createDataFrame([(*r, day(hour)) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        with states.state_store(spark):
            stream = spark.readStream.schema(schema).parquet(source)
            changes = states.row_changes(stream, deleted=F.col("status") == "deleted", **options)
            logs.in_batches(changes, lambda batch, n: seen.extend(tuple(r) for r in batch.drop("at").collect()), where, "update").awaitTermination()

    stored = lambda where: {r["pair_id"]: (r["log_seq"], r["status"]) for r in states.stored_states(spark, where, StructType.fromDDL(schema)).collect()}
    provider = spark.conf.get(states._PROVIDER)
    run([("a", 1, "active"), ("a", 3, "active"), ("a", 2, None), ("b", 4, "active"), (None, 5, "active"), ("c", None, "active")], 1)
    assert sorted(seen) == [("a", 3, "active", True, False), ("b", 4, "active", True, False)]
    seen.clear()
    run([("a", 2, "deleted"), ("b", 6, "deleted"), ("d", 7, None)], 2)
    assert sorted(seen, key=repr) == [("b", 6, "deleted", False, True), ("d", 7, None, True, False)]
    assert stored(check) == {"a": (3, "active"), "b": (6, "deleted"), "d": (7, None)}
    assert spark.conf.get(states._PROVIDER) == provider
    timed, options = str(tmp_path / "timed"), {"at": "at", "late": "1 hour", "forget_ms": 3_600_000}
    run([("e", 8, "active")], 3, timed, **options)
    assert "b" in stored(timed)
    run([("f", 9, "active")], 9, timed, **options)  # the watermark is far past the deletion of b now
    assert set(stored(timed)) == {"a", "d", "e", "f"}


def test_rows_of_a_pair_are_reduced_before_they_reach_the_state(spark, tmp_path, monkeypatch):
    schema, source, seen = "pair_id string, log_seq bigint, at timestamp", str(tmp_path / "in"), str(tmp_path / "seen")

    class Watched(states.LatestRow):
        def handleInputRows(self, key, rows, timerValues):
            def told():
                for row in rows:
                    with open(seen, "a") as f:
                        f.write(f"{key[0]} {int(row['place'])}\n")
                    yield row

            return super().handleInputRows(key, told(), timerValues)

    monkeypatch.setattr(states, "LatestRow", Watched)
    spark.createDataFrame([(f"k{i % 3}", i, datetime(2024, 1, 1)) for i in range(600)], schema).coalesce(1).write.parquet(source)
    for options, most in ({}, {"k0 597", "k1 598", "k2 599"}), ({"at": "at"}, {f"k{i % 3} {i}" for i in range(600)}):  # with a time all rows go on
        open(seen, "w").close()
        with states.state_store(spark):
            stream = spark.readStream.schema(schema).parquet(source)
            logs.in_batches(states.row_changes(stream, **options), lambda batch, n: batch.collect(), f"{tmp_path}/check{len(most)}", "update").awaitTermination()
        assert set(open(seen).read().split("\n")[:-1]) == most


def test_reduced_rows_hold_the_last_of_each_key_within_a_bound(monkeypatch):
    rng, kept = random.Random(3), {}
    rows = [{"key": f"k{rng.randint(0, keys)}", "place": rng.randint(0, 9_999), "payload": str(i)} for keys in (5, 400) for i in range(3_000)]
    for bound in (1 << 20, 4_000, 1):
        monkeypatch.setattr(states, "HELD_BYTES", bound)
        whole = pa.Table.from_pylist(rows)
        batches = [whole.slice(0, 0).combine_chunks(), *[whole.slice(i, 500) for i in range(0, len(rows), 500)]]
        got = [r for b in states.last_rows(b for t in batches for b in (t.to_batches() or [pa.RecordBatch.from_pylist([], t.schema)])) for r in b.to_pylist()]
        best = lambda some: {k: max(r["place"] for r in some if r["key"] == k) for k in {r["key"] for r in some}}
        assert best(got) == best(rows) and {tuple(r.values()) for r in got} <= {tuple(r.values()) for r in rows}
        kept[bound] = len(got)
    assert kept[1 << 20] == len({r["key"] for r in rows}) <= kept[4_000] <= kept[1] < len(rows)
    assert list(states.last_rows(iter([]))) == []


def test_runs_own_what_they_stage(spark):
    one = spark.range(5).toDF("x")
    with scratch.owned(spark, release=True) as outer:
        with scratch.owned(spark) as inner:
            kept, lost = scratch.staged(one, "kept"), scratch.staged(one, "lost")
            loose = scratch.shared_path(spark, "loose")
            one.write.parquet(loose)
            assert inner.release(keep=kept, tables_only=True) == 1
            assert kept.count() == 5 and spark.read.parquet(loose).count() == 5
            with pytest.raises(Exception, match="exist|FILE"):
                lost.count()
            assert inner.release(keep=kept) == 1
        other = []
        worker = threading.Thread(target=lambda: other.append(scratch.staged(one, "other")))
        worker.start()
        worker.join()
        assert len(outer.paths) == 1
    assert other[0].count() == 5
    with pytest.raises(Exception, match="exist|FILE"):
        spark.read.parquet(kept.inputFiles()[0]).count() if kept.inputFiles() else kept.count()
