"""Running sums and carried values by ranges, and draws of starts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import order, paths, similarity, structure


@pytest.mark.parametrize("kind", ["one group", "many groups", "a hot group", "nulls"])
def test_scans_are_running_sums_and_last_values(spark, kind):
    rng = random.Random(3)
    group = {"one group": lambda i: "g", "many groups": lambda i: f"g{i % 40}", "a hot group": lambda i: "hot" if i % 4 else f"g{i % 9}", "nulls": lambda i: None if i % 2 else "g"}[kind]
    rows = [(group(i), i, rng.randint(-5, 5) if i % 3 else None, f"v{i}" if rng.random() < 0.1 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, x int, v string").repartition(5)
    got = order.scanned(df, ["g"], ["i"], {"so_far": F.col("x"), "n": F.lit(1)}, {"last": F.col("v")})
    assert got.columns == ["g", "i", "x", "v", "so_far", "n", "last"]
    state, want = {}, []
    for g, i, x, v in rows:
        s = state.setdefault(g, [0, 0, None])
        s[0], s[1], s[2] = s[0] + (x or 0), s[1] + 1, v if v is not None else s[2]
        want.append((g, i, x, v, *s))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert order.scanned(df.limit(0), ["g"], ["i"], {"so_far": F.col("x")}, {"last": F.col("v")}).count() == 0


def test_one_paper_is_spread_over_tasks(spark):
    rows = [("p", 1, i // 10, 2, i % 10, "text", "TITLE" if i % 50 == 0 else f"text {i}", None, 1.0, None) for i in range(600)]
    elements = spark.createDataFrame(rows, "paper_id string, page int, page_pos int, kind_rank int, elem_pos int, element_type string, content string, image_path string, confidence double, caption string")
    numbered = structure._numbered(elements, 0.4).orderBy("page_pos", "elem_pos").collect()
    sections = texts = 0
    for at, r in enumerate(numbered, 1):
        if r["kind"] == "sec":
            sections += 1
        else:
            texts += 1
        assert (r["position"], r["node_id"], r["section"]) == (at, f"p__sec_{sections}" if r["kind"] == "sec" else f"p__text_{texts}", f"p__sec_{sections}")
    ranges = order._ranged(elements, ["paper_id", *structure.ORDER]).groupBy("_part").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 600


def test_starts_are_drawn_by_weight(spark):
    starts = spark.createDataFrame([(f"n{i}", w) for i, w in enumerate([1.0, 10.0, 1.0, 0.0, 8.0])], "node_id string, weight double")
    tries = spark.range(4000).select(F.col("id").alias("try"), ((F.col("id") + 0.5) / 4000).alias("u"), F.lit(1).alias("hops"))
    drawn = {r["start_id"]: r["count"] for r in paths.drawn_starts(starts, tries, 7).groupBy("start_id").count().collect()}
    assert drawn == {"n0": 200, "n1": 2000, "n2": 200, "n4": 1600}
    assert paths.drawn_starts(starts.limit(0), tries, 7).count() == 0


@pytest.mark.parametrize("least", [0.85, 0.0])
def test_balls_that_are_far_apart_are_not_compared(spark, least):
    import numpy as np

    from quillgraph.operators import similarity

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    points = centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 16)) * 0.3
    points[:3] = 0
    rows = [(f"n{i}", f"p{i % 7}" if i % 11 else None, i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "node_id string, paper_id string, seq bigint, embedding array<double>").repartition(3)
    size = np.sqrt((points**2).sum(axis=1))
    unit = points / np.maximum(size, 1e-300)[:, None]
    close = unit @ unit.T >= least
    want = {(f"n{i}", f"n{j}") for i in range(600) for j in range(i + 1, 600) if close[i, j] and rows[i][1] != rows[j][1]}
    got = similarity.similar_pairs(df, least, per_paper=False, block=16)
    assert {(r["src_id"], r["dst_id"]) for r in got.collect()} == want and got.count() == len(want)
    packed = similarity.in_balls(df.withColumn("grp", F.lit("")), 16).groupBy("grp", "block").applyInArrow(similarity._packed, similarity.BLOCKS)
    n, compared = packed.count(), similarity.near_blocks(packed, least).count()
    assert compared <= n * (n + 1) // 2
    if least == 0.85:
        assert compared < 0.5 * n * (n + 1) / 2, compared / (n * (n + 1) / 2)
    assert similarity.similar_pairs(df.limit(0), least, per_paper=False).count() == 0


def test_walks_draw_one_edge_of_a_hub(spark):
    """Edges are drawn by weight, new successors uniformly, and a hub's out-edges are not joined to each walk."""
    hub = [("hub", f"c{i}", "A", float(w), i) for i, w in enumerate([1, 2, 3, 0, 4])] + [(f"c{i}", "hub", "B", 1.0, 10 + i) for i in range(4)] + [("hub", "hub", "A", 0.0, 20)]
    edges = spark.createDataFrame(hub, "src_id string, dst_id string, edge_type string, weight double, seq bigint")
    starts = spark.createDataFrame([("hub",), ("c4",)], "node_id string")
    seen = {}
    for seed in range(3):
        for r in paths.random_walk(starts, edges, 1, seed=seed).collect():
            seen.setdefault(r["start_id"], []).append(tuple(r["path"]))
    assert set(seen["c4"]) == {("c4",)} and all(p[0] == "hub" and p[1] in {"c0", "c1", "c2", "c4"} for p in seen["hub"])
    many = spark.range(3000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("node_id"))
    out = many.select(F.col("node_id").alias("src_id"), F.lit("hub").alias("dst_id"), F.lit("A").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(0).cast("bigint").alias("seq"))
    got = paths.random_walk(many, edges.unionByName(out), 2, seed=1).groupBy(F.element_at("path", -1).alias("end")).count().collect()
    share = {r["end"]: r["count"] / 3000 for r in got}
    assert set(share) == {"c0", "c1", "c2", "c4"} and all(abs(share[e] - w / 10) < 0.04 for e, w in (("c0", 1), ("c1", 2), ("c2", 3), ("c4", 4)))
    tries = spark.range(3000).select(F.col("id").alias("try"), F.lit("c0").alias("start_id"), F.lit(2).alias("hops"))
    got = paths.walk_paths(tries, edges, 2).groupBy(F.array_join("path", " ").alias("path")).count().collect()
    share = {r["path"]: r["count"] / 3000 for r in got}  # c0 and the hub itself are passed over
    assert set(share) == {f"c0 hub c{i}" for i in range(1, 5)} and all(abs(x - 0.25) < 0.04 for x in share.values())


def test_what_is_dear_is_made_once_for_each_row(spark):
    """Borders of ranges are drawn from the rows as they come; what is made of them after that is made once."""
    from pyspark.sql import types as T

    from quillgraph.operators.order import scanned

    made, context = spark.sparkContext.accumulator(0), spark.sparkContext

    def dear(x):
        made.add(1)
        return None if x % 5 == 0 else x % 2

    rows = context.parallelize([(str(i % 3), i) for i in range(60)], 3).toDF("key string, at long")
    kind = F.udf(dear, T.LongType())
    got = scanned(rows, ["key"], ["at"], {"n": F.col("kind")}, made=lambda dealt: dealt.withColumn("kind", kind("at")), kept=F.col("kind").isNotNull())
    expected = {i: sum(j % 2 for j in range(i + 1) if j % 3 == i % 3 and j % 5) for i in range(60) if i % 5}
    assert got.columns == ["key", "at", "kind", "n"] and {r["at"]: r["n"] for r in got.collect()} == expected
    assert made.value == 60


def test_pairs_of_blocks_are_held_one_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(1), 256
    block = {"ids": [f"v{i}" for i in range(n)], "papers": [str(i % 3) for i in range(n)], "seqs": list(range(n)), "vectors": rng.normal(size=(n, 64)).astype(np.float32).tobytes(), "wide": False}
    row = {"block": 0, "other_block": 1} | block | {f"other_{k}": v for k, v in block.items()}
    batch = pa.RecordBatch.from_pylist([row] * 200)
    tracemalloc.start()
    for _ in similarity._products(iter([batch]), 0.999, False, similarity.BY_SEQ):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6, peak


def test_a_block_is_compared_with_itself_in_one_order():
    """Executors may compute a block twice, with its rows in two orders: no pair is lost, doubled, or of a node with itself."""
    import numpy as np
    import pyarrow as pa

    ids, vectors = ["a", "b", "c", "d"], np.array([[1, 0], [1, 1], [1, 2], [0, 1]], np.float32)
    block = lambda at: {"ids": [ids[i] for i in at], "papers": ["p"] * 4, "seqs": list(at), "vectors": vectors[list(at)].tobytes(), "wide": False}
    row = {"block": 0, "other_block": 0} | block((0, 1, 2, 3)) | {f"other_{k}": v for k, v in block((2, 0, 3, 1)).items()}
    got = [(r["src_id"], r["dst_id"]) for b in similarity._products(iter([pa.RecordBatch.from_pylist([row])]), 0.5, True, similarity.BY_SEQ) for r in b.to_pylist()]
    near = [("a", "b"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert sorted(got) == sorted(near + [(y, x) for x, y in near])


@pytest.mark.parametrize("side, most", [(1 << 25, 15), (1 << 18, 25)])
def test_blocks_are_sent_once_for_each_side_of_their_tiles(spark, monkeypatch, side, most):
    """What is shuffled grows with the number of sides, not with the number of blocks that a block meets."""
    import numpy as np

    rng = np.random.default_rng(7)
    points = rng.normal(size=(2500, 256)).astype(np.float32)  # blocks are so large that copies of one do not compress each other
    rows = [(f"n{i}", f"p{i % 5}", i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "node_id string, paper_id string, seq bigint, embedding array<float>")
    monkeypatch.setattr(similarity, "SIDE_BYTES", side, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        held = context.statusStore().executorList(True)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    try:
        before = written()
        got = similarity.similar_pairs(df, 0.15, per_paper=False, block=40).select("src_id", "dst_id").collect()
        sent = written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unit = points.astype(float) / np.sqrt((points.astype(float) ** 2).sum(axis=1))[:, None]
    near = zip(*np.nonzero(np.triu(unit @ unit.T >= 0.15, 1)))
    assert sorted(map(tuple, got)) == sorted((f"n{i}", f"n{j}") for i, j in near if i % 5 != j % 5)
    assert sent < most * points.nbytes, sent / points.nbytes
