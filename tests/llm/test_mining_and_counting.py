"""Hard negatives, power-of-two decomposition and dominance counting against plain loops, and on rows that tables have and tests rarely do."""

import math
import random
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decompose, dominance, hardneg
from quillgraph.llm.queries import vocabulary
from quillgraph.session import local_session

from . import data

# --- hard negatives ----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, score double, rank int, block long, a_block long, dim string, positive_id long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, None, 2, "d", 3) for r in rows], VECTORS)


def mined(rows, every=5, positives=5, negatives=3):
    """The definition, with whole numbers of Python."""
    good = [(v, l, [math.floor(256 * x) for x in e]) for v, l, e in rows if v is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for at, (v, l, e) in enumerate(good):
        if v % every:
            continue
        scored = [(-sum(a * b for a, b in zip(e, g)), w, m) for i, (w, m, g) in enumerate(good) if i != at and len(g) == len(e)]
        for p, w, _ in sorted(x for x in scored if x[2] == l)[:positives]:
            inside = sorted(x for x in scored if x[2] != l and 50 * -p <= 100 * -x[0] <= 95 * -p)
            out += [(v, w, r, n, -p, -s) for r, (s, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def some_vectors(seed, n, dim=8, values=None):
    rng = random.Random(seed)
    point = lambda: [np.float32(rng.choice(values) if values else rng.gauss(0.3, 1)).item() for _ in range(dim)]
    return [(i, rng.choice([0, 0, 1, 2, 3]), point()) for i in range(n)]


@pytest.mark.parametrize("seed,values", [(1, None), (2, [0.0, 0.5, 1.0]), (3, [1e-3, -1e-3, 0.0])])
def test_mined_negatives_are_those_of_the_definition(spark, seed, values):
    rows = some_vectors(seed, 300, values=values)
    df = vectors(spark, rows).repartition(4)
    for options in ({}, {"block": 16, "anchor_block": 7, "wave_bytes": 900}):
        got = hardneg.mine(df, F.col("vec_id") % 5 == 0, **options)
        assert sorted(map(tuple, got.collect())) == mined(rows)


def test_rows_that_take_no_part_and_rows_that_repeat(spark):
    rows = some_vectors(4, 60)
    rows += [(60, None, rows[0][2]), (65, 1, None), (None, 1, rows[1][2]), (70, 0, [*rows[0][2][:-1], None]), (75, 1, [float("nan")] * 8), (80, 1, [float("inf")] + [0.0] * 7)]
    rows += [rows[0], rows[0], rows[3], (85, 0, [1.0, 2.0]), (86, 0, [2.0, 1.0]), (90, 1, []), (91, 2, [1.0, 1.5])]
    got = hardneg.mine(vectors(spark, rows).repartition(3), F.col("vec_id") % 5 == 0, block=16)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    assert hardneg.mine(vectors(spark, []), F.col("vec_id") % 5 == 0).columns == got.columns
    assert hardneg.mine(vectors(spark, []), F.col("vec_id") % 5 == 0).count() == 0


def test_scores_beyond_two_to_the_53_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [float(np.float32(rng.uniform(2.0e5, 5.0e5))) for _ in range(4)]) for i in range(40)]
    got = hardneg.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0)
    want = mined(rows)
    assert want and max(r[4] for r in want) > 2**53
    assert sorted(map(tuple, got.collect())) == want
    huge = [(i, i % 2, [1e18] * 4) for i in range(8)]
    with pytest.raises(Exception, match="64 bits"):
        hardneg.mine(vectors(spark, huge), F.col("vec_id") % 5 == 0).collect()


# --- power-of-two decomposition ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 8, 4096])
def test_binary_lengths(most):
    for n in [*range(200), 4095, 4096, 4097, 12_345]:
        parts = decompose.binary_lengths(n, most)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= most for p in parts) and parts == sorted(parts, reverse=True)
        assert len(parts) == n // most + bin(n % most).count("1")


@pytest.mark.parametrize("most", [64, 4096])
def test_pieces_hold_every_id_once_and_buckets_have_no_gaps(spark, most):
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(vocabulary()), data.rows()
    got = decompose.decompose_documents(data.frame(spark, rows), vocabulary(), max_tokens=most, batch_tokens=4 * most).collect()
    want = {}
    for doc, text, *_ in rows:
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for length in decompose.binary_lengths(len(ids), most):
            key = (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
            start += length
    found = {}
    for r in got:
        key = (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        found[key] = found.get(key, 0) + 1
    assert found == want
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    for length in {r["length"] for r in got}:
        bucket = sorted((r["sequence_id"], r["batch"]) for r in got if r["length"] == length)
        assert [s - bucket[0][0] for s, _ in bucket] == list(range(len(bucket)))
        assert [b for _, b in bucket] == [i // (4 * most // length) for i in range(len(bucket))]


def test_decomposition_of_nothing_and_of_wrong_lengths(spark):
    assert decompose.decompose_documents(data.empty(spark), vocabulary()).count() == 0
    with pytest.raises(ValueError):
        decompose.pieces(data.frame(spark), vocabulary(), max_tokens=1000)


# --- dominance counting ------------------------------------------------------------------------------------------------


def test_wavelet_matrix_against_a_count():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (50, 1), (257, 7), (400, 1000)):
        values, weights = rng.integers(0, top, n), rng.integers(0, 9, n)
        matrix = dominance.WaveletMatrix(values, weights)
        prefix, asked = rng.integers(0, n + 1, 100), rng.integers(0, 2 * top + 2, 100)
        found, weight = matrix.greater(prefix, asked)
        assert [(values[:p] > v).sum() for p, v in zip(prefix, asked)] == found.tolist()
        assert [weights[:p][values[:p] > v].sum() for p, v in zip(prefix, asked)] == weight.tolist()


def above(rows):
    whole = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for name, s, l, w in rows:
        some = None if s is None or l is None else [x[3] or 0 for x in whole if x[1] < s and x[2] > l]
        out.append((name, s, l, w, None if some is None else len(some), None if some is None else sum(some)))
    return sorted(out, key=repr)


POINTS = "id long, slot long, level long, weight int"


@pytest.mark.parametrize("kind", ["even", "one slot", "one level", "one point", "few values", "falling"])
def test_counts_are_those_of_the_definition(spark, kind):
    rng = random.Random(7)
    slot, level = {
        "even": (lambda i: rng.randint(-500, 500), lambda i: rng.randint(-500, 500)),
        "one slot": (lambda i: 3 if i % 3 else rng.randint(0, 9), lambda i: rng.randint(0, 50)),
        "one level": (lambda i: rng.randint(0, 50), lambda i: 3 if i % 3 else rng.randint(0, 9)),
        "one point": (lambda i: 3 if i % 3 else rng.randint(0, 9), lambda i: 3 if i % 3 else rng.randint(0, 9)),
        "few values": (lambda i: rng.randint(0, 2), lambda i: rng.randint(0, 2)),
        "falling": (lambda i: i, lambda i: -i),
    }[kind]
    rows = [(i % 350, slot(i), level(i), rng.randint(0, 5)) for i in range(400)]
    rows += [(1, None, 5, 1), (2, 5, None, 1), (None, 4, 4, None), (3, None, None, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    want = above(rows)
    for part_rows in (1 << 17, 100):
        got = dominance.count_above(df, part_rows)
        assert got.columns == ["id", "slot", "level", "weight", "n_above", "weight_above"]
        rows_got = [tuple(r) if r["weight"] is not None else (*r[:3], None, *r[4:]) for r in got.collect()]
        plain = [(a, b, c, w or 0, n, m) for a, b, c, w, n, m in want]
        assert sorted(((a, b, c, w or 0, n, m) for a, b, c, w, n, m in rows_got), key=repr) == sorted(plain, key=repr)


def test_many_shards_are_dealt_evenly_and_their_table_stays_small():
    for n in (0, 1, 10**6, 10**9, 10**12):
        shards = dominance.shards_for(n, dominance.PART_ROWS)
        assert shards >= 1 and (shards == 1 or shards**2 <= n / 16 + 2 * shards)


def test_sales_with_clashing_columns_nulls_and_other_zones(spark):
    own = ", row int, chunk int, shard int, n_above string, weight_above string, slot string, level string"
    rows = [
        (1, 10.0, datetime(2024, 3, 31, 1, 30, 59)), (2, 20.0, datetime(2024, 3, 31, 1, 29)), (3, 20.004, datetime(2024, 3, 31, 2, 30)),
        (4, None, datetime(2024, 3, 31, 2, 30)), (5, 1.0, None), (None, 30.0, datetime(1969, 12, 31, 23, 59, 30)), (6, float("nan"), datetime(2024, 1, 1)), (7, float("inf"), datetime(2024, 1, 1)),
    ]
    session = spark.newSession()
    for zone in ("UTC", "Europe/Berlin", "America/New_York"):
        session.conf.set("spark.sql.session.timeZone", zone)
        df = session.createDataFrame([(*r, 1, 2, 3, "a", "b", "c", "d") for r in rows], "sale_id long, total double, sold_at timestamp_ntz" + own)
        got = {r["sale_id"]: r for r in dominance.count_above(dominance.sale_points(df)).collect()}
        epoch = datetime(1970, 1, 1)
        for name, total, at in rows:
            r = got[name]
            assert r["slot"] == (None if at is None else math.floor((at - epoch).total_seconds() / 60))
            assert r["level"] == (None if total is None or not math.isfinite(total) else math.floor(math.floor(100 * total + 0.5) / 1))
            assert r["weight"] == 1 + (0 if name is None else zlib.crc32(str(name).encode()) % 5)
        assert got[1]["n_above"] == 2 and got[3]["n_above"] == 1 and got[None]["n_above"] == 0 and got[4]["n_above"] is None and got[6]["n_above"] is None
        extra = df.select("sale_id", "row", "chunk", F.lit(1).cast("long").alias("slot"), F.lit(2).cast("long").alias("level"), F.lit(1).alias("weight"), "shard")
        assert dominance.count_above(extra).columns == [*extra.columns, "n_above", "weight_above"]
    empty = session.createDataFrame([], "sale_id long, total double, sold_at timestamp_ntz")
    assert dominance.count_above(dominance.sale_points(empty)).count() == 0


def test_zoned_timestamps_are_instants():
    session = local_session(4).newSession()
    session.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    df = session.sql("SELECT 1L AS sale_id, 1.0D AS total, TIMESTAMP '2024-01-01T00:00:30Z' AS sold_at")
    assert dominance.sale_points(df).first()["slot"] == int(datetime(2024, 1, 1).timestamp() - datetime(1970, 1, 1).timestamp()) // 60
