"""Substring dedup, suffix arrays and the Jaccard join against brute force."""

from collections import Counter

import numpy as np
import pyarrow.compute
import pytest

from quillgraph.llm import common, jaccard, substring, suffix

from . import data


def split(t):
    return (t or "").encode().split()


def covered(rows, window):
    texts = [split(t) for _, t, *_ in rows]
    seen = Counter(b" ".join(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[b" ".join(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append(gone)
    return texts, out


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = [t for _, t, *_ in data.rows()] + ["x" * 3_000_000 + " y", "y " + "x" * 3_000_000]
    bytes_, offsets = common.utf8_of(pa.array(texts).slice(3))
    starts, ends, counts = common.words_of(bytes_, offsets)
    expected = [split(t) for t in texts[3:]]
    assert np.diff(counts).tolist() == [len(w) for w in expected]
    by = {}
    for w, h in zip((w for ws in expected for w in ws), common.word_hashes(bytes_, starts, ends).tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_equal_windows_choose_equal_anchors_in_batches_of_any_size():
    """Grams that agree in all but their lowest bits are still told apart, whatever the batch holds beside them."""
    rng = np.random.default_rng(3)
    window = (np.uint64(7) << np.uint64(40)) + rng.permutation(28).astype(np.uint64)
    for before in (0, 1, 1000, 300_000):
        grams = np.concatenate([rng.integers(1 << 50, 1 << 62, before).astype(np.uint64), window, rng.integers(1 << 50, 1 << 62, before).astype(np.uint64)])
        assert common.anchors(grams, 28)[before] - before == int(np.argmin(window))
    assert common.anchors(np.zeros(5, np.uint64), 3).tolist() == [0, 1, 2]


def test_sketch_never_counts_below(spark):
    """Windows that start more than once are marked, whichever partitions and batches they are in."""
    import random

    import pyarrow as pa

    rng = random.Random(2)
    shared = data.words(rng, 80)
    some = [(i, f"{data.words(rng, rng.choice((3, 50, 4000)))} {shared if i % 5 == 0 else ''} {data.words(rng, 40)}", "en", "s") for i in range(40)]
    for parts in (1, 7):
        sketch, words = substring.repeated_anchors(data.frame(spark, some).repartition(parts), 35, 8)
        assert words == sum(len(t.split()) for _, t, *_ in some)
        got = substring.Windows(pa.array([t for _, t, *_ in some]), 35, 8)
        let = set(got.at[substring.marked(sketch.value, got.grams[got.anchor])].tolist())
        seen = Counter(b" ".join(w[i : i + 35]) for _, t, *_ in some for w in [split(t)] for i in range(len(w) - 34))
        at = 0
        for _, t, *_ in some:
            w = split(t)
            assert all(at + i in let for i in range(len(w) - 34) if seen[b" ".join(w[i : i + 35])] > 1)
            at += len(w)
        assert len(let) < 0.2 * len(got.at)


def test_substring_dedup(spark):
    rows = data.rows()
    texts, gone = covered(rows, substring.WINDOW)
    expected = Counter((r[0], len(w), len(g), " ".join(x.decode() for i, x in enumerate(w) if i not in g)) for r, w, g in zip(rows, texts, gone))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup(data.frame(spark, rows)).collect())
    assert got == expected
    assert sum(len(g) for g in gone) > 500


def test_substring_stage_keeps_columns_and_clean_texts(spark):
    docs = data.frame(spark)
    got = substring.cleaned_documents(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1002]["text"] == " \t\n\r\x0b\x0c " and rows[1003]["size"] == 1
    assert rows[1008]["text"] is not None and 1006 not in rows


def test_suffix_array(spark):
    rows = [r for r in data.rows() if r[0] is not None and r[0] != 1009]
    texts, gone = covered(rows, suffix.LEAST)
    found = {}
    by = {r[0]: w for r, w in zip(rows, texts)}
    for r in suffix.repeated_spans(data.frame(spark, rows)).collect():
        assert r["n_words"] >= suffix.LEAST
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
        check_partner(r, by)
    assert found == {r[0]: g for r, g in zip(rows, gone) if g}


def check_partner(r, texts):
    """The match lies in the span, is long enough, and stands word by word in the partner, at another place."""
    n, mine, other = r["match_words"], r["match_start"], r["other_start"]
    assert suffix.LEAST <= n and r["start"] <= mine and mine + n <= r["start"] + r["n_words"]
    assert (r["doc_id"], mine) != (r["other_doc_id"], other)
    assert texts[r["doc_id"]][mine : mine + n] == texts[r["other_doc_id"]][other : other + n]


def test_united_spans_keep_the_partner_of_the_longest_match():
    spans = np.zeros(3, suffix.SPAN)
    for i, (low, high, other, place) in enumerate([(0, 60, 7, 100), (5, 200, 9, 0), (200, 300, 9, 195)]):
        spans[i] = (1, 1, low, high, other, other, place, low, high)
    (got,) = suffix.united(spans[[2, 0, 1]])
    assert [int(got[n]) for n in ("from", "to", "other", "start", "end", "place")] == [0, 300, 9, 5, 300, 0]


def test_suffix_array_in_runs_over_many_partitions(spark, monkeypatch):
    """A passage that most documents share, cut into many parts by borders and by the limit of rows held."""
    import random

    rng = random.Random(11)
    passage = data.words(rng, 55)
    some = [(i, f"{data.words(rng, 60)} {passage} {data.words(rng, 60)}" if i % 3 else data.words(rng, 170), "en", "s") for i in range(400)]
    texts, gone = covered(some, suffix.LEAST)
    found, by = {}, {r[0]: w for r, w in zip(some, texts)}
    for r in suffix.repeated_spans(data.frame(spark, some)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
        check_partner(r, by)
    assert found == {r[0]: g for r, g in zip(some, gone) if g}
    # the same rows in partitions of a few, with runs cut after three rows
    import pyarrow as pa

    monkeypatch.setattr(suffix, "_ROWS", 3)
    column = pa.array([t for _, t, *_ in some])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in some]), pa.array([r[0] for r in some]), column], names=["id", "key", "text"])

    class Everything:
        value = np.full(1 << (substring.MOST_BITS - 3), 255, np.uint8)

    rows = pa.Table.from_batches(suffix._suffixes([batch], Everything, 50, 8)).sort_by([(c, "ascending") for c in ("right", "left", "id", "key", "at")])
    out, bounds = [], [0, 1, 2, 5, 40, 300, 301, rows.num_rows]
    for low, high in zip(bounds, bounds[1:]):
        out += suffix._compare(iter(rows.slice(low, high - low).to_batches(max_chunksize=7)), 50, 8, 1, 1)
    table = pa.Table.from_batches(out)
    asked = suffix._equal(table.filter(table["asked"]), 50, 1)
    all_ = pa.concat_tables([table.filter(pa.compute.invert(table["asked"])).select(["number", "entries"]), asked])
    again = {}
    for r in suffix._unite(all_).to_pylist():
        again.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert again == found


def test_suffix_array_of_repeated_rows_and_null_ids(spark):
    got = suffix.repeated_spans(data.frame(spark)).collect()
    assert any(r["doc_id"] == 1009 for r in got)
    assert any(r["doc_id"] is None for r in got) == any(r["other_doc_id"] is None for r in got)


def test_suffix_array_finds_passages_among_their_excerpts(spark):
    """A shared passage of 60 words stays found when excerpts of under 50 words take the places beside it in both orders."""
    import random

    for seed in (0, 1, 2):
        rng = random.Random(seed)
        some = []
        for k in range(40):  # two documents, and excerpts of each that reach over one end of the passage
            passage = data.words(rng, 60).split()
            full = [data.words(rng, 49).split() + passage + data.words(rng, 49).split() for _ in range(2)]
            some += [(1000 * k + i, " ".join(w)) for i, w in enumerate(full)]
            for i in range(30):
                w = full[i % 2]
                at = rng.randint(1, len(w) - 50)
                some.append((1000 * k + 10 + i, " ".join([*data.words(rng, 10).split(), *w[at : at + 49], *data.words(rng, 10).split()])))
        rng.shuffle(some)
        rows = [(i, t, "en", "s") for i, t in some]
        _, gone = covered(rows, suffix.LEAST)
        found = {}
        texts = {i: split(t) for i, t in some}
        for r in suffix.repeated_spans(data.frame(spark, rows)).collect():
            found.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
            check_partner(r, texts)
        assert found == {r[0]: g for r, g in zip(rows, gone) if g}


def shingles(t):
    w = split(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_join(spark):
    rows = data.rows()
    sets = [shingles(t) for _, t, *_ in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in linked[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    classes = {}
    for i in range(n):
        classes.setdefault(find(i), []).append(rows[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    expected = Counter((rows[i][0], smallest[find(i)], len(linked[i])) for i in range(n))
    for options in ({}, {"block_docs": 2}, {"block_docs": 2, "most_blocks": 0}, {"most_blocks": 0}):
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(data.frame(spark, rows), **options).collect())
        assert got == expected


def test_unique_documents(spark):
    docs = data.frame(spark)
    got = jaccard.unique_documents(docs)
    assert got.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids[0] + ids[1] + ids[2] + ids[1009] == 1 and ids[4] == 1
    assert ids[1004] + ids[1005] == 1
    assert ids[1000] == ids[1001] == ids[1002] == 1


def test_large_component_in_blocks(spark):
    import random

    rng = random.Random(5)
    base = data.words(rng, 200).split()
    some = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"w{i}"
        some.append((i, " ".join(w), "en", "s"))
    sets = [shingles(t) for _, t, *_ in some]
    for options in ({"block_docs": 16, "most_blocks": 100}, {"block_docs": 16, "most_blocks": 1}):  # block by block, band by band
        got = jaccard.join(data.frame(spark, some), **options).collect()
        assert {r["class_id"] for r in got} == {0}
        for r in got:
            i = r["doc_id"]
            assert r["n_links"] == sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(120) if j != i)


def test_chained_texts_are_compared_by_shared_bands(spark):
    """Texts that drift from one to the next are one component of candidates; links and classes are those of brute force."""
    import random

    rng = random.Random(17)
    words = data.words(rng, 60).split()
    some = []
    for i in range(300):
        for _ in range(rng.choice((0, 1, 1, 2))):
            words[rng.randrange(60)] = f"n{i}"
        some.append((i, " ".join(words), "en", "s"))
    sets = [shingles(t) for _, t, *_ in some]
    linked = [{j for j in range(300) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(300)]
    root = list(range(300))
    for i in range(300):  # classes are runs, but links may skip
        for j in linked[i]:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    for options in ({"block_docs": 8, "most_blocks": 1}, {}):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(data.frame(spark, some), **options).collect()}
        assert got == {i: (root[i], len(linked[i])) for i in range(300)}


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 5)
    import random

    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1000 + i + 1) for i in range(60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    got = jaccard.components(df, "test").collect()
    assert {r["node"]: r["root"] for r in got} == expected and len(got) == len(expected)
    from pyspark.sql import functions as F

    twice = df.select(*[F.struct(F.col(c).alias("node"), (-F.col(c)).alias("other")).alias(c) for c in ("a", "b")])
    got = jaccard.components(twice, "test").collect()
    assert {r["node"]["node"]: r["root"]["node"] for r in got} == expected and len(got) == len(expected)
    assert jaccard.components(df.limit(0), "test").count() == 0


def test_unique_documents_of_repeated_rows(spark):
    some = [(None, "a b c d e f g", "en", "s")] * 20 + [(5, "h i j k l m n", "en", "s")] * 3 + [(6, "h i j k l m n", "en", "t"), (None, "", "en", "s"), (None, "", "en", "s"), (8, None, "en", "s")]
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.unique_documents(data.frame(spark, some)).collect())
    assert got == Counter({(None, "a b c d e f g"): 1, (5, "h i j k l m n"): 1, (None, ""): 2, (8, None): 1})


def test_posterior_bounds():
    from fractions import Fraction

    least = jaccard.least_matches(Fraction("0.8"), 1e-9, 28, 252)
    assert list(least) == sorted(least) and 0 < least[0] < 0.8 * 28 and 0.6 * 252 < least[-1] < 0.8 * 252


@pytest.mark.parametrize("operator", [substring.dedup, suffix.repeated_spans, jaccard.join, jaccard.unique_documents, substring.cleaned_documents])
def test_empty_table(spark, operator):
    assert operator(data.empty(spark)).count() == 0
