"""The pipeline's stages on small documents: decisions take effect, clean documents stay, columns are kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from quillgraph.llm import jaccard, langid, packing, queries
from quillgraph.sources.scratch import staged

from . import data
from .test_pairs_and_substrings import covered, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = staged(stage(spark, now, sf), name)
        if name != "packed":
            assert now.columns == docs.columns
            counts.append(now.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "mixture", "packed"]
    assert counts[1] >= 0.95 * counts[0]  # few documents have no letter
    assert counts[0] > counts[2] >= 0.7 * counts[0]  # copies go
    assert now.where("length > 4096 or offset + length > 4096").count() == 0


def listed(df):
    return [tuple(r) for r in df.collect()]


def at(df, name):
    return df.columns.index(name)


def test_each_stage_against_brute_force(spark):
    """Every stage on all that its predecessor kept: which rows stay, with what text, how often, and in which pieces."""
    docs = data.frame(spark)
    stages = dict(corpus_pipeline.STAGES)
    one = staged(stages["language"](spark, docs, ""), "one")
    model = langid.train(langid.training_rows(docs))
    text, lang = at(docs, "text"), at(docs, "doc_id")
    kept = [r for r in listed(docs) if (p := model.predict(r[text] or ""))[0] != langid.UNKNOWN and p[1] >= 0.5]
    assert Counter(listed(one)) == Counter(kept) and len(kept) > 55

    two = staged(stages["near_duplicates"](spark, one, ""), "two")
    sets = [shingles(r[text]) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= jaccard.THRESHOLD * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if x == old else x for x in group]
    classes = defaultdict(list)
    for g, r in zip(group, kept):
        classes[g].append(r)
    expected = Counter(min((r[lang] for r in rows if r[lang] is not None), default=None) for rows in classes.values())
    got = listed(two)
    assert Counter(r[lang] for r in got) == expected and not Counter(got) - Counter(kept) and len(got) < len(kept) - 20

    three = staged(stages["substrings"](spark, two, ""), "three")
    words, gone = covered([(0, r[text]) for r in got], 35)
    expected = Counter()
    for r, w, g in zip(got, words, gone):
        if not g:
            expected[r] += 1
        elif len(g) < len(w):
            left = " ".join(x.decode() for i, x in enumerate(w) if i not in g)
            expected[tuple(left if i == text else len(left) if c == "n_chars" else r[i] for i, c in enumerate(docs.columns))] += 1
    got = listed(three)
    assert Counter(got) == expected and sum(map(len, gone)) > 100

    four = staged(stages["mixture"](spark, three, ""), "four")
    source, size, times = at(docs, "source"), Counter(), Counter(listed(four))
    for r in got:
        size[r[source]] += len(WORD.findall(r[text] or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, target, free, rest = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(size.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]} or free
        if over == free and not any(share[s] > 2 * size[s] for s in free):
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            rest -= target[s]
        free -= over
    assert not set(times) - set(got)
    for s in order:
        own = [r for r in set(got) if r[source] == s]
        taken = sum(times[r] * len(WORD.findall(r[text] or "")) for r in own)
        assert abs(taken - target[s]) <= max(len(WORD.findall(r[text] or "")) for r in own) + 1e-6
        assert all(times[r] in (int(target[s] / size[s]), int(target[s] / size[s]) + 1) for r in own if WORD.search(r[text] or ""))

    five = stages["packed"](spark, four, "").collect()
    tokens = packing.tokenizer(queries.vocabulary())
    expected, by = Counter(), defaultdict(list)
    for r in listed(four):
        n = len(tokens.ids(r[text] or "")) // 4 + 1
        for k in range(0, n, 4096):
            expected[r[lang], k // 4096, k, min(4096, n - k)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in five) == expected
    for r in five:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 4096
    assert len(by) <= 1.1 * sum(r["length"] for r in five) / 4096 + 1


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, data.empty(spark), "").count() == 0


def test_run_leaves_only_what_its_result_reads(spark, sf):
    from quillgraph.sources.scratch import owned

    with owned(spark, release=True) as own:
        got = corpus_pipeline.run(spark, sf)
        assert got.count() > 0 and not [p for p in own.paths if "quillgraph-language" in p or "quillgraph-nodes" in p]
        left = list(own.paths)
    assert left and not own.paths


def test_two_runs_at_once_leave_each_other_alone(spark, sf):
    from concurrent.futures import ThreadPoolExecutor

    from quillgraph.sources.scratch import owned

    def once(_):
        with owned(spark, release=True):
            return sorted(map(repr, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()))

    with ThreadPoolExecutor(2) as threads:
        one, two = threads.map(once, range(2))
    assert one and one == two
