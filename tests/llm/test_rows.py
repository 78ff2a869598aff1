"""Operators that work row by row or by source, against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import chat, fingerprint, langid, mixing, packing, perplexity, queries, warc

from . import data


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_fingerprints(spark):
    rows = [r for r in data.rows() if r[0] is not None and r[0] != 1009]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(data.frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: r[0])
    for at, (id_, t, *_) in enumerate(order):
        t, following = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        r = got[id_]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + following[:half]))
        assert r["fingerprint"] == fingerprint.fingerprint(t)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[0]["near_next"] == 1.0  # document 1 is a copy of 0
    assert np.mean([r["near_edited"] for r in got.values() if r["n_chars"] > 200]) > 0.35
    assert len(fingerprint.fingerprints(data.frame(spark)).collect()) == len(data.rows())
    single = fingerprint.fingerprints(data.frame(spark, [(7, "abcd", "en", "s")])).first()
    assert single["edited_sha256"] == sha("abab") and single["near_next"] == 1.0


def plain_fingerprint(text):
    """Byte by byte: a rolling hash over seven bytes ends chunks; the sum of a chunk's hashes gives its character."""
    m = 0xFFFFFFFF
    raw = text.encode()
    if not raw:
        return "4::"
    value = [int(fingerprint._VALUES[b]) for b in range(256)]
    p = [pow(0x9E3779B1, k, 1 << 32) for k in range(7)]
    hashes = []
    for i in range(len(raw)):
        h = sum(value[raw[i - k]] * p[k] for k in range(min(7, i + 1))) & m
        h ^= h >> 15
        h = h * 0x2C1B3C6D & m
        hashes.append(h ^ (h >> 13))

    def signature(block, longest):
        out, sum_, any_ = "", 0, False
        for h in hashes:
            sum_, any_ = (sum_ + h * 0x297A2D39) & m, True
            if h % block == block - 1 and len(out) < longest - 1:
                out += chr(fingerprint.ALPHABET[(sum_ * 0x85EBCA6B & m) >> 26])
                sum_, any_ = 0, False
        return out + chr(fingerprint.ALPHABET[(sum_ * 0x85EBCA6B & m) >> 26]) if any_ else out

    block = 4
    while block * 64 < len(raw):
        block *= 2
    while block > 4 and sum(h % block == block - 1 for h in hashes) < 31:
        block //= 2
    return f"{block}:{signature(block, 64)}:{signature(2 * block, 32)}"


def plain_likeness(a, b):
    (x, s, d), (y, t, e) = a.split(":"), b.split(":")

    def close(p, q):
        row = list(range(len(q) + 1))
        for i, c in enumerate(p, 1):
            before, row[0] = row[0], i
            for j, k in enumerate(q, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != k))
        return 1 - row[-1] / max(len(p), len(q)) if p or q else 0.0

    if a == b:
        return 1.0
    x, y = int(x), int(y)
    return max(close(s, t), close(d, e)) if x == y else close(s, e) if x == 2 * y else close(d, t) if y == 2 * x else 0.0


def test_fingerprints_equal_a_loop_over_bytes(spark):
    rng = random.Random(6)
    some = [r for r in data.rows() if r[0] is not None and r[0] != 1009]
    some += [(3000 + i, "".join(rng.choices("ab é\n", k=n)), "en", "s") for i, n in enumerate((1, 2, 6, 7, 8, 255, 256, 257, 5000))] + [(3100, "a" * 5000, "en", "s"), (3101, "a" * 5001, "en", "s")]
    order = sorted(some, key=lambda r: r[0])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(data.frame(spark, some)).collect()}
    for at, (id_, t, *_) in enumerate(order):
        t, following = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        own, edit, its = (plain_fingerprint(x) for x in (t, t[: len(t) - half] + following[:half], following))
        r = got[id_]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, edit), id_
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(plain_likeness(own, edit)), pytest.approx(plain_likeness(own, its)))


def test_fingerprints_of_null_and_repeated_ids(spark):
    some = [(None, "b" * 50, "en", "s"), (1, "x" * 20, "en", "s"), (1, "x" * 20, "en", "s"), (1, "y" * 20, "en", "s"), (0, None, "en", "s")]
    got = fingerprint.fingerprints(data.frame(spark, some)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t, *_ in some)
    own = {r["fingerprint"] for r in got if r["doc_id"] == 1}
    assert own == {plain_fingerprint("x" * 20), plain_fingerprint("y" * 20)}
    # the row without an id is last, and its next one is the first
    (last,) = [r for r in got if r["doc_id"] is None]
    assert last["edited_sha256"] == sha("b" * 25) and last["near_next"] == 0.0
    assert fingerprint.fingerprints(data.empty(spark)).count() == 0


def test_fingerprints_are_local():
    rng = random.Random(2)
    t = data.words(rng, 900)
    near = fingerprint.fingerprint(t[:2000] + "inserted " + t[2000:])
    a, b = fingerprint.fingerprint(t).split(":"), near.split(":")
    assert a[0] == b[0]
    assert sum(x == y for x, y in zip(a[1], b[1])) > 10


def test_mixing(spark):
    rows = data.rows(n=400)
    docs = data.frame(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= over
    by = defaultdict(list)
    for r in got:
        by[r["source_size"], round(r["target"], 6)].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert {k for k in by} == {(sizes[s], round(target[s], 6)) for s in order}
    for (_, t), rs in by.items():
        error, largest = abs(sum(r["taken"] for r in rs) - t), max(r["size"] for r in rs)
        assert error < largest + 1e-6 and (largest > 1000 or error <= 0.01 * t)
    assert len(got) == len(rows)
    stage = mixing.mixed_documents(docs)
    assert stage.columns == docs.columns
    kept = defaultdict(int)
    for r in stage.collect():
        kept[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    for s in order:
        assert abs(kept[s] - target[s]) < max(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows if r[3] == s) + 1e-6


def test_mixing_keeps_expectations(spark):
    """Over many seeds a document is taken as often as its share of the target says."""
    rng = random.Random(4)
    some = [(i, data.words(rng, rng.randint(5, 60)), "en", ("a", "b", "c")[i % 3]) for i in range(60)]
    docs = data.frame(spark, some)
    sum_, seeds = defaultdict(float), 60
    for seed in range(seeds):
        for r in mixing.mix(docs, seed=seed, block=8).collect():
            sum_[r["doc_id"]] += r["copies"] / seeds
            share = r["target"] / r["source_size"]
            assert int(share) <= r["copies"] <= int(share) + 1
            sum_["expected", r["doc_id"]] = share
    errors = [sum_[i] - sum_["expected", i] for i in range(60)]
    assert max(map(abs, errors)) < 5 * 0.5 / seeds**0.5 and abs(np.mean(errors)) < 0.02


def test_mixture_keeps_equal_rows_of_sources_apart(spark):
    rng = random.Random(7)
    texts = [data.words(rng, 40) for _ in range(120)]
    some = [(i, t, "en", s) for i, t in enumerate(texts) for s in ("a", "b")] + [(i, texts[i], "en", "a") for i in range(40)] + [(None, "x y", "en", None)] * 30
    docs = data.frame(spark, some)
    expected, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        expected[round(r["target"], 6)] += r["taken"]
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len((r["text"] or "").split())
    assert sorted(expected.values()) == sorted(got.values())
    assert {k: len(v) for k, v in {s: {r["doc_id"] for r in mixing.mixed_documents(docs).where(f"source = '{s}'").collect()} for s in "ab"}.items()}["a"] > 0


@pytest.mark.parametrize("operator", [mixing.mix, mixing.mixed_documents, perplexity.base_rules, langid.accepted_documents])
def test_empty_tables(spark, operator):
    assert operator(data.empty(spark)).count() == 0


def test_chat_ties_and_loss_mask(spark):
    turns = [(1, 0, "assistant", "<|a"), (1, 0, "assistant", "<z"), (1, 0, "assist", "<|"), (1, 0, "a\nb", "x"), (1, 1, "user", "say <|im_end|>"), (1, 2, "assistant", "done <|x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    own = sorted(turns, key=lambda t: t[1:])
    got = chat.read_back(chat.render(df)).first()
    assert got["turns_sha256"] == sha("".join(f"{t[2]}\n{t[3]}\n" for t in own))
    rows = sorted(chat.formatted(chat.render(df)).collect(), key=lambda r: r["place"])
    whole = "".join(r["rendered"] for r in rows)
    assert [x[:2] for x in chat.parse(whole)] == [t[2:] for t in own]
    assert all(whole[r["start"] : r["end"]] == r["rendered"] for r in rows)
    masked = "".join(chat.unescape(whole[r["learned_start"] : r["learned_end"]]) for r in rows if r["learned_start"] is not None)
    assert masked == "".join(t[3] for t in own if t[2] == "assistant") and sha(masked) == got["loss_sha256"]


def test_chat(spark):
    turns = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\\b <\\|x|>"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (2, None, "system", "first"), (None, 0, "we\nird|<|", "x"), (1, 3, "assistant", "é" * 5000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, rendered int").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(df)).collect()}
    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own))
        learned = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), sha(learned))
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_base_counts(spark):
    rows = data.rows() + [(5000, "a\na\n \n a\nb|c# é", "en", "s")]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in perplexity.quality(data.frame(spark, rows)).collect())
    expected = Counter()
    for id_, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        expected[id_, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    assert got == expected
    assert perplexity.quality(data.empty(spark)).count() == 0


def kneser_ney(texts):
    """Modified Kneser-Ney over character classes by its definition, with dictionaries: a function of context and character."""
    order, size = perplexity.ORDER, 1 << perplexity.CLASS_BITS
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        code = [0] * (order - 1) + perplexity.classes([t])[0].tolist()[order - 1 :]
        for i in range(order - 1, len(code)):
            counts[order][tuple(code[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    below = []
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
            below.append([min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)])
        else:
            below.append([0.5, 1.0, 1.5])

    followers = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            followers[k][g[:-1]].append(c)

    def p(gram):
        if not gram:
            return 1 / size
        k = len(gram)
        give = lambda c: below[k - 1][min(c, 3) - 1]
        after = followers[k].get(gram[:-1], [])
        if not after:
            return p(gram[1:])
        total, c = sum(after), counts[k].get(gram, 0)
        return ((c - give(c)) / total if c else 0.0) + sum(map(give, after)) / total * p(gram[1:])

    return p, counts


def packed_gram(gram):
    out = 0
    for c in gram:
        out = out << perplexity.CLASS_BITS | c
    return out


def test_kneser_ney_equals_its_definition(spark):
    """Probabilities of counted and of new 5-grams, those of all characters after a context add up to one, and scores of documents."""
    rng = random.Random(5)
    texts = {"en": [t for _, t, *_ in data.rows(n=20) if t and len(t) < 3000], "fr": [data.words(rng, 50) + " 漢é" for _ in range(4)], "": ["ab", ""]}
    rows = [(i, t, lang or None, "s") for i, (lang, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    rows += [(900, None, "en", "s"), (901, "", "xx", "s"), (902, " ", "en", "s")]
    texts["en"].append(" ")
    docs = perplexity.with_files(data.frame(spark, rows))
    counts = perplexity.gram_counts(perplexity.asked_of(docs)[0])
    models = {lang: kneser_ney(t) for lang, t in texts.items()}
    got = {(r["lang"], r["gram"]): r["log"] for r in perplexity.log_probabilities(counts).collect()}
    assert set(got) == {(lang, packed_gram(g)) for lang, (_, c) in models.items() for g in c[perplexity.ORDER]}
    for lang, (p, c) in models.items():
        for g in c[perplexity.ORDER]:
            assert got[lang, packed_gram(g)] == pytest.approx(np.log(p(g)), abs=1e-9)
    size = 1 << perplexity.CLASS_BITS
    contexts = [(97, 98, 99, 100), (0, 0, 0, 0), (4000, 4001, 4002, 4003), next(iter(models["en"][1][perplexity.ORDER]))[:-1]]
    wanted = [("en", packed_gram((*c, x))) for c in contexts for x in range(size)]
    new = {(r["lang"], r["gram"]): r["log"] for r in perplexity.log_probabilities(counts, spark.createDataFrame(wanted, "lang string, gram long")).collect()}
    for c in contexts:
        assert sum(np.exp(new["en", packed_gram((*c, x))]) for x in range(size)) == pytest.approx(1, abs=1e-9)
        for x in (97, 32, 4095):
            assert new["en", packed_gram((*c, x))] == pytest.approx(np.log(models["en"][0]((*c, x))), abs=1e-9)
    scored = {r["doc_id"]: r for r in perplexity.scored_documents(data.frame(spark, rows)).collect()}
    for id_, t, lang, _ in rows:
        words = len((t or "").split())
        if not words:
            assert scored[id_]["nll"] is None
            continue
        code = [0] * 4 + perplexity.classes([t])[0].tolist()[4:]
        nll = -sum(np.log(models[lang or ""][0](tuple(code[i - 4 : i + 1]))) for i in range(4, len(code)))
        assert scored[id_]["nll"] == pytest.approx(nll / words, rel=1e-5)


def test_perplexity_is_the_same_from_files_of_any_number(spark, tmp_path):
    """Nothing in the model depends on how the input is cut, and equal questions of one file's tasks are one."""
    docs = data.frame(spark)
    seen = []
    for n in (1, 6):
        docs.repartition(n).write.parquet(str(tmp_path / str(n)))
        back = spark.read.parquet(str(tmp_path / str(n)))
        assert "chunk" in perplexity.with_files(back).columns
        seen.append(Counter((r["doc_id"], r["kept"], round(r["perplexity"] or 0, 3)) for r in perplexity.quality(back).collect()))
    seen.append(Counter((r["doc_id"], r["kept"], round(r["perplexity"] or 0, 3)) for r in perplexity.quality(docs).collect()))
    assert seen[0] == seen[1] == seen[2] and sum(seen[0].values()) == len(data.rows())


def test_perplexity_rejects_strange_texts(spark):
    rng = random.Random(8)
    vocabulary = [data.words(rng, 1) for _ in range(300)]
    some = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(60, 200))), "en", "s") for i in range(300)]
    some += [(1000 + i, " ".join("".join(rng.choices("QXZJ#%&", k=12)) for _ in range(80)), "en", "s") for i in range(3)]
    got = {r["doc_id"]: r for r in perplexity.quality(data.frame(spark, some)).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(3))
    assert sum(got[i]["kept"] for i in range(300)) == sum(not got[i]["base_failed"] for i in range(300))


def test_perplexity_rejects_likely_junk_and_mildly_garbled_texts(spark):
    rng = random.Random(9)
    vocabulary = [data.words(rng, 1) for _ in range(300)]
    some = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(60, 200))), "en", "s") for i in range(300)]
    short = sorted(vocabulary, key=len)[:12]
    for i in range(40):  # more and more short words, and more and more words with a mark
        some.append((1000 + i, " ".join(rng.choice(short if rng.random() < i / 40 else vocabulary) for _ in range(100)), "en", "s"))
        some.append((2000 + i, " ".join(w + "&%#*$"[i % 5] * (3 if rng.random() < i / 40 else 0) for w in rng.choices(vocabulary, k=100)), "en", "s"))
    got = {r["doc_id"]: r for r in perplexity.quality(data.frame(spark, some)).collect()}
    log = {k: np.log(r["perplexity"]) for k, r in got.items() if not r["base_failed"]}
    middle = np.median(list(log.values()))
    unit = max(0.1, 1.4826 * np.median(np.abs(np.array(list(log.values())) - middle)))
    far = {k: (x - middle) / unit for k, x in log.items()}
    low, high = [k for k, z in far.items() if -9.5 < z < -4.8], [k for k, z in far.items() if 6.3 < z < 9.5]
    assert low and high and min(low) >= 1000 and min(high) >= 2000
    assert not any(got[k]["kept"] for k in low + high)
    assert all(got[k]["kept"] for k, z in far.items() if -4.2 < z < 5.7)


def test_warc(spark, tmp_path):
    pages = [(1, "u1", "<p>" + "x" * 200), (2, "u2 é\r\n", "<p>" + "x" * 200), (3, None, None), (4, "u", ""), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 3000), (7, "u", "é" * 3000), (None, "u", "é" * 3000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archived(df, with_html=True).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((p, len((h or "").encode()), sha(h or "")) for p, _, h in pages)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "response", None): 1, (2, "revisit", 1): 1, (3, "response", None): 1, (4, "response", None): 2, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1, (7, "revisit", 7): 1, (None, "revisit", 7): 1})
    assert all(sha(r["html"]) == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert {r["url"] for r in got if r["page_id"] == 2} == {"u2 é\r\n"}
    assert warc.archived(df.limit(0)).count() == 0


def test_normaliser_reads_any_members(tmp_path):
    records = [warc.record(i, f"http://x/{i}", b"a" * i * 70_000, sha("a" * i * 70_000)) for i in range(6)]
    whole = zlib.compressobj(9, zlib.DEFLATED, 31)
    one = whole.compress(b"".join(records[:4])) + whole.flush()
    for r in records[4:]:
        member = zlib.compressobj(9, zlib.DEFLATED, 31)
        one += member.compress(r) + member.flush()
    (tmp_path / "in.gz").write_bytes(one)
    uri = f"file://{tmp_path}"
    assert warc.normalise(f"{uri}/in.gz", f"{uri}/out.gz", f"{uri}/out.idx")[0] == 6
    assert list(warc.read_records(f"{uri}/out.gz", f"{uri}/out.idx")) == records


def test_warc_urls_come_back_as_they_are(spark):
    urls = ["http://x/a%20b%2Fc", "http://x/%", "http://x/é?q=a b#f", " lead", "a\tb\r\nc%0A", "", "%41"]
    df = spark.createDataFrame([(i, u, f"<p>{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r["page_id"]: r["url"] for r in warc.archived(df).collect()} == dict(enumerate(urls))


def gzipped(raw):
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def test_normaliser_refuses_truncated_streams_and_reads_plain_headers(tmp_path):
    uri = f"file://{tmp_path}"

    def normal(raw):
        (tmp_path / "in.gz").write_bytes(raw)
        return warc.normalise(f"{uri}/in.gz", f"{uri}/out.gz", f"{uri}/out.idx")

    records = [warc.record(i, f"http://x/{i}", b"abc" * 50, sha("abc" * 50)) for i in range(3)]
    whole = gzipped(b"".join(records))
    assert normal(whole)[0] == 3 and normal(gzipped(b""))[0] == 0
    for broken in (whole[:-1], whole[:-8], whole[: len(whole) // 2], whole + whole[:30], gzipped(b"".join(records)[:-9])):
        with pytest.raises(ValueError):
            normal(broken)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    at_a_border = pack.compress(b"".join(records)) + pack.flush(zlib.Z_SYNC_FLUSH)
    with pytest.raises(ValueError):
        normal(at_a_border)
    bare = [head.replace(b": ", b":") + b"\r\n\r\n" + rest for head, rest in (r.split(b"\r\n\r\n", 1) for r in records)]
    assert normal(gzipped(b"".join(bare)))[0] == 3
    fields, _ = warc.headers(next(warc.read_records(f"{uri}/out.gz", f"{uri}/out.idx")))
    assert fields["warc-type"] == "response" and warc.target(fields) == "http://x/0"


def test_follow_the_regularised_leader_equals_a_loop_over_coordinates():
    rng = random.Random(12)
    rows = []
    for _ in range(40):
        at = np.array([*sorted(rng.sample(range(30), 6)), langid.FEATURES])
        rows.append((rng.randrange(3), at, np.array([rng.random() for _ in at])))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    got = langid.ftrl(rows, 3, alpha, beta, l1, l2, epochs=2, seed=5)
    z, n = defaultdict(float), defaultdict(float)

    def weight(c, i):
        if abs(z[c, i]) <= l1:
            return 0.0
        return -(z[c, i] - (l1 if z[c, i] > 0 else -l1)) / ((beta + n[c, i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            label, at, values = rows[k]
            w = {(c, i): weight(c, i) for c in range(3) for i in at.tolist()}
            logits = [sum(w[c, i] * v for i, v in zip(at.tolist(), values)) for c in range(3)]
            top = max(logits)
            e = [np.exp(x - top) for x in logits]
            for c in range(3):
                slope = e[c] / sum(e) - (c == label)
                for i, v in zip(at.tolist(), values):
                    g = slope * v
                    z[c, i] += g - ((n[c, i] + g * g) ** 0.5 - n[c, i] ** 0.5) / alpha * w[c, i]
                    n[c, i] += g * g
    expected = np.array([[weight(c, i) for i in [*range(30), langid.FEATURES]] for c in range(3)])
    assert np.allclose(got[:, [*range(30), langid.FEATURES]], expected)
    assert (expected == 0).sum() > 5 and (expected != 0).sum() > 5  # the penalty leaves zeros
    assert np.count_nonzero(got) == np.count_nonzero(expected)
    assert np.count_nonzero(langid.ftrl(rows, 3, alpha, beta, 1000.0, l2)) == 0


def test_language_sample_is_bounded_and_the_same_on_each_run(spark, sf, monkeypatch):
    docs = langid.training_rows(spark.read.parquet(f"{sf}/documents.parquet"))
    monkeypatch.setattr(langid, "MOST_ROWS", 40)
    one, two = langid.train(docs), langid.train(docs.repartition(7))
    assert np.array_equal(one.weights, two.weights) and one.temperature == two.temperature


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95
    odd = data.frame(spark)
    by = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert {by[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in by.values())
    stage = langid.accepted_documents(odd)
    assert stage.columns == odd.columns
    assert not {1000, 1001, 1002} & {r["doc_id"] for r in stage.collect()}
    assert langid.identify(data.empty(spark)).count() == 0


def test_texts_without_a_letter_beyond_the_basic_plane(spark):
    odd = [(2000, "\U0001F642" * 50, "en", "s"), (2001, "\U0001F389 2024!", "fr", "s"), (2002, "\U00010400\U00020000", "en", "s")]
    docs = data.frame(spark, data.rows() + odd)
    by = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [(by[k]["lang_pred"], by[k]["score"]) for k in (2000, 2001)] == [("und", 0.0)] * 2
    assert by[2002]["lang_pred"] != "und"  # Deseret and Han letters
    assert not {2000, 2001} & {r["doc_id"] for r in langid.accepted_documents(docs, 0.0).collect()}


def test_temperature():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3))
    logits[np.arange(4000), truth] += 1.0
    assert langid.temperature(logits * 5, truth) == pytest.approx(5, rel=0.15)


def test_tokenizer_equals_the_library():
    tokens = packing.tokenizer(queries.vocabulary())
    odd = ["a\tb c\xa0d", "don't it's I'LL x're", "İstanbul ΣΑΣ ς", "é a", "<|endoftext|> x<|startoftext|>y", "漢字 123 4a5", "²Ⅷ a__b", "\r\n\x0b", "naïve,“quoted”—dash…", "ﬁ ß ẞ", "x" * 500, *(t or "" for _, t, *_ in data.rows())]
    for t in odd:
        assert np.frombuffer(tokens.ids(t), "<u4").tolist() == tokens.whole.encode(t, add_special_tokens=False).ids, t[:60]


def test_tokenizer_keeps_words_that_come_again(monkeypatch):
    """A full cache loses no word that is met again soon, however many rare ones come between."""
    monkeypatch.setattr(packing, "_KEPT", 50)
    tokens = packing.WordTokenizer(queries.vocabulary())
    spelled = []
    letters = tokens._letters
    monkeypatch.setattr(tokens, "_letters", lambda word: spelled.append(word) or letters(word))
    rare = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(1000)]
    for at in range(0, len(rare), 20):
        text = "The common,  words " + " ".join(rare[at : at + 20])
        assert tokens.ids(text) == tokens._encode(text)
    assert all(spelled.count(w) <= 1 for w in ("the", "common", "words"))
    assert max(map(len, (tokens.words, tokens.older_words, tokens.bare, tokens.older_bare))) <= 50


def test_packing(spark):
    some = data.rows()
    tokens = packing.tokenizer(queries.vocabulary())
    most = 300
    got = packing.pack_documents(data.frame(spark, some), queries.vocabulary(), most).collect()
    expected = Counter()
    for id_, t, *_ in some:
        ids = tokens.ids(t or "") + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(ids), 4 * most)):
            part = ids[at : at + 4 * most]
            expected[id_, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    total = sum(r["length"] for r in got)
    assert len(by) <= 1.05 * -(-total // most) + 1
    assert packing.pack_documents(data.empty(spark), queries.vocabulary()).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_vector_bins_hold_every_capacity(rule):
    rng = random.Random(3)
    bins = packing.VectorBins(100, 4, 4000, (1.0, 1.0, 1.0), rule, 8)
    held = defaultdict(list)
    for n in sorted((rng.randint(1, 60) for _ in range(500)), reverse=True):
        held[bins.put(n)[0]].append(n)
    assert all(sum(x) <= 100 and len(x) <= 4 and sum(n * n for n in x) <= 4000 for x in held.values())


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_the_best_of_all_bins_that_fit_is_taken(rule):
    rng, weights, full = random.Random(5), (0.01, 1.0, 1.0), (100, 50, 2000)
    bins, left = packing.VectorBins(*full, weights, rule), {}

    def score(need, x):
        if rule == "dot":
            return -sum(w * (n / f) * ((f - r) / f) for w, n, f, r in zip(weights, need, full, x))
        return sum(w * ((r - n) / f) ** 2 for w, n, f, r in zip(weights, need, full, x))

    for n in [rng.randint(20, 40) for _ in range(200)] + [rng.randint(1, 9) for _ in range(300)]:
        need = (n, 1, n * n)
        fit = {b: score(need, x) for b, x in left.items() if all(r >= k for r, k in zip(x, need))}
        got, offset = bins.put(n)
        assert offset == full[0] - left.get(got, full)[0]
        assert got == len(left) if not fit else abs(fit[got] - min(fit.values())) < 1e-12
        left[got] = tuple(r - k for r, k in zip(left.get(got, full), need))


def test_packing_under_document_and_cost_capacities(spark):
    some = data.rows()
    for options in ({"max_documents": 3}, {"max_cost": 30_000}, {"max_documents": 4, "max_cost": 40_000, "rule": "dot", "tries": None}):
        got = packing.pack_documents(data.frame(spark, some), queries.vocabulary(), 300, **options).collect()
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        most, cost = options.get("max_documents", 300), options.get("max_cost", 300 * 300)
        lone = [p for p in by.values() if len(p) == 1]
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 300 and len(parts) <= most
            assert sum(n * n for _, n in parts) <= cost or len(parts) == 1  # a piece that exceeds it alone stands alone
        assert len(lone) < len(by)
        assert sum(r["length"] for r in got) == sum(len(packing.tokenizer(queries.vocabulary()).ids(t or "")) // 4 + 1 for _, t, *_ in some)


def test_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    import json
    import os

    found = [f for f in sorted(os.listdir(os.path.dirname(queries.vocabulary()))) if f.endswith(".json")]
    for name in found:
        path = queries.vocabulary(name)
        if "model" not in json.load(open(path)):
            continue
        tokens = packing.WordTokenizer(path)
        for t in ("Hello  World, don't stop", "naïve\tÄrger\n\nx", "plain"):
            assert np.frombuffer(tokens.ids(t), "<u4").tolist() == tokens.whole.encode(t, add_special_tokens=False).ids, name
