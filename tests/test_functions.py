"""Column functions against row-wise Python written from their definitions."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import metrics, text
from quillgraph.functions.vectors import cosine
from quillgraph.operators import generation


def rows(spark, values, names):
    return spark.createDataFrame(values, names)


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first()[0]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def py_anls(p, truths):
    best = 0.0
    for t in truths:
        a, b = p.strip().lower(), t.strip().lower()
        d = 0.0 if not a and not b else 1.0 if not a or not b else levenshtein(a, b) / max(len(a), len(b))
        best = max(best, 0.0 if d > 0.5 else 1 - d)
    return best


def py_norm(t):
    return " ".join(t.lower().translate(str.maketrans("", "", string.punctuation)).split())


def py_f1(p, truths):
    best = 0.0
    for t in truths:
        a, b = py_norm(p).split(), py_norm(t).split()
        common = sum(min(a.count(w), b.count(w)) for w in set(a))
        best = max(best, 2 * common / (len(a) + len(b)) if common else 0.0)
    return best


def test_metrics_on_random_strings(spark):
    rng = random.Random(1)
    parts = ["a", "b", "가", "나", " ", "B", ".", "!", "the", "12", "é", "\t"]
    make = lambda: "".join(rng.choices(parts, k=rng.randint(0, 8)))
    data = [(i, make(), [make() for _ in range(rng.randint(0, 3))]) for i in range(300)]
    df = spark.createDataFrame(data, "i int, p string, g array<string>")
    got = df.select("i", metrics.anls(F.col("p"), F.col("g")), metrics.exact_match(F.col("p"), F.col("g")), metrics.token_f1(F.col("p"), F.col("g"))).collect()
    for i, anls, exact, f1 in got:
        _, p, g = data[i]
        assert anls == pytest.approx(py_anls(p, g))
        assert exact == float(any(py_norm(t) == py_norm(p) for t in g))
        assert f1 == pytest.approx(py_f1(p, g))


def test_metric_samples(spark):
    assert one(spark, metrics.anls(F.col("p"), F.col("g")), p="kitten", g=["sitting"]) == pytest.approx(1 - 3 / 7)
    assert one(spark, metrics.anls(F.col("p"), F.col("g")), p="", g=[""]) == 1.0
    assert one(spark, metrics.token_f1(F.col("p"), F.col("g")), p="a b a", g=["a a a c"]) == pytest.approx(4 / 7)
    assert one(spark, metrics.relaxed_accuracy(F.col("p"), F.col("g")), p="1,234", g=["1200"]) == 1.0
    for said, letter in {"The answer is B": "B", "Answer: (c)": "C", "(D) because": "D", "b": "B", "zz A zz": "A", "h?": "H", "the answer depends": "D", "zzz": ""}.items():
        assert one(spark, metrics.mcq_letter(F.col("p")), p=said) == letter, said
    for said, answer in {r"so \boxed{42} it is": "42", "ANSWER: x y\nz": "x y", "Therefore, five.": "five", "first\n\nlast ": "last", "": ""}.items():
        assert one(spark, metrics.final_answer(F.col("p")), p=said) == answer, said


def test_crossdoc(spark):
    data = [("", ["x"]), ("has 12 and 13", ["about 12, 13"]), ("only 12 here", ["about 12, 13"]), ("networks learned features", ["networks learned nothing features"]), ("zzzz", ["abcd"]), ("abcdefgh", ["abcdefgx"]), ("inside", ["it is inside here"])]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, p string, g array<string>")
    got = {r["i"]: (round(r["crossdoc"]["score"], 4), r["crossdoc"]["method"]) for r in metrics.with_crossdoc_score(df, F.col("p"), F.col("g")).collect()}
    assert got == {0: (0.0, "empty"), 1: (1.0, "num_exact"), 2: (0.7, "num_partial"), 3: (round(2 * 25 / 58, 4), "seq"), 4: (0.0, "no_match"), 5: (0.875, "seq"), 6: (1.0, "contain")}


def test_ratios_and_edits_equal_their_definitions():
    import random
    from difflib import SequenceMatcher

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng, pairs = random.Random(3), []
    for k in range(1500):
        letters = ("ab", "abcdefg ", "aé漢\U0001f642")[k % 3]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 64)))
        b = a[rng.randint(0, 3) :] + "xy" if k % 2 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 230)))
        assert metrics.sequence_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
        pairs.append((a, b))
    assert metrics.edits_of(pairs).tolist() == [edits(a, b) for a, b in pairs] and metrics.edits_of([]).tolist() == []


def test_scores_of_many_rows_equal_their_expressions(spark):
    import random

    from quillgraph.operators import evaluation

    rng = random.Random(11)
    words = ["a", "A", "b.", "--", "", "é", "É", "\u3000", "\xa0x", "\x85", "\u2003", "漢字", "\U0001f642", "ab-c", "the", "İ", "ΣΑΣ", "\n", "\x1c", "long" * 20]
    make = lambda k: rng.choice([" ", "  ", "\t"]).join(rng.choice(words) for _ in range(rng.randint(0, k)))
    rows = []
    for i in range(5000):
        p = make(12 if i % 7 else 60)
        g = [rng.choice([p, p.upper(), p[1:], p[: len(p) // 2] + " and", make(9), None]) for _ in range(rng.randint(0, 3))]
        rows.append((i, rng.choice([p] * 9 + [None]), g if i % 11 else None, "VQA"))
    df = spark.createDataFrame(rows, "i int, prediction string, ground_truths array<string>, question_type string").coalesce(1)
    p, g = F.col("prediction"), F.col("ground_truths")
    got = evaluation.scored(df)
    assert got.columns == [*df.columns, "anls", "accuracy", "f1"]
    here, there = (
        sorted(x.collect())
        for x in (got.select("i", "anls", "accuracy", "f1"), df.select("i", metrics.anls(p, g), metrics.exact_match(p, g), metrics.token_f1(p, g)))
    )
    assert here == there
    compared = "ArrowEvalPython"
    plan = got.select("f1")._jdf.queryExecution().executedPlan().toString()
    assert compared in plan and "_distances" not in plan and "regexp_replace" not in plan  # one pass over batches, and only what is asked for


def test_pieces(spark):
    for t in ("", "abc", "abcdef", "ab\ncdé\U0001f642g"):
        got = one(spark, text.in_pieces(F.col("t"), 3, 2), t=t)
        assert got == [t[i : i + 5] for i in range(0, max(1, len(t)), 3)], t


def test_korean_vqa(spark):
    score = lambda p, g, k="": one(spark, metrics.korean_vqa_accuracy(F.col("p"), F.col("g"), F.col("k")), p=p, g=g, k=k)
    assert score("1,234.50 원", "답은 1234.5 입니다") == 1.0
    assert score("서울", "서울입니다") == 1.0
    assert score("전혀 다른 답", "부산항의 물동량") == 0.0
    assert score("", "x") == 0.0


def test_sections_and_references(spark):
    for t, (title, depth) in {"2.1 Methods": (True, 2), "2. X": (True, 2), "2020 results": (True, 1), "Abstract": (True, 1), "RESULTS AND MORE": (True, 1), "A" * 60: (False, 1), "plain text": (False, 1), "123": (False, 1)}.items():
        assert one(spark, text.is_section_title(F.col("t")), t=t) is title, t
        assert one(spark, text.section_depth(F.col("t")), t=t) == depth, t
    refs = lambda t, kind="Figure", korean=False: one(spark, text.references(F.col("t"), kind, korean), t=t)
    assert refs("see Fig. 1 and Figure 3a, figs 4") == ["1", "3a", "4"]
    assert refs("Fig. 1에서") == []
    assert refs("Fig. 1에서, 그림 2", korean=True) == ["2"]
    assert refs("Eq. (3) and equation 4", "Equation") == ["3", "4"]
    assert refs("도표 3", "Table", True) == ["3"]


def test_clean_text(spark):
    clean = lambda t, n=0: one(spark, text.clean_content(F.col("t"), n), t=t)
    assert clean("<table><tr><td>a</td><td>b  c</td></tr><tr><td>d</td></tr></table>") == "a | b c\nd"
    assert clean("  a \n b ") == "a b"
    assert clean("abcdef", 3) == "abc…"
    question = lambda t: one(spark, text.clean_question(F.col("t")), t=t)
    assert question("```\n**질문:** 1. 이것은 무엇인가요?\n설명\n```") == "이것은 무엇인가요?"
    assert question("Which one?\nA) x\nB) y\n정답: A") == "Which one?\nA) x\nB) y"
    assert question("짧") == ""
    assert one(spark, text.clean_answer(F.col("t")), t='답변: "좋아요"') == "좋아요"
    assert one(spark, text.strip_caption_label(F.col("t")), t="<그림 2> 결과") == "결과"
    assert one(spark, text.label_kind(F.col("t")), t="Table 3. x") == "table"
    assert one(spark, text.particle(F.col("t"), "은", "는"), t="그림") == "은"
    assert one(spark, text.particle(F.col("t"), "은", "는"), t="표") == "는"
    assert one(spark, text.language(F.col("t")), t="한국어 " * 30) == "ko"
    assert one(spark, text.concept_lines(F.col("t")), t="- first idea\n\n* second idea\nno\n•third idea\nfourth idea") == ["first idea", "second idea", "third idea"]
    assert one(spark, text.relation(F.col("t")), t="it supports this") == "SUPPORTS"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]


def test_patterns_compile():
    for p in (text.QUESTION_PREFIX, text.ANSWER_PREFIX, text.BULLET):
        re.compile(p.replace("(?iU)", "(?i)").replace("(?U)", ""))


def test_templates_are_filled_at_once(spark):
    values = {"a": F.lit("{b} {a}"), "b": F.lit("{a}")}
    row = spark.range(1).select(text.fill("x {a}, {b}{{a}}", values).alias("x"), text.fill("", values).alias("none"), text.fill("{a}{c}", values, missing=F.lit("-")).alias("missing")).first()
    assert tuple(row) == ("x {b} {a}, {a}{a}", "", "{b} {a}-")
    with pytest.raises(KeyError):
        text.fill("{c}", values)
    with pytest.warns(UserWarning, match="nope"):
        assert generation.known_names("{a} {nope}", {"a"}, "{a}") == "{a}"


def test_outputs_are_cleaned_in_one_pass(spark):
    raws = spark.createDataFrame([("- **A** thing?",)], "raw string")
    for clean, patterns in ((text.clean_question, (text.FENCE, text.BULLET)), (text.clean_answer, (text.FENCE, text.ANSWER_PREFIX))):
        plan = raws.select(clean(F.col("raw")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
        # a question's bullets are taken off either of all lines or of the first
        assert [plan.count(p) for p in patterns] == [1, 2 if clean is text.clean_question else 1]
