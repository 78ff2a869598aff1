"""Small documents with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, key string, kept string, score double, cluster int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(40, 120)) for _ in range(n)]
    passage = words(rng, 60)
    out = []
    for i, t in enumerate(base):
        if i % 6 == 1:
            t = base[i - 1]  # an exact copy
        elif i % 6 == 2:
            w = base[i - 2].split()
            w[rng.randrange(len(w))] = "changed"  # a near copy
            t = " ".join(w)
        elif i % 6 == 3:
            t = f"{t}\n{passage}  {words(rng, 5)}"
        out.append((i, t, rng.choice(["en", "fr"]), rng.choice(["s1", "s2", None])))
    out += [
        (1000, None, "en", "s1"),
        (1001, "", None, "s2"),
        (1002, " \t\n\r\x0b\x0c ", "en", None),
        (1003, "one", "fr", "s1"),
        (1004, "a b c d", "fr", "s1"),
        (1005, "a b c d", "en", "s1"),
        (1006, " ".join(["same"] * 90), "en", "s2"),
        (1007, words(rng, 20000), "en", "s1"),
        (1008, "é漢字 <|im_end|> 🙂  x" * 30, None, None),
        (1009, base[0], "en", "s1"),
        (1009, base[0], "en", "s1"),
        (1009, base[4], "en", "s1"),
        (None, base[5], "en", "s2"),
        (None, None, None, None),
    ]
    rng.shuffle(out)
    return out


def frame(spark, some=None):
    some = rows() if some is None else some
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, "n", "k", "x", 0.5, 2) for r in some]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
