"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source has a target number of words.  A document's expected copies are target / source size; the whole part is
certain, the fraction is a probability.  Probabilities are rounded in pairs: mass in words moves from one document to
the other, at random in the direction that keeps both expectations, until one of them is 0 or 1; the other goes on to
the next pair.  The words of a pair never change, so a block of documents keeps its words up to one residual document.
Residuals of the blocks are combined level by level in a tree, until one document of a source is left and rounded.

Documents are paired largest first, so that large ones settle against each other and the residual one is small.  A
source's words miss its target by less than its largest document.  Blocks hold about `block` documents by a hash, so a
source of any size is spread over many tasks, and the tree's random numbers are hashes too: reruns agree.  Repeated rows
are told apart by their number among equal rows.

Defined results: a null text has size 0; null sources are one source, placed last; documents of size 0 take nothing; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, doc_key, own_names, staged

WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per source: source, source_size, n_docs, target.

    Targets are min(most * size, weight * level).  With sources sorted by the level at which they reach their cap, the
    level that the sources from each on would share rises up to the common one and falls after it.  The windows run
    over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole) * F.lit(share)
    level = F.max("level").over(whole)
    return (
        ranked.withColumn("level", (total - before) / rest)
        .withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("weight") * level)))
        .select("source", "source_size", "n_docs", "target")
    )


def _pair(state: Column, new: Column) -> Column:
    """One pivotal step: the state holds the open document and the settled ones; new is a document with 0 < p < 1."""
    old = state["open"]
    ratio = new["size"] / old["size"]  # mass that the old one gains for each unit that the new one loses
    up = F.least(1 - old["p"], new["p"] * ratio)  # old rises, new falls
    down = F.least(old["p"], (1 - new["p"]) * ratio)  # old falls, new rises
    rises = new["u"] * (up + down) < down
    shift = F.when(rises, up).otherwise(-down)
    old_p, new_p = old["p"] + shift, new["p"] - shift / ratio
    old_ends = F.when(rises, 1 - old["p"] <= new["p"] * ratio).otherwise(old["p"] <= (1 - new["p"]) * ratio)
    ended = F.when(old_ends, old.withField("p", F.when(rises, 1.0).otherwise(0.0))).otherwise(new.withField("p", F.when(rises, 0.0).otherwise(1.0)))
    goes_on = F.when(old_ends, new.withField("p", new_p)).otherwise(old.withField("p", old_p))
    return F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(
        F.struct(goes_on.alias("open"), F.concat(state["done"], F.array(ended)).alias("done"))
    )


def copies(sized: DataFrame, keys: list[str], share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = 256, seed: int = 11) -> DataFrame:
    """A row per input row: keys, source, size, source_size, target, copies (int).

    sized: keys, source and size (long).  A block's documents are collected, about `block` of them by construction.
    """
    sized = staged(sized.select(*keys, "source", "size"), "sizes")
    shares = staged(targets(sized, share, most, weights), "targets")
    equal = sized.groupBy(*keys, "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = equal.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    shares = shares.withColumnRenamed("source", "source_")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        rows.join(shares, rows["source"].eqNullSafe(shares["source_"]))
        .withColumn("whole", F.floor(expected).cast("int"))
        .withColumn("p", expected - F.floor(expected))
        .withColumn("h", F.xxhash64(*[c for k in (*keys, "source") for c in (F.col(k), F.col(k).isNull())], "size", "copy", F.lit(seed)))
        .withColumn("leaf", F.pmod(F.col("h"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(block)))))
    )
    settled = (F.col("p") <= 0) | (F.col("size") == 0)
    base = ["source", "source_size", "target", "whole"]
    item = ["size", "h", *keys]
    shape = [*keys, *base, "size", "p"]
    rows = staged(rows.select(*shape, "h", "leaf", settled.alias("settled")), "fractions")
    done = [rows.where("settled").select(*shape[:-1], F.lit(0.0).alias("p"))]
    open_ = rows.where(~F.col("settled")).select(*shape, "h", "leaf")
    level, leaves = 0, open_.agg(F.max("leaf")).first()[0]
    while leaves is not None:
        u = F.pmod(F.xxhash64("h", F.lit(seed), F.lit(level)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        one = F.struct(*item, "p", u.alias("u"))
        groups = open_.groupBy(*base, "leaf").agg(F.sort_array(F.collect_list(one), False).alias("items"))
        kind = dict(groups.dtypes)["items"]
        start = F.struct(F.lit(None).cast(kind[6:-1]).alias("open"), F.array().cast(kind).alias("done"))
        state = F.aggregate("items", start, _pair)
        groups = groups.withColumn("state", state).select(*base, "leaf", F.col("state.done").alias("done"), F.col("state.open").alias("open"))
        groups = groups.withColumn("one", F.explode(F.concat(F.transform("done", lambda x: F.struct(x.alias("v"), F.lit(True).alias("ended"))), F.array(F.struct(F.col("open").alias("v"), F.lit(False).alias("ended"))))))
        flat = groups.select(*base, "leaf", "one.ended", *[F.col(f"one.v.{c}").alias(c) for c in (*item, "p", "u")])
        if leaves == 0:  # one document of each source is left
            done.append(flat.select(*shape[:-1], F.when(F.col("ended"), F.col("p")).otherwise((F.pmod(F.xxhash64("h", F.lit(seed), F.lit(-1)), F.lit(1 << 52)) / F.lit(float(1 << 52)) < F.col("p")).cast("double")).alias("p")))
            break
        flat = staged(flat, f"level{level}")
        done.append(flat.where("ended").select(*shape))
        open_ = flat.where(~F.col("ended")).select(*shape, "h", F.floor(F.col("leaf") / F.lit(block)).alias("leaf"))
        leaves //= block
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*keys, "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    got = copies(sized, ["doc_id"], **options)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken, with the input's columns.

    Rows are named by doc_id, text and source.  Of rows that are equal in all three some may get a copy more than the
    others; which of them do is decided by their number, and all that is kept of them is how many.
    """
    plain = own_names(docs, ("doc_id", "text", "source"))
    keyed = plain.select("*", F.coalesce("doc_id", F.lit(0)).alias("id"), doc_key("doc_id", "text", "source").alias("key"))
    sized = keyed.select("id", "key", "source", words(F.col("text")).alias("size"))
    got = copies(sized, ["id", "key"], **options)
    taken = got.groupBy("id", "key").agg(F.min("copies").alias("least"), F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("rows"))
    # copies of equal rows differ by at most one
    taken = taken.select("id", "key", "least", (F.col("sum") - F.col("least") * F.col("rows")).alias("more"))
    number = F.row_number().over(Window.partitionBy("id", "key").orderBy("key"))
    joined = keyed.join(taken, ["id", "key"]).withColumn("number", F.when(F.col("more") > 0, number).otherwise(F.lit(1)))
    times = F.array_repeat(F.lit(1), (F.col("least") + (F.col("number") <= F.col("more")).cast("int")).cast("int"))
    return joined.select(*plain.columns, F.explode(times).alias("one")).drop("one").toDF(*docs.columns)
