"""The preference-pair log: latest state, validation, duplicates, numbering, statistics and export.

The log is append-only; a later row of a pair replaces an earlier one, and status 'deleted' is a tombstone.  All
operators are one pass over the log or one aggregate by pair: nothing rescans the log for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze, strip, text
from ..schema import QUESTION_TYPES
from .order import numbered

PAIR_PREFIX, ADAPTER_PREFIX = "kdpo_", "adapter_epoch"


def latest_state(log: DataFrame, key: str = "pair_id", order: str = "log_seq", include_deleted: bool = False) -> DataFrame:
    """The last row of each pair, with `first_seq`, the place of its first row, by which pairs are listed."""
    last = F.max_by(F.struct(*log.columns), F.col(order)).alias("last")
    out = log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_key")).agg(last, F.min(order).alias("first_seq")).select("last.*", "first_seq")
    return out if include_deleted else out.where("status = 'active'")


def is_valid(chosen: Column, rejected: Column) -> Column:
    c, r = strip(text(chosen)), strip(text(rejected))
    return (c != "") & (r != "") & (c != r)


def first_error(language: str, files: Column | None = None) -> Column:
    """Why a pair may not be stored, by the first rule that it breaks, or null.  files: the image paths that exist."""
    missing = F.lit(False) if files is None else F.size(F.array_except(F.coalesce("image_paths", F.array().cast("array<string>")), files)) > 0
    return (
        F.when(text(F.col("question")) == "", "question is empty")
        .when((text(F.col("chosen")) == "") | (text(F.col("rejected")) == ""), "chosen or rejected is empty")
        .when(F.col("chosen") == F.col("rejected"), "chosen equals rejected")
        .when(~F.col("lang").eqNullSafe(F.lit(language)), "language differs from the configured one")
        .when(~F.coalesce(F.col("question_type").isin(*QUESTION_TYPES), F.lit(False)), "question type is not allowed")
        .when(missing, "an image path is not valid")
    )


def chosen_texts(rows: DataFrame) -> DataFrame:
    """Rows with candidates and two indices: chosen and rejected are the stripped candidates, null where an index is out of bounds.

    What the rows had as chosen and rejected stays as given_chosen and given_rejected.
    """
    at = lambda c: F.when(F.col(c) >= 0, strip(F.get("candidates", F.col(c))))
    given = {f"given_{c}": F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("chosen", "rejected")}
    return rows.withColumns(given).withColumn("chosen", at("chosen_idx")).withColumn("rejected", at("rejected_idx"))


def dedup_key(question: Column, chosen: Column, rejected: Column) -> Column:
    """Equal for pairs that differ in white space only."""
    return F.sha2(F.concat_ws("\x1f", *[squeeze(text(c)) for c in (question, chosen, rejected)]), 256)


def duplicates(active: DataFrame, order: str = "first_seq") -> DataFrame:
    """pair_id and duplicate_of, the first pair in the log of the same content."""
    key = dedup_key(F.col("question"), F.col("chosen"), F.col("rejected"))
    keyed = active.select("pair_id", F.col(order).alias("place"), key.alias("key"))
    first = keyed.groupBy("key").agg(F.min_by("pair_id", "place").alias("duplicate_of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(first, "key").where("pair_id <> duplicate_of").select("pair_id", "duplicate_of")


def next_number(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the largest number among ids of a prefix, and one more (tombstones count)."""
    number = F.regexp_extract(F.col(column), rf"^{prefix}(\d+)$", 1).try_cast("bigint")
    return ids.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def added(log: DataFrame, new: DataFrame, language: str = "ko", order: str = "log_seq") -> DataFrame:
    """The rows to append for new pairs: valid ones that repeat neither the log nor each other, numbered on.

    new has a `seq` that orders it; places in this order come from ranges and their sizes.
    """
    active = latest_state(log, order=order)
    key = dedup_key(F.col("question"), F.col("chosen"), F.col("rejected"))
    picked = chosen_texts(new)  # indices name candidates, where a row has them
    by_index = F.col("chosen_idx").isNotNull() & F.col("rejected_idx").isNotNull() & (F.coalesce(F.size("candidates"), F.lit(0)) > 0)
    new = picked.withColumns({c: F.when(by_index, F.col(c)).otherwise(F.col(f"given_{c}")) for c in ("chosen", "rejected")}).drop("given_chosen", "given_rejected")
    fresh = new.where(first_error(language).isNull()).withColumn("key", key)
    fresh = fresh.join(active.select(key.alias("key")).distinct(), "key", "left_anti")
    fresh = fresh.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where("copy = 1")
    start = next_number(log, "pair_id", PAIR_PREFIX)
    out = numbered(fresh, ["seq", "key"], "at").crossJoin(start)  # one row
    out = out.withColumn("pair_id", F.concat(F.lit(PAIR_PREFIX), F.lpad((F.col("next_number") + F.col("at")).cast("string"), 6, "0"))).withColumn("status", F.lit("active"))
    return out.drop("key", "copy", "at", "next_number", "seq")


def tombstones(log: DataFrame, ids: DataFrame, reason: str = "", order: str = "log_seq") -> DataFrame:
    """The rows to append to delete pairs (pair_id) that are active."""
    note = F.concat_ws(" | ", F.nullif(text(F.col("notes")), F.lit("")), F.lit(f"deleted: {reason}" if reason else "deleted"))
    gone = latest_state(log, order=order).join(ids.select("pair_id").distinct(), "pair_id", "left_semi")
    return gone.withColumn("status", F.lit("deleted")).withColumn("notes", note).drop("first_seq")


def counts_by_type(active: DataFrame, types: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """question_type and n, zeros included."""
    known = active.sparkSession.createDataFrame([(t,) for t in types], "question_type string")
    found = active.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"))
    return known.join(found, "question_type", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pair(log: DataFrame, pair_id: str, order: str = "log_seq") -> DataFrame:
    """The latest row of one pair, deleted or not."""
    return latest_state(log.where(F.col("pair_id") == pair_id), order=order, include_deleted=True)


def statistics(state: DataFrame, dimensions: tuple[str, ...] = ("question_type", "question_source", "model_version", "difficulty")) -> DataFrame:
    """dimension, value and n of the latest state (deleted rows included): totals, and counts of active pairs by each dimension."""
    active = F.col("status") == "active"
    has_image = F.coalesce(F.size("image_paths"), F.lit(0)) > 0
    totals = state.agg(F.count_if(active).alias("total"), F.count_if(~active).alias("deleted"), F.count_if(active & has_image).alias("with_image"))
    out = totals.select(F.expr("stack(3, 'total', total, 'deleted', deleted, 'with_image', with_image)").alias("dimension", "n")).select("dimension", F.lit(None).cast("string").alias("value"), "n")
    values = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")
    return out.unionByName(state.where(active).select(values).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n")))


def export_flat(active: DataFrame, field_map: dict[str, str] | None = None) -> DataFrame:
    """image (the first, or empty), question, chosen, rejected; renamed by the field map."""
    out = active.select(F.coalesce(F.get("image_paths", F.lit(0)), F.lit("")).alias("image"), "question", "chosen", "rejected")
    return out.withColumnsRenamed(field_map or {})


def _message(role: str, *content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), F.concat(*content).alias("content")))


def export_chat(active: DataFrame, field_map: dict[str, str] | None = None) -> DataFrame:
    """images, and prompt, chosen and rejected as chat messages."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    words = lambda c: F.array(part("text", text(F.col(c))))
    images = F.coalesce("image_paths", F.array().cast("array<string>"))
    pictures = F.transform(images, lambda x: part("image", F.lit(None).cast("string")))
    out = active.select(images.alias("images"), _message("user", pictures, words("question")).alias("prompt"), _message("assistant", words("chosen")).alias("chosen"), _message("assistant", words("rejected")).alias("rejected"))
    return out.withColumnsRenamed(field_map or {})


#: Under the names that shared files carry, and short ones.
EXPORTS = {"rlaif_v": export_flat, "hf_conversational": export_chat, "flat": export_flat, "chat": export_chat}


def export(active: DataFrame, form: str, field_map: dict[str, str] | None = None) -> DataFrame:
    if form not in EXPORTS:
        raise ValueError(f"unknown export format {form!r}; known are {sorted(EXPORTS)}")
    return EXPORTS[form](active, field_map)


def exported_images(active: DataFrame) -> DataFrame:
    """pair_id, path and the name that a copy of the image gets: PAIR[_INDEX].EXT; indices count missing files too."""
    flat = active.select("pair_id", F.posexplode("image_paths").alias("at", "path"))
    ending = F.regexp_extract("path", r"(\.[^./\\]+)$", 1)
    return flat.select("pair_id", "path", F.concat("pair_id", F.when(F.col("at") > 0, F.concat(F.lit("_"), F.col("at").cast("string"))).otherwise(""), ending).alias("name"))


def matching_question(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Questions (id, question) with the first candidate (seq, question, ...) of the same words."""
    key = squeeze(text(F.col("question")))
    others = [c for c in candidates.columns if c != "question"]
    first = candidates.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct(*others), "seq").alias("match"))
    return asked.withColumn("key", key).join(first, "key", "left").drop("key")


def training_pairs(active: DataFrame, limit: int | None = None, order: str = "first_seq") -> DataFrame:
    """Valid pairs in log order, the last `limit` of them."""
    good = active.where(is_valid(F.col("chosen"), F.col("rejected")))
    return good.orderBy(F.desc(order)).limit(limit).orderBy(order) if limit else good.orderBy(order)


def usable_bundle(candidates: Column) -> Column:
    """At least two different candidates that are not blank."""
    return F.size(F.array_distinct(F.filter(F.transform(candidates, strip), lambda x: x != ""))) >= 2


def best_generations(outputs: DataFrame, n: int, cleaned: Column) -> DataFrame:
    """The first n different non-empty outputs (id, attempt, raw) of each id, in order of attempt."""
    clean = outputs.withColumn("text", cleaned).where("text <> ''").withColumn("key", F.regexp_replace("text", r"(?U)\s+", ""))
    first = clean.groupBy("id", "key").agg(F.min("attempt").alias("attempt"), F.min_by("text", "attempt").alias("text"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("attempt"))
    return first.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "attempt", "text")
