"""When to train, how training went, and which checkpoint is best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fill
from .order import scanned
from ..schema import QUESTION_TYPES
from .pairs import is_valid

FIRST_PAIRS, RETRAIN_PAIRS, PAIRS_PER_TYPE = 150, 100, 10
METRICS = ("anls", "accuracy", "f1")


def type_shortfall(valid: DataFrame, least: int = PAIRS_PER_TYPE, guarded: tuple[str, ...] = ()) -> DataFrame:
    """question_type and the pairs that it lacks.  Without guarded types, types with a pair are guarded."""
    counts = valid.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"))
    known = valid.sparkSession.createDataFrame([(t,) for t in guarded or QUESTION_TYPES], "question_type string")
    joined = known.join(counts, "question_type", "left" if guarded else "inner").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.where((F.col("n") < least) & F.lit(least > 0)).select("question_type", (F.lit(least) - F.col("n")).alias("shortfall"))


def decision(active: DataFrame, since_last_train: int, train_count: int, first: int = FIRST_PAIRS, retrain: int = RETRAIN_PAIRS, least: int = PAIRS_PER_TYPE, guarded: tuple[str, ...] = ()) -> DataFrame:
    """One row: should_train, reason (count, type or ready), since, threshold, remaining, n_valid, is_first, progress."""
    valid = active.where(is_valid(F.col("chosen"), F.col("rejected")))
    threshold = first if train_count == 0 else retrain
    lacking = type_shortfall(valid, least, guarded).agg(F.count(F.lit(1)).alias("lacking"))
    row = valid.agg(F.count(F.lit(1)).alias("n_valid")).crossJoin(lacking)  # one row each
    since = F.least(F.lit(since_last_train).cast("bigint"), F.col("n_valid"))
    enough = since >= threshold
    return row.select(
        (enough & (F.col("lacking") == 0)).alias("should_train"),
        F.when(~enough, "count").when(F.col("lacking") > 0, "type").otherwise("ready").alias("reason"),
        since.alias("since"), F.lit(threshold).alias("threshold"), F.greatest(F.lit(0).cast("bigint"), threshold - since).alias("remaining"),
        "n_valid", F.lit(train_count == 0).alias("is_first"), progress(since, threshold).alias("progress"),
    )


def progress(since: Column, threshold: int) -> Column:
    return F.least(F.lit(1.0), since / threshold) if threshold > 0 else F.lit(1.0)


# How a decision is shown.
READY, COLLECTING, FIRST_TIME, AGAIN = "✅ **학습 조건 충족**", "⏳ 수집 중", "첫 학습", "재학습"
SHOWN, BAR_CELLS = "{head} — {reason}\n\n{label}까지 `{bar}` {since}/{threshold}  (**{remaining}건 남음**)", 20


def shown(decisions: DataFrame) -> DataFrame:
    """Decisions with `markdown`: the state, a bar of 20 cells, and what is still missing."""
    filled = F.floor(F.col("progress") * BAR_CELLS).cast("int")
    values = {
        "head": F.when(F.col("should_train"), READY).otherwise(COLLECTING), "reason": F.col("reason"), "label": F.when(F.col("is_first"), FIRST_TIME).otherwise(AGAIN),
        "bar": F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), BAR_CELLS - filled)), "since": F.col("since").cast("string"),
        "threshold": F.col("threshold").cast("string"), "remaining": F.col("remaining").cast("string"),
    }
    return decisions.withColumn("markdown", fill(SHOWN, values))


def comparison_stats(comparisons: DataFrame) -> DataFrame:
    """checkpoint (null for all), n, wins, base_wins, ties, win_rate; unknown verdicts count in n alone."""
    verdict = F.lower("verdict")
    wins, base, ties = (F.count_if(verdict == v) for v in ("trained", "base", "tie"))
    rows = comparisons.withColumn("checkpoint", F.coalesce("checkpoint", F.lit("?")))
    rate = F.round(F.try_divide(F.col("wins").cast("double"), (F.col("wins") + F.col("base_wins")).cast("double")), 4)
    return rows.rollup("checkpoint").agg(F.count(F.lit(1)).alias("n"), wins.alias("wins"), base.alias("base_wins"), ties.alias("ties")).withColumn("win_rate", rate)


def score(evaluation: Column, metric: str = "mean") -> Column:
    """A checkpoint's score: one metric, or the mean of those of the three that it has; null without any."""
    if metric != "mean":
        return F.try_element_at(evaluation, F.lit(metric))
    values = F.filter(F.array(*[F.try_element_at(evaluation, F.lit(m)) for m in METRICS]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(values), F.lit(0)))


def best_checkpoint(history: DataFrame, metric: str = "mean") -> DataFrame:
    """checkpoint and score of the best; of equal scores the later name."""
    scored = history.select("checkpoint", F.round(score(F.col("eval"), metric), 4).alias("score")).where("score is not null")
    return scored.agg(F.max(F.struct("score", "checkpoint")).alias("best")).where("best is not null").select("best.checkpoint", "best.score")


def with_adapters(ranked: DataFrame, adapters: DataFrame) -> DataFrame:
    """Checkpoints with `exists`: whether an adapter of their name is there."""
    there = adapters.select(F.col("name").alias("checkpoint")).distinct().withColumn("exists", F.lit(True))
    return ranked.join(there, "checkpoint", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def metric_series(history: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return history.select("seq", "checkpoint", "loss", *[F.try_element_at("eval", F.lit(m)).alias(m) for m in metrics])


def metric_rows(history: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row for each metric that a checkpoint has."""
    return metric_series(history, metrics).unpivot(["seq", "checkpoint"], list(metrics), "metric", "value").where("value is not null")


def version_label(path: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("base"))


def margin(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """Log-probabilities (policy and reference, chosen and rejected) with logits and the stable log-sigmoid loss."""
    logits = F.lit(beta) * ((F.col("policy_chosen") - F.col("policy_rejected")) - (F.col("ref_chosen") - F.col("ref_rejected")))
    loss = F.greatest(-F.col("logits"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("logits")))
    return rows.withColumn("logits", logits).withColumn("loss", loss)


def loss_summary(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row: n, mean loss over the effective steps, and the share of pairs whose chosen answer is preferred."""
    return margin(rows, beta).agg(F.count("loss").alias("n"), F.avg("loss").alias("mean_loss"), F.avg((F.col("logits") > 0).cast("double")).alias("reward_accuracy"))


def loss_curve(rows: DataFrame, run: list[str], every: int = 10, beta: float = 0.1) -> DataFrame:
    """The running loss at every `every`-th step of each run; the sum is over the step number, skipped steps included."""
    curve = scanned(margin(rows, beta), run, ["step"], {"so_far": F.coalesce("loss", F.lit(0.0))}).withColumn("running_loss", F.col("so_far") / F.col("step"))
    return curve.where(F.col("step") % every == 0).select(*run, "step", "running_loss")
