"""Collecting preference pairs: a configuration's graph, pair log, counters, training and exports, as the steps of one object.

Tables stay DataFrames.  Only what a person looks at comes to the driver: a decision, a paper's name, a configuration.
Models and trainers are plug-ins; a trainer gets the valid pairs as a DataFrame and gives a record of what it did.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import enrichment, evaluation, generation, graph, pairs, paths, training
from ..operators.enrichment import Backend
from ..schema import COMPARISONS, PAIRS
from ..sources import config as settings
from ..sources import files, layout
from ..sources.scratch import staged
from ..sources.state import Counters, read_json, restore, stamp
from ..streaming import logs
from . import corpus
from .evaluation_set import identical

#: Gets the valid pairs in order, the training section and a callback (step, loss); gives checkpoint, loss, step, adapter and the like.
Trainer = Callable[[DataFrame, dict, Callable[[int, float], None]], dict]
HELD_OUT, LANGUAGES = "split = 'held_out'", "paper_id string, language string"


@dataclass
class Collection:
    """paths: data_root, pairs, state, graph, and optionally languages, split, history, comparisons, eval, export."""

    spark: SparkSession
    config: dict
    models: dict[str, Callable[[], Backend]] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str, overrides: dict | None = None, models: dict[str, Callable[[], Backend]] | None = None) -> Collection:
        """From a configuration file; one with errors is refused."""
        config = settings.load(path, overrides)
        if errors := settings.checked(config).errors:
            raise ValueError("; ".join(errors))
        return cls(spark, config, models or {})

    def section(self, name: str) -> dict:
        return self.config.get(name) or {}

    def place(self, name: str) -> str:
        """A configured path; places that are not configured stand beside the pair log."""
        own = self.section("paths")
        return own.get(name) or f"{own['pairs'].rstrip('/')}_{name}"

    @property
    def language(self) -> str:
        return self.config.get("language", "ko")

    @property
    def counters(self) -> Counters:
        return Counters(self.place("state"))

    def _there(self, name: str) -> bool:
        return files.exists(self.spark, self.place(name))

    # Papers and their graph.

    def languages(self) -> DataFrame:
        """paper_id and language; papers that were not looked at yet are, and are remembered: no layout is read twice.

        Layouts come as a stream that keeps its listing, so names of papers stay in its files and tasks.
        """
        path, root = self.place("languages"), self.section("paths")["data_root"]
        new = layout.source_stream(self.spark, root, self.place("listing"))
        logs.languages(new, path, self.place("languages_checkpoint")).awaitTermination()
        there = self._there("languages")
        return self.spark.read.schema(LANGUAGES).parquet(path) if there else self.spark.createDataFrame([], LANGUAGES)

    def split(self, held_out: int = evaluation.HELD_OUT, seed: int = 42) -> DataFrame:
        """paper_id and split, as first drawn; later papers are collected."""
        papers, path = layout.list_papers(self.spark, self.section("paths")["data_root"]), self.place("split")
        if not self._there("split"):
            files.write_split(evaluation.split(papers, held_out, seed), path)
        known = files.read_split(self.spark, path)
        if not papers.join(known, "paper_id", "left_anti").isEmpty():
            files.write_split(staged(evaluation.extended_split(known, papers), "split"), path)  # it reads what it replaces
            known = files.read_split(self.spark, path)
        return known

    def papers(self) -> DataFrame:
        """The papers to collect from: of the configured language, not held out."""
        limit = int(self.section("kg").get("max_papers") or 0) or None
        own = self.split()
        return evaluation.collectable(own, self.languages(), self.section("kg").get("language"), own.where(HELD_OUT), limit)

    def next_paper(self, paper_id: str, step: int = 1) -> str | None:
        row = evaluation.step_paper(self.papers(), step).where(F.col("paper_id") == paper_id).select("next_paper_id").first()
        return row[0] if row else None

    def graph(self, rebuild: bool = False, options: corpus.Options | None = None, embeddings: DataFrame | None = None, responses: corpus.Responses | None = None) -> tuple[DataFrame, DataFrame]:
        """The stored graph; it is built where there is none."""
        kept, path = self.section("kg").get("store", "parquet"), self.place("graph")
        if rebuild or not self._there("graph"):
            root = self.section("paths")["data_root"]
            elements = layout.with_images(layout.parsed(self.spark, root, self.section("kg").get("parser", "layout")), self.spark, root)
            files.save_graph(kept, *corpus.build(elements, options or corpus.Options(korean=self.language.startswith("ko")), embeddings, responses), path)
        return files.load_graph(self.spark, kept, path)

    def graph_statistics(self) -> DataFrame:
        return graph.statistics(*self.graph())

    def images(self, paper_id: str, limit: int = 50) -> DataFrame:
        return graph.paper_images(self.graph()[0], paper_id, limit)

    # Questions, answers, pairs.

    def questions(self, model: str, n_paths: int, n: int = 3, paper_id: str | None = None, seed: int = 42, **options) -> DataFrame:
        """Questions on sampled paths that stay out of held-out papers: id, question, question_source and what the path tells."""
        nodes, edges = self.graph()
        found = staged(paths.sample_paths(nodes, edges, n_paths, seed=seed, excluded=self.split().where(HELD_OUT), paper_id=paper_id, **options), "paths")
        asked = generation.questions(found, model, self.models[model], n, language=self.language)
        of_path = found.select("try", "paper_id", "question_type", "difficulty", "gold_answer", "kg_provenance", "image_paths")
        return asked.join(of_path, "try").withColumn("id", F.concat_ws("_", "try", "attempt")).withColumn("images", F.col("image_paths")).drop("try", "attempt")

    def answers(self, model: str, asked: DataFrame, n: int = 3, temperature: float = 0.9) -> DataFrame:
        return asked.join(generation.answers(asked, model, self.models[model], n, temperature, self.language), "id")

    def log(self) -> DataFrame:
        return files.read_pairs(self.spark, self.place("pairs"))

    def active(self) -> DataFrame:
        return pairs.latest_state(self.log())

    def save(self, chosen: DataFrame) -> int:
        """Appends judged pairs (questions with chosen_idx and rejected_idx, or chosen and rejected); gives how many were new and valid."""
        fields = StructType.fromDDL(PAIRS).fields
        rows = chosen.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in chosen.columns})
        fixed = {
            "lang": F.coalesce("lang", F.lit(self.language)), "created_at": F.coalesce("created_at", F.lit(stamp())),
            "model_version": F.coalesce("model_version", F.lit((self.counters.snapshot()["active_adapter"] or "base").rsplit("/", 1)[-1])),
        }
        if "seq" not in rows.columns:
            fixed["seq"] = F.struct("question", "id") if "id" in rows.columns else F.struct("question")
        judged = staged(rows.withColumns(fixed), "judged")  # models have answered once, however often the log is read again
        if n := files.change_pairs(self.spark, self.place("pairs"), lambda log: pairs.added(log, judged, self.language)):
            self.counters.pairs_added(n)
        return n

    def delete(self, ids: DataFrame, reason: str = "") -> int:
        if n := files.change_pairs(self.spark, self.place("pairs"), lambda log: pairs.tombstones(log, ids, reason)):
            self.counters.pairs_counted(self.active().count())
        return n

    # Training, comparison, evaluation.

    def decision(self) -> DataFrame:
        """One row with should_train, its reason, and `markdown` for people."""
        now, own = self.counters.snapshot(), self.section("train")
        bounds = {k: int(own[c]) for k, c in (("first", "first_train_min_pairs"), ("retrain", "retrain_every_n_pairs"), ("least", "min_pairs_per_type")) if own.get(c) is not None}
        return training.shown(training.decision(self.active(), now["pairs_since_last_train"], now["train_count"], **bounds))

    def train(self, trainer: Trainer, evaluate: Callable[[dict], dict] | None = None, on_step: Callable[[int, float], None] | None = None, force: bool = False) -> dict | None:
        """Trains when it is due (or forced), evaluates, records, and activates the adapter; gives the record, or None if it is not due.

        An evaluation that fails leaves an empty one: the training has happened, and is recorded.
        """
        if not force and not self.decision().first()["should_train"]:
            return None
        valid = pairs.training_pairs(self.active())
        record = {"n_train_pairs": valid.count()} | trainer(valid, self.section("train"), on_step or (lambda step, loss: None))
        adapter = record.pop("adapter", None)
        if evaluate is not None:
            try:
                record["eval"] = evaluate(record)
            except Exception as problem:
                record["notes"] = f"evaluation failed: {problem}"
        self.counters.record_training(self.place("history"), record)
        if adapter:
            self.counters.activate(adapter)
        return record

    def history(self) -> list[dict]:
        return read_json(self.place("history"), [])

    def evaluated(self, model: str, items: DataFrame) -> dict:
        """The means of the three metrics over readable items that the model answers."""
        some = evaluation.readable(items)
        said = enrichment.infer(some.select(F.col("question_id").alias("id"), F.col("question").alias("prompt"), F.col("image_paths").alias("images")), model, self.models[model])
        answered = evaluation.evaluated(some, said.select(F.col("id").alias("question_id"), F.col("response").alias("prediction")))
        return evaluation.batch_metrics(answered).drop("n").first().asDict()

    def compared(self, prompts: DataFrame, base: str, tuned: str, temperature: float = 0.0) -> DataFrame:
        """Prompts (id, prompt, images) with both models' answers, and whether these differ in white space only."""
        both = [enrichment.infer(prompts, m, self.models[m], temperature).withColumnRenamed("response", c) for m, c in ((base, "base_answer"), (tuned, "tuned_answer"))]
        out = prompts.join(both[0], "id").join(both[1], "id")
        return out.withColumn("identical", identical(F.col("base_answer"), F.col("tuned_answer")))

    def judge(self, verdicts: DataFrame) -> int:
        """Appends verdicts (checkpoint, verdict: trained, base or tie, ...) to the comparisons."""
        return files.append_comparison(verdicts, self.place("comparisons"))

    def comparisons(self) -> DataFrame:
        there = self._there("comparisons")
        return training.comparison_stats(files.read_comparisons(self.spark, self.place("comparisons")) if there else self.spark.createDataFrame([], COMPARISONS))

    # Export and settings.

    def export(self, form: str | None = None, path: str | None = None, images: bool = True) -> str:
        """Writes the active pairs in an export format as JSON, and copies of their images beside them."""
        own, out = self.section("export"), path or self.place("export")
        active = pairs.training_pairs(self.active())
        files.write_json(pairs.export(active, form or own.get("format", "flat"), own.get("field_map")), f"{out}/data")
        if images:
            files.copied_images(pairs.exported_images(active), self.section("paths")["data_root"], f"{out}/images").write.mode("overwrite").parquet(f"{out}/copied")
        return out

    def preview(self, n: int = 5, form: str | None = None) -> DataFrame:
        return pairs.export(pairs.training_pairs(self.active(), n), form or self.section("export").get("format", "flat"))

    def change(self, path: str, changes: dict) -> settings.Checked:
        """Saves settings; this object has them too, if they were without errors."""
        result = settings.save(path, changes)
        if result.ok:
            self.config = settings.load(path)
        return result

    def restore_settings(self, path: str, copy: str) -> None:
        restore(path, copy)
        self.config = settings.load(path)
