"""Intermediate tables in the folder that the driver and all executors share, and who owns them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Run:
    """The paths that one piece of work has made, in its own thread or task; other work's paths are not among them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], set()

    def release(self, keep: DataFrame | None = None, tables_only: bool = False) -> int:
        """Deletes what this run has made but what the plan of `keep` reads; gives the number of paths deleted.

        A result that is still to be computed may read files that its plan does not show: then tables_only leaves these.
        """
        used = {part for file in (keep.inputFiles() if keep is not None else []) for part in file.split("/")}
        gone = [p for p in self.paths if p.rsplit("/", 1)[-1] not in used and (p in self.tables or not tables_only)]
        configuration = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in gone:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(configuration).delete(hadoop, True)
            self.paths.remove(path)
        return len(gone)


_current: ContextVar[Run | None] = ContextVar("quillgraph_run", default=None)


@contextlib.contextmanager
def owned(spark: SparkSession, release: bool = False) -> Iterator[Run]:
    """Work inside owns what it stages.  What is left at the end is deleted, or goes to the run around it, as a result may read it.

    Without a run around it, it stays until the driver's JVM ends.
    """
    outer, run = _current.get(), Run(spark)
    token = _current.set(run)
    try:
        yield run
    finally:
        _current.reset(token)
        if release:
            run.release()
        elif outer is not None:
            outer.paths.extend(run.paths)
            outer.tables |= run.tables


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Hadoop deletes it when the driver's JVM ends, unless its run releases it before."""
    path = f"{shared_folder(spark).rstrip('/')}/quillgraph-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if run := _current.get():
        run.paths.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: work is done once and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if run := _current.get():
        run.tables.add(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
