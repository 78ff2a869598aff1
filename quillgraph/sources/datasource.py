"""Layouts as a data source of the engine: `spark.read.format("paper_layouts")` and `spark.readStream` alike.

Rows are paper_id and the layout as JSON text (`layout.from_source` parses it).  A folder holds either a folder for each
paper with its layout file, or files of JSON lines with a paper_id each, or both.  Partitions are planned from the
listing by size; a condition on paper_id prunes folders before any file is opened.

A stream keeps its listing as numbered commits in a folder of its own: what a listing finds that no commit has named is
the next commit, and offsets are numbers of commits.  So a paper is opened once, however often the stream is started and
wherever the folder is moved to, and a batch that is run again opens the same files.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

FILE, LINES = "parsing_paddle.json", (".json", ".jsonl")
#: Of a partition, and of the rows that a worker holds and hands on at once, as layouts are long.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


def _opened(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or ":" not in uri:
        return fs.LocalFileSystem(), uri if ":" not in uri else "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def listing(root: str, only: set[str] | None = None) -> list[tuple[str, str | None, int]]:
    """Path below the folder, paper (None for files of lines) and size of each layout file."""
    from pyarrow import fs

    files, top = _opened(root)
    found, folders = [], []
    for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if x.base_name[0] in "._":
            continue
        if x.type == fs.FileType.Directory:
            if only is None or x.base_name in only:
                folders.append(x)
        elif x.base_name.endswith(LINES):
            found.append((x.base_name, None, x.size))
    for folder, x in zip(folders, files.get_file_info([posixpath.join(f.path, FILE) for f in folders])):
        if x.type == fs.FileType.File:
            found.append((f"{folder.base_name}/{FILE}", folder.base_name, x.size))
    return sorted(found, key=lambda f: f[0])


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str | None]]

    def __init__(self, files: list[tuple[str, str | None]]):
        super().__init__(None)
        self.files = files


def planned(found: list, partition_bytes: int) -> list[Files]:
    """Files in partitions of about so many bytes, an opened file counting as a part of one."""
    parts, size = [[]], 0
    for path, paper, length in found:
        length += partition_bytes // 1000
        if parts[-1] and size + length > partition_bytes:
            parts.append([])
            size = 0
        parts[-1].append((path, paper))
        size += length
    return [Files(p) for p in parts if p]


def _batch(rows: list[tuple[str, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["paper_id", "value"])


class _Rows:
    """Reads the files of a partition."""

    def __init__(self, options: dict):
        self.root, self.bytes = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.names = str(options.get("names", "")).lower() == "true"
        self.only: set[str] | None = None

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self.rows(partition):
            held.append(row)
            size += len(row[1] or "")
            if size >= BATCH_BYTES or len(held) == 10_000:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def rows(self, partition: Files) -> Iterator[tuple[str, str | None]]:
        files, top = _opened(self.root)
        for path, paper in partition.files:
            if self.names and paper is not None:
                yield paper, None
                continue
            with files.open_input_stream(posixpath.join(top, path)) as raw:
                if paper is not None:
                    yield paper, raw.read().decode("utf-8", "replace")
                    continue
                import io

                for line in io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"):
                    if not line.strip():
                        continue
                    try:
                        own = json.loads(line).get("paper_id")
                    except (ValueError, AttributeError):
                        continue  # a broken line names no paper
                    if own is not None and (self.only is None or str(own) in self.only):
                        yield str(own), None if self.names else line


class LayoutReader(_Rows, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            some = {x.value} if isinstance(x, EqualTo) else set(x.value) if isinstance(x, In) else None
            if some is None or x.attribute != ("paper_id",):
                yield x
            else:
                self.only = some if self.only is None else self.only & some

    def partitions(self) -> list[Files]:
        return planned(listing(self.root, self.only), self.bytes) or [Files([])]


class LayoutStreamReader(_Rows, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.log = options["listing"]

    def _commits(self) -> dict[int, str]:
        from pyarrow import fs

        files, top = _opened(self.log)
        found = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return {int(x.base_name[:-5]): x.path for x in found if x.base_name.endswith(".json") and x.base_name[:-5].isdigit()}

    def _named(self, path: str) -> list[tuple[str, str | None, int]]:
        with _opened(self.log)[0].open_input_stream(path) as raw:
            return [tuple(x) for x in json.loads(raw.read())]

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self, *_) -> dict:
        commits = self._commits()
        seen = {path for at in commits.values() for path, _, _ in self._named(at)}
        new, last = [x for x in listing(self.root) if x[0] not in seen], max(commits, default=0)
        if new:
            files, top = _opened(self.log)
            files.create_dir(top, recursive=True)
            part = f"{top}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(json.dumps(new).encode())
            last += 1
            files.move(part, f"{top}/{last:012d}.json")
        return {"commit": last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        commits = self._commits()
        found = [x for n in range(start["commit"] + 1, end["commit"] + 1) for x in self._named(commits[n])]
        return planned(found, self.bytes) or [Files([])]


class LayoutSource(DataSource):
    """Options: path; partition_bytes; names, for names alone (files of one paper are not opened then); for streams also listing, a folder that belongs to the stream."""

    @classmethod
    def name(cls) -> str:
        return "paper_layouts"

    def schema(self) -> str:
        return "paper_id string, value string"

    def reader(self, schema) -> LayoutReader:
        return LayoutReader(self.options)

    def streamReader(self, schema) -> LayoutStreamReader:
        return LayoutStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets conditions reach sources like it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayoutSource)
