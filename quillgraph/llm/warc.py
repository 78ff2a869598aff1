"""WARC archives: writing, normalising monolithic gzip files, and reading records back by offset.

An archive that was compressed as one gzip stream can only be read from its start.  The normaliser inflates such a
stream once, in bounded pieces, rewrites every record as a gzip member of its own, and writes a sidecar index (a line of
JSON per record: offset, length, record id, type) from which any record is read alone.

Archives live in the shared folder and are written by executors through pyarrow's file systems, under fresh names; only
archives that a finished task reports are read, so a task that is run again does no harm.

Records with equal payloads of at least `least` bytes are stored once: that with the smallest page_id is the response
(of equal rows, one), the others revisit it.  Defined results: a null html is an empty payload; a null url is an empty
one; a null page_id counts as larger than any other, and a revisit of a record without page_id refers to null; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_type, out_batch, place, prepare, shared_path, staged

LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "archive string,index string,records long,bytes long"
RECORDS = "page_id long,url string,payload_bytes long,payload_digest string,record_type string,refers_to long,html string"
_PIECE = 1 << 18


def _named(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


_CONTROL = re.compile(r"[\x00-\x1f\x7f]|^\s|\s$")
ENCODED = "WARC-Target-URI-Encoding"


def record(page: int | None, url: str, payload: bytes, digest: str, revisits: bool = False, refers_to: int | None = None) -> bytes:
    """One uncompressed WARC record; a revisit has the HTTP headers of its page without the payload.

    A URL stands as it is; one that a header cannot hold is percent-encoded, and a field of its own says so.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_named(page)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {urllib.parse.quote(url, safe='')}", f"{ENCODED}: percent"] if _CONTROL.search(url) else [f"WARC-Target-URI: {url}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisits:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_named(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int]:
    """The header fields that begin at a place (names in lower case), and the place after their empty line."""
    end = data.index(b"\r\n\r\n", at)
    lines = bytes(data[at:end]).decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}, end + 4


def target(fields: dict[str, str]) -> str:
    url = fields.get("warc-target-uri", "")
    return urllib.parse.unquote(url) if fields.get(ENCODED.lower()) == "percent" else url


class Normaliser:
    """Takes an uncompressed WARC stream in pieces; writes each record as a gzip member and an index line."""

    def __init__(self, archive: BinaryIO, index: BinaryIO, level: int = 4):
        self.archive, self.index, self.level = archive, index, level
        self.rest, self.offset, self.records, self.raw = bytearray(), 0, 0, 0

    def feed(self, piece: bytes) -> None:
        self.rest += piece
        at = 0
        while (size := self._size(at)) is not None and at + size <= len(self.rest):
            self._write(bytes(self.rest[at : at + size]))
            at += size
        del self.rest[:at]

    def _size(self, at: int) -> int | None:
        """The bytes of the record that begins there, or None if its headers are not complete."""
        if self.rest.find(b"\r\n\r\n", at) < 0:
            return None
        fields, body = headers(self.rest, at)
        return body - at + int(fields["content-length"]) + 4

    def _write(self, whole: bytes) -> None:
        fields, _ = headers(whole)
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(whole) + packer.flush()
        self.archive.write(member)
        line = {"offset": self.offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"]}
        self.index.write(json.dumps(line).encode() + b"\n")
        self.offset += len(member)
        self.records += 1
        self.raw += len(whole)

    def close(self) -> None:
        if self.rest:
            raise ValueError("the archive ends inside a record")


def normalise(source: str, archive: str, index: str) -> tuple[int, int]:
    """Rewrites a monolithic (or any) gzip archive record by record; gives the records and their uncompressed bytes.

    A stream that ends before its trailer, or inside a record, is refused.
    """
    fs, path = place(source)
    out, out_path = place(archive)
    with fs.open_input_stream(path, compression=None) as stream, out.open_output_stream(out_path, compression=None) as a, out.open_output_stream(place(index)[1], compression=None) as i:
        to = Normaliser(a, i)
        unpack, begun = zlib.decompressobj(31), False
        while piece := stream.read(_PIECE):
            while piece:
                begun = True
                to.feed(unpack.decompress(piece, 4 * _PIECE))
                piece = unpack.unconsumed_tail
                if unpack.eof:  # the next member, if the source has several
                    piece, unpack, begun = unpack.unused_data, zlib.decompressobj(31), False
        to.feed(unpack.flush() if begun else b"")
        if begun and not unpack.eof:
            raise ValueError(f"{source} ends before its gzip trailer")
        to.close()
    return to.records, to.raw


def read_records(archive: str, index: str) -> Iterator[bytes]:
    """Each record of a normalised archive, uncompressed, read by its offset."""
    fs, path = place(archive)
    with fs.open_input_file(path) as data, fs.open_input_stream(place(index)[1], compression=None, buffer_size=_PIECE) as lines:
        rest = b""
        while piece := lines.read(_PIECE):
            *whole, rest = (rest + piece).split(b"\n")
            for line in map(json.loads, whole):
                yield zlib.decompress(data.read_at(line["length"], line["offset"]), 31)


def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """Writes records as monolithic gzip archives of about `most` bytes, each normalised when it is full."""
    schema = arrow_type(ARCHIVES)
    fs, _ = place(folder)
    stream = packer = name = None
    size = 0

    def finish():
        stream.write(packer.flush())
        stream.close()
        archive, index = f"{name}.warc.gz", f"{name}.warc.gz.idx"
        records, raw = normalise(f"{name}.whole.gz", archive, index)
        fs.delete_file(place(f"{name}.whole.gz")[1])
        return out_batch(schema, archive=[archive], index=[index], records=[records], bytes=[raw])

    for batch in batches:
        for row in batch.to_pylist():
            if stream is None:
                name = f"{folder}/{uuid.uuid4().hex}"
                stream = fs.open_output_stream(place(f"{name}.whole.gz")[1], compression=None)
                packer, size = zlib.compressobj(1, zlib.DEFLATED, 31), 0
            payload = row["html"].encode()
            data = record(row["page_id"], row["url"], payload, row["digest"], row["revisits"], row["refers_to"])
            stream.write(packer.compress(data))
            size += len(data)
            if size >= most:
                yield finish()
                stream = None
    if stream is not None:
        yield finish()


def _read(batches: Iterator[pa.RecordBatch], with_html: bool) -> Iterator[pa.RecordBatch]:
    schema = arrow_type(RECORDS if with_html else RECORDS.rpartition(",")[0])
    for batch in batches:
        for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[dict] = []
            for data in read_records(archive, index):
                fields, body = headers(data)
                http, payload = headers(data, body)
                kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                content = data[payload:-4]
                if kind == "response" and hashlib.sha256(content).hexdigest() != said:
                    raise ValueError(f"{archive}: the payload of {fields['warc-record-id']} does not match its digest")
                row = {"page_id": _page(fields["warc-record-id"]), "url": target(fields), "payload_bytes": int(http["content-length"]), "payload_digest": said, "record_type": kind}
                row["refers_to"] = _page(fields["warc-refers-to"]) if kind == "revisit" else None
                rows.append(row | ({"html": content.decode() if kind == "response" else None} if with_html else {}))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The pages with html, digest, revisits and refers_to.

    Only page_id and digest are shuffled to find equal payloads, pre-aggregated, so a payload that a third of all pages
    share is no hot task.  Pages meet the written list of those that share one by page_id and digest; while the list is
    small, Spark broadcasts it and no html moves.  Rows are numbered only where a page_id has several.
    """
    html = F.coalesce("html", F.lit(""))
    raw = F.encode(html, "utf-8")
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("size"))
    keyed = pages.withColumns({"none": F.col("page_id").isNull(), "id": F.coalesce("page_id", F.lit(0))})
    keys = ["id", "none", "digest"]
    large = keyed.where(F.col("size") >= least).groupBy("digest", "id", "none").agg(F.count(F.lit(1)).alias("rows"))
    smallest = F.min(F.when(F.col("none"), None).otherwise(F.col("id")))
    same = large.groupBy("digest").agg(smallest.alias("first"), F.sum("rows").alias("n")).where("n > 1").drop("n")
    shared = staged(large.join(same, "digest").select(*keys, "first", "rows"), "shared")
    met = keyed.join(shared, keys, "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    names = ["page_id", "url", "html", "digest", "first", "revisits"]
    once = met.where(F.coalesce("rows", F.lit(1)) == 1).withColumn("revisits", F.col("rows").isNotNull() & other).select(*names)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("url"))
    several = keyed.join(shared.where("rows > 1"), keys).withColumn("number", number).withColumn("revisits", other | (F.col("number") > 1)).select(*names)
    return once.unionByName(several).select("page_id", "url", "html", "digest", "revisits", F.when(F.col("revisits"), F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str | None = None, most: int = 256 << 20) -> DataFrame:
    """Writes normalised archives with sidecar indexes and lists them: archive, index, records, bytes."""
    spark = marked.sparkSession
    prepare(spark)
    folder = folder or shared_path(spark, "warc")
    fs, path = place(folder)
    fs.create_dir(path, recursive=True)
    return staged(marked.mapInArrow(partial(_write, folder=folder, most=most), ARCHIVES), "archives")


def read_archives(archives: DataFrame, with_html: bool = True) -> DataFrame:
    """A row per record of the listed archives."""
    spark = archives.sparkSession
    prepare(spark)
    spread = archives.select("archive", "index").repartition(max(1, archives.count()), F.xxhash64("archive"))
    return spread.mapInArrow(partial(_read, with_html=with_html), RECORDS if with_html else RECORDS.rpartition(",")[0])


def archived(pages: DataFrame, least: int = LEAST, with_html: bool = False) -> DataFrame:
    """Writes all pages as WARC archives and reads them back."""
    return read_archives(write_archives(revisits(pages, least)), with_html)
