"""WARC archives: written from a table of pages, read back as a table of payload chunks.

Equal payloads are stored once: the record of the smallest key is a response, the others revisit it.
Each task writes archives of its own to a shared folder, one gzip member per record, and reports
them in a manifest that is itself a written table, so a repeated task leaves no second copy in it.
Reading streams an archive through a bounded buffer and makes a row per chunk of payload, with the
record's identifier, the chunk's number, and length and SHA-1 of the payload so far; no record is
ever held whole.  Archives are rolled at a size, so that one task reads a bounded file.

The folder is opened through Arrow's file systems by its address (local, HDFS, S3, GCS, ABFS).

Defined results: a null payload is an empty payload.  A null key is written as such and never names
a response that others refer to, unless all keys of the payload are null; then all are responses.
Repeated rows of one key and payload give equal records, all responses if the key is the smallest.
Further columns are left out.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, bounded_batches, table
from shelfline.llm.registry import query

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-records")
DATE = "1970-01-01T00:00:00Z"
# Bytes written or read at a time, of payload in a chunk row, and of one archive before it is rolled.
STEP, CHUNK, ROLL = 1 << 18, 1 << 20, 1 << 29
LEVEL = 4


def base32_of(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{key}/{digest}')}>"


def decided(df: DataFrame, key: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """(key, url, body, size, sha, first): what each record holds and which key responds for it.

    Only keys, sizes and digests are compared; payloads move once, by key.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"),
                     body.alias("body")).withColumns(
        {"size": F.octet_length("body").cast("long"), "sha": F.sha1("body")})
    scratch = Scratch(df.sparkSession, "warc-marks")
    marks = scratch.keep(rows.select("key", "size", "sha").distinct())
    firsts = scratch.keep(marks.where(F.col("size") >= least).groupBy("sha").agg(
        F.min("key").alias("first")))
    named = marks.join(firsts, "sha", "left").select(
        F.col("key").alias("own"), F.col("sha").alias("own_sha"), "first")
    return rows.join(named, F.col("key").eqNullSafe(F.col("own"))
                     & (F.col("sha") == F.col("own_sha"))).select(
        "key", "url", "body", "size", "sha", "first")


class Writer:
    """Archives of one task, rolled at a size."""

    def __init__(self, folder: str, stem: str, roll: int):
        self.system, self.base = FileSystem.from_uri(folder)
        self.folder, self.stem, self.roll = folder, stem, roll
        self.files: list[list] = []
        self.out = None

    def _open(self) -> None:
        name = f"{self.stem}-{len(self.files):04d}.warc.gz"
        self.out = self.system.open_output_stream(f"{self.base}/{name}", compression=None)
        self.files.append([f"{self.folder}/{name}", 0])
        fields = b"software: a table of pages\r\nformat: WARC File Format 1.1\r\n"
        self._member([b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: "
                      + f"<urn:uuid:{uuid.uuid5(NAMES, name)}>".encode() + b"\r\nWARC-Date: "
                      + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\n"
                      + b"Content-Length: %d\r\n\r\n" % len(fields), fields, b"\r\n\r\n"])

    def _member(self, parts) -> None:
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for part in parts:
            for at in range(0, len(part), STEP):
                self.out.write(squeeze.compress(part[at:at + STEP]))
        self.out.write(squeeze.flush())

    def record(self, key, url, body: memoryview, size: int, sha: str, first) -> None:
        if self.out is None or self.out.tell() >= self.roll:
            self.close()
            self._open()
        named = None if key is None else str(key)
        revisit = first is not None and first != key
        digest = base32_of(sha)
        http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                f"Content-Length: {size}\r\n\r\n").encode()
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
                f"WARC-Record-ID: {record_id(named, digest)}", f"WARC-Date: {DATE}",
                "WARC-Target-URI: " + quote(url if url is not None else f"urn:page:{named}",
                                            safe=":/?#[]@!$&'()*+,;=%~"),
                "Content-Type: application/http; msgtype=response",
                f"WARC-Payload-Digest: sha1:{digest}",
                f"Content-Length: {len(http) + (0 if revisit else size)}"]
        if named is not None:
            head.append("X-Page-Key: " + quote(named))
        if revisit:
            head += [f"WARC-Profile: {PROFILE}",
                     f"WARC-Refers-To: {record_id(str(first), digest)}",
                     "X-Refers-To-Key: " + quote(str(first))]
        self._member([("\r\n".join(head) + "\r\n\r\n").encode(), http,
                      b"" if revisit else body, b"\r\n\r\n"])
        self.files[-1][1] += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write what ``decided`` returned to ``folder``; a plan whose rows are the archives written."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = Writer(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}", roll)
        for batch in batches:
            key, url, body, size, sha, first = batch.columns
            for i in range(batch.num_rows):
                data = body[i].as_buffer()
                writer.record(key[i].as_py(), url[i].as_py(),
                              memoryview(data) if data is not None else b"", size[i].as_py(),
                              sha[i].as_py(), first[i].as_py())
        writer.close()
        if writer.files:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in writer.files], pa.string()),
                                              pa.array([f[1] for f in writer.files], pa.int64())],
                                             names=["file", "records"])

    return rows.mapInArrow(run, "file string, records long")


def archive(df: DataFrame, folder: str, key: str = "page_id", url: str = "url",
            payload: str = "html", least: int = 0, roll: int = ROLL) -> DataFrame:
    """Write a record per row of ``df`` under ``folder``; the manifest (file, records), as written."""
    spark = df.sparkSession
    system, base = FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    path = f"{folder}/manifest"
    write_archives(decided(df, key, url, payload, least), folder, roll).write.parquet(path)
    return spark.read.schema("file string, records long").parquet(path)


class Inflated:
    """Bytes of a file of gzip members through a bounded buffer."""

    def __init__(self, stream):
        self.stream, self.raw, self.have = stream, b"", bytearray()
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(STEP)
            if not self.raw:
                return False
        self.have += self.inflate.decompress(self.raw, STEP)
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        else:
            self.raw = self.inflate.unconsumed_tail
        return True

    def head(self) -> list[str] | None:
        """Lines up to an empty one, which is consumed; None at the end of the file."""
        while (at := self.have.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.have.strip():
                    raise ValueError("archive ends inside a record's head")
                return None
        lines = bytes(self.have[:at]).decode("utf-8").split("\r\n")
        del self.have[:at + 4]
        return lines

    def take(self, most: int) -> bytes:
        """At least one and at most ``most`` bytes."""
        while not self.have:
            if not self._more():
                raise ValueError("archive ends inside a record's block")
        out = bytes(self.have[:most])
        del self.have[:len(out)]
        return out

    def exactly(self, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            out += self.take(size - len(out))
        return bytes(out)


def fields_of(lines: list[str]) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (
        x.partition(":") for x in lines[1:])}


CHUNKS = ("record_id string, record_type string, key string, url string, refers_to string, "
          "chunk int, data binary, bytes long, digest string, last boolean, declared_bytes long, "
          "declared_digest string")


def chunks_of(stream, chunk: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of an open archive.  A revisit has one row, with what its head declares."""
    source = Inflated(stream)
    while (lines := source.head()) is not None:
        while lines and not lines[0]:
            lines = lines[1:]
        fields = fields_of(lines)
        left = int(fields["content-length"])
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            while left:
                left -= len(source.take(left))
            source.exactly(4)
            continue
        http: list[str] = source.head() or []
        left -= len("\r\n".join(http).encode()) + 4
        declared = int(fields_of(http)["content-length"])
        digest = fields["warc-payload-digest"].partition(":")[2]
        about = (fields["warc-record-id"], kind, unquoted(fields.get("x-page-key")),
                 fields["warc-target-uri"], unquoted(fields.get("x-refers-to-key")))
        if kind == "revisit":
            yield (*about, 0, None, declared, digest, True, declared, digest)
        else:
            running, number, done = sha1(), 0, 0
            while left or not number:
                part, begun = bytearray(), done
                while left and done - begun < chunk:
                    got = source.take(min(left, chunk - (done - begun), STEP))
                    running.update(got)
                    left -= len(got)
                    done += len(got)
                    if with_data:
                        part += got
                yield (*about, number, bytes(part) if with_data else None, done,
                       base64.b32encode(running.digest()).decode(), not left, declared, digest)
                number += 1
        source.exactly(4)


def unquoted(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``manifest``; without data only lengths and digests."""
    spark = manifest.sparkSession
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string()] * 5 + [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(),
                                 pa.int64(), pa.string()]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = FileSystem.from_uri(file)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in chunks_of(stream, chunk, with_data):
                        rows.append(row)
                        held += 256 + len(row[6] or b"")
                        if held > 4 << 20:
                            yield table_of(rows)
                            rows, held = [], 0
                if rows:
                    yield table_of(rows)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files, "file").mapInArrow(run, CHUNKS)


def _base32_sql(hexed: str) -> str:
    """Base 32 of 40 hexadecimal digits in SQL: five digits make four letters."""
    value = f"cast('0x' || substr({hexed}, 5 * g + 1, 5) as bigint)"
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(({value} >> {shift}) & 31 as int) + 1, 1)"
        for shift in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda g: {letters}), '')"


SQL = f"""with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as sha from pages),
firsts as (select sha as own, min(page_id) as first from p group by sha)
select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes,
 {_base32_sql('sha')} as payload_digest,
 case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
 case when first <> page_id then first end as refers_to, true as intact
from p join firsts on own = sha"""


@query("op6_warc", SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive(table(spark, sf_dir, "pages"), Scratch(spark, "warc").root)
    return read_chunks(manifest, with_data=False).where("last").select(
        F.col("key").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        (F.col("digest") == F.col("declared_digest")).alias("intact"))
