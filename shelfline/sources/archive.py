"""Feed archives: ZIP members, CSV and XLSX decoding, one long feed plus its issues.

An archive is opened where it lies: one task reads its directory from the end of the file, and each
member is then read by a task of its own, from its place in the file, so an archive is never a cell and
may be of any size.  A CSV member beyond one block is cut into blocks, which many tasks parse.  Every
decoded row carries its archive, file place and row place, so later steps can tell first from later.
Decoding happens once: the result is written to the shared folder and read back as the feed and the
issues.
"""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterator
from hashlib import blake2b
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import let
from shelfline.session import broadcast_within, shared_folder, written
from shelfline.sources import columns as sc
from shelfline.sources import split_csv
from shelfline.sources.columns import FIELDS, header_map, header_of
from shelfline.sources.filenames import file_status, parse_file_name, with_file_parts
from shelfline.sources.files import open_input

_FEED_FIELDS = list(FIELDS)
_FILE = [("archive", pa.string()), ("file_seq", pa.int64()), ("file_name", pa.string())]
_MEMBERS = pa.schema(_FILE + [("member", pa.string()), ("size", pa.int64()), ("member_error", pa.string())])
_DECODED = pa.schema(_FILE + [("kind", pa.string()), ("row_seq", pa.int64()),
                              ("header", pa.list_(pa.string())), ("error", pa.string())]
                     + [(f, pa.string()) for f in _FEED_FIELDS]
                     + [("content", pa.binary()), ("ahead", pa.binary()), ("lead", pa.binary())])
NO_TABLE = "no encoding and delimiter make this file a table"
_ROWS_PER_BATCH = 20_000
_JUNK = ("\x00", "﻿", "￾", "\xff\xfe", "\xfe\xff")


# --- archives -----------------------------------------------------------------------------------

def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive``: one row per ZIP file below ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option(
        "recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"))


def feed_members(names: list[str]) -> list[tuple[str, str]]:
    """(base name, member) of the feed files of an archive.

    Folders, resource forks and hidden files are no feed files.  A base name that occurs again
    keeps its first place and takes the later content.
    """
    chosen: dict[str, str] = {}
    for name in names:
        base = name.rsplit("/", 1)[-1]
        if base and not name.startswith("__MACOSX") and not base.startswith("."):
            chosen[base] = name
    return list(chosen.items())


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per feed file, from the directories at the archives' ends.

    An archive without feed files gives one row without a name, a broken one such a row with
    ``member_error``.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                held, error = [], None
                try:
                    with open_input(archive) as file:
                        if file.size() < zipfile.sizeEndCentDir:
                            raise zipfile.BadZipFile("File is not a zip file")
                        with zipfile.ZipFile(file) as opened:
                            held = [(base, member, opened.getinfo(member).file_size)
                                    for base, member in feed_members(opened.namelist())]
                except zipfile.BadZipFile as failure:
                    # One broken upload is an issue of its own, not the end of the job.
                    error = str(failure)[:200] or "not a ZIP file"
                rows = [(archive, place, *m, None) for place, m in enumerate(held)]
                rows = rows or [(archive, 0, None, None, None, error)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_MEMBERS.names, r)) for r in rows], _MEMBERS)

    return archives.select("archive").mapInArrow(listed, from_arrow_schema(_MEMBERS))


def _pieces(archive: str, member: str, size: int) -> Iterator[bytes]:
    """A member's bytes as a stream; only its own range of the archive is read, and the directory."""
    with open_input(archive) as file, zipfile.ZipFile(file) as opened, opened.open(member) as stream:
        while piece := stream.read(size):
            yield piece


# --- tables -------------------------------------------------------------------------------------

def scrub_cell(cell: str | None) -> str | None:
    if cell is None:
        return None
    for junk in _JUNK:
        cell = cell.replace(junk, "")
    return cell.strip()


def _records(text: str, delimiter: str, skip: int) -> list[list[str]]:
    """Non-blank records after ``skip`` lines."""
    csv.field_size_limit(2 ** 31 - 1)
    lines = io.StringIO(text, newline="")
    for _ in range(skip):
        lines.readline()
    return [r for r in csv.reader(lines, delimiter=delimiter) if any(c.strip() for c in r)]


def _score(text: str, delimiter: str, skip: int) -> int:
    """Worth of one reading: expected columns, then columns, then rows; 0 if it is no table.

    A record longer than the header is no table either.  Records are counted as they are read, and
    reading ends with the first that rules the table out.
    """
    csv.field_size_limit(2 ** 31 - 1)
    lines = io.StringIO(text, newline="")
    for _ in range(skip):
        lines.readline()
    header, rows = None, 0
    for record in csv.reader(lines, delimiter=delimiter):
        if not any(c.strip() for c in record):
            continue
        if header is None:
            header = record
            if len(header) < 2:
                return 0
        elif len(record) > len(header):
            return 0
        else:
            rows += 1
    if not rows:
        return 0
    names = {scrub_cell(h).lower() for h in header}
    known = sum(e in names or e + "." in names for e in fv.CSV_EXPECTED_COLUMNS)
    return fv.CSV_MATCH_WEIGHT * known + fv.CSV_COLUMN_WEIGHT * len(header) + rows


def sniff_csv(content: bytes) -> tuple[str, str, int] | None:
    """Encoding, delimiter and lines to skip of the best reading; the earlier one of equals.

    NUL characters go before parsing, so two encodings that agree on everything else read alike
    and the text of an encoding already tried is not parsed again.  One decoded text is held at a
    time; of those tried only a digest is kept.
    """
    best, chosen, tried = 0, None, set()
    for encoding in fv.CSV_ENCODINGS:
        try:
            bare = content.decode(encoding).replace("\x00", "").lstrip("﻿")
        except (UnicodeDecodeError, UnicodeError):
            continue
        digest = blake2b(bare.encode("utf-8", "surrogatepass")).digest()
        if digest in tried:
            continue
        tried.add(digest)
        for delimiter in fv.CSV_DELIMITERS:
            # Without the delimiter no line has two columns.
            if delimiter not in bare:
                continue
            for skip in fv.CSV_SKIP_ROWS:
                try:
                    score = _score(bare, delimiter, skip)
                except csv.Error:
                    continue
                if score > best:
                    best, chosen = score, (encoding, delimiter, skip)
    return chosen


def csv_table(content: bytes) -> list[list[str]]:
    dialect = sniff_csv(content)
    if dialect is None:
        raise ValueError(NO_TABLE)
    encoding, delimiter, skip = dialect
    text = content.decode(encoding).replace("\x00", "").lstrip("﻿")
    return _records(text, delimiter, skip)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_sheets(content: bytes) -> dict[str, str]:
    """Sheet name -> member holding it, in workbook order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(
            book.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_SHEET + "sheet")
        return {s.get("name"): "xl/" + links[s.get(_LINK)].lstrip("/").removeprefix("xl/")
                for s in sheets}


def xlsx_table(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """The rows of a sheet (the first by default) as text; empty cells are empty text."""
    sheets = xlsx_sheets(content)
    member = sheets[sheet] if sheet else next(iter(sheets.values()))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(_SHEET + "t")))
        rows = []
        with book.open(member) as opened:
            for _, row in ElementTree.iterparse(opened):
                if row.tag != _SHEET + "row":
                    continue
                cells: dict[int, str] = {}
                for cell in row:
                    cells[_column_of(cell.get("r"), len(cells))] = _cell_text(cell, shared)
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
                row.clear()
    return [r for r in rows if any(c != "" for c in r)]


def _column_of(reference: str | None, default: int) -> int:
    if not reference:
        return default
    place = 0
    for letter in reference:
        if letter.isalpha():
            place = place * 26 + ord(letter.upper()) - ord("A") + 1
    return place - 1


def _cell_text(cell, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_SHEET + "t"))
    value = cell.find(_SHEET + "v")
    if value is None or value.text is None:
        return ""
    return shared[int(value.text)] if kind == "s" else value.text


# --- decoding -----------------------------------------------------------------------------------

def decode_members(members: DataFrame, block: int = split_csv.BLOCK_BYTES) -> DataFrame:
    """Rows of every readable member (kind ``row``) and one ``file`` row per member.

    A CSV member of more than ``block`` bytes gives its ``block`` rows in place of both; if it breaks
    off, a ``file`` row that says so.  A member that cannot be read (a wrong checksum, encryption, an
    unknown method) gives its ``file`` row with the error, and the others are read as ever.
    """
    typed = members.withColumn("extension", parse_file_name(F.col("file_name"))["extension"])
    empty = frozenset(fv.EMPTY_CELLS)

    def file_row(head: dict, header: list[str], error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**head, "kind": "file", "row_seq": -1, "header": header,
                                            "error": error}], _DECODED)

    def said(failure: Exception) -> str:
        return str(failure)[:200] or type(failure).__name__

    def blocks_of(head: dict, member: str) -> Iterator[pa.RecordBatch]:
        try:
            for number, content, ahead, lead in split_csv.cut_blocks(
                    _pieces(head["archive"], member, block), block):
                yield pa.RecordBatch.from_pylist(
                    [{**head, "kind": "block", "row_seq": number, "content": content, "ahead": ahead,
                      "lead": lead}], _DECODED)
        except Exception as failure:
            yield file_row(head, [], said(failure))

    def rows_of(head: dict, table: list[list[str]]) -> Iterator[pa.RecordBatch]:
        header = [scrub_cell(h) or "" for h in table[0]]
        yield file_row(head, header, None)
        places, rows = header_map(header), table[1:]
        for start in range(0, len(rows), _ROWS_PER_BATCH):
            piece = rows[start:start + _ROWS_PER_BATCH]
            out = {name: [value] * len(piece) for name, value in head.items()}
            out |= {"kind": ["row"] * len(piece), "row_seq": list(range(start, start + len(piece)))}
            for field in _FEED_FIELDS:
                i = places.get(field)
                cells = [None if i is None or i >= len(r) else scrub_cell(r[i]) for r in piece]
                out[field] = [None if c in empty else c for c in cells]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.get(f.name, [None] * len(piece)), f.type) for f in _DECODED],
                schema=_DECODED)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                head = {k: m[k] for k, _ in _FILE}
                extension, member, error = m["extension"], m["member"], m["member_error"]
                if error is not None or extension not in ("csv", "xlsx"):
                    yield file_row(head, [], error)
                    continue
                if extension == "csv" and m["size"] > block:
                    yield from blocks_of(head, member)
                    continue
                try:
                    read = csv_table if extension == "csv" else xlsx_table
                    table = read(b"".join(_pieces(m["archive"], member, block)))
                except Exception as failure:
                    yield file_row(head, [], said(failure))
                    continue
                yield from rows_of(head, table)

    return typed.mapInArrow(decode, from_arrow_schema(_DECODED))


def decode_blocks(blocks: DataFrame, keep) -> DataFrame:
    """What ``decode_members`` makes of smaller members, from the blocks of large ones."""
    records, tables = split_csv.split_tables(blocks, keep)
    bare = F.transform("header", lambda h: sc.scrub(h))
    files = tables.select("archive", "file_seq", F.when(F.col("encoding").isNotNull(), bare).alias("header"),
                          F.when(F.col("encoding").isNull(), F.lit(NO_TABLE)).alias("error"))
    named = files.join(blocks.select("archive", "file_seq", "file_name").distinct(), ["archive", "file_seq"])
    # A row for each large member: few, and counted before they are broadcast.
    headed = broadcast_within(named.where("error is null").select("archive", "file_seq", "file_name", *[
        header_of(F.col("header"), required).alias(f"_{field}") for field, required in FIELDS.items()],
        "header"))
    joined = records.join(headed, ["archive", "file_seq"])

    def cell(field: str) -> Column:
        at = F.array_position("header", F.col(f"_{field}")).cast("int") - 1
        value = F.when(F.col(f"_{field}").isNotNull(), sc.scrub(F.get("cells", at)))
        return let(value, lambda v: F.when(~v.isin(fv.EMPTY_CELLS), v)).alias(field)

    rows = joined.select("archive", "file_seq", "file_name", F.lit("row").alias("kind"), "row_seq",
                         *[cell(f) for f in _FEED_FIELDS])
    return named.select("archive", "file_seq", "file_name", F.lit("file").alias("kind"),
                        F.lit(-1).cast("long").alias("row_seq"), F.coalesce("header", F.array().cast(
                            "array<string>")).alias("header"), "error").unionByName(
        rows, allowMissingColumns=True)


def ingest_archives(spark: SparkSession, path: str, tasks: int | None = None, store: str | None = None,
                    block: int = split_csv.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Archives below ``path`` to (feed, issues).

    ``tasks`` is the number of tasks members are spread over; by default the session's shuffle
    partitions.  ``store`` is where the decoded rows are written; a new folder
    under the cluster's shared folder if not given.  CSV members beyond ``block`` bytes are parsed in
    blocks.
    """
    store = store or f"{shared_folder(spark)}/decoded-{uuid.uuid4().hex}"
    members = archive_members(read_archives(spark, path))
    place = ["archive", "file_seq"]
    # The rows are names: put together by size, all members would be read in one task.
    spread = members.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), *place)
    decode_members(spread, block).write.partitionBy("kind").parquet(store)
    decoded = spark.read.schema(from_arrow_schema(_DECODED)).parquet(store)
    broken = decoded.where("kind = 'file' and error is not null").select(*place)
    blocks = decoded.where("kind = 'block'").withColumn("block", F.col("row_seq")).join(
        broadcast_within(broken), place, "left_anti")
    if blocks.limit(1).count():
        names = [f for f in _DECODED.names if f not in ("content", "ahead", "lead")]
        made = decode_blocks(blocks, lambda df: written(df, "split"))
        made.select(*[n for n in names if n in made.columns]).write.mode("append").partitionBy(
            "kind").parquet(store)
    return split_decoded(spark, store)


def split_decoded(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """The feed and the issues of a decoded store."""
    decoded = spark.read.schema(from_arrow_schema(_DECODED)).parquet(store).drop("content", "ahead", "lead")
    files = with_file_parts(decoded.filter("kind = 'file'").select(
        "archive", "file_seq", "file_name", "header", "error")).drop("extension")
    empty = files.filter("file_name is null").select(
        "archive", F.lit(None).cast("string").alias("file_name"),
        F.coalesce(F.concat(F.lit("Archive cannot be opened: "), "error"),
                   F.lit(fv.NO_FILES)).alias("issue"))
    status = file_status(files.filter("file_name is not null"))
    accepted = status.filter("accepted")
    lacking = accepted.select("archive", "file_name", F.explode(F.filter(F.array(*[
        F.when(header_of(F.col("header"), r).isNull(), F.lit(r)) for r in fv.REQUIRED_COLUMNS]),
        lambda r: r.isNotNull())).alias("missing")).select(
        "archive", "file_name", F.concat(F.lit(fv.MISSING_COLUMN), "missing")
        .alias("issue"))
    held = accepted.groupBy("archive").agg(F.max(F.col("month") == "Dec").alias("has_december"))
    undated = files.select("archive").distinct().join(held, "archive", "left").filter(
        ~F.coalesce("has_december", F.lit(False))).select(
        "archive", F.lit(None).cast("string").alias("file_name"),
        F.lit(fv.NO_DECEMBER).alias("issue"))
    issues = (empty.unionByName(status.filter("issue is not null")
                                .select("archive", "file_name", "issue"))
              .unionByName(lacking).unionByName(undated))
    # A row for each member, counted before they are broadcast: rows that go to them follow in one task.
    kept = broadcast_within(accepted.select("archive", "file_seq", "month", "year"))
    feed = decoded.filter("kind = 'row'").join(kept, ["archive", "file_seq"]).select(
        F.col("archive").alias("feed_id"), "month", "year", "file_seq", "row_seq", *_FEED_FIELDS)
    return feed, issues

