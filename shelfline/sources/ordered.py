"""Lines, workbook rows and side files that keep where they stand in their files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import written
from shelfline.sources import split_csv
from shelfline.sources.columns import date_header
from shelfline.sources.files import open_input
from shelfline.functions.text import strip_space


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, line_no``: the lines of text files, and an order over all of them.

    ``line_no`` is (file, block, byte offset in the block): a block is what one task reads of a file, and
    lines of a block come in order, so the order is that of the files' names and of their bytes, however
    many tasks read them and in whatever order they end.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = 0, None
        for batch in batches:
            offsets = []
            for file, block, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         pa.compute.binary_length(batch.column(2)).to_pylist()):
                if (file, block) != place:
                    at, place = 0, (file, block)
                offsets.append(at)
                at += size + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offsets, pa.int64())],
                                             names=["file", "block", "value", "offset"])

    return raw.mapInArrow(run, "file string, block long, value string, offset long").select(
        "value", F.struct("file", "block", "offset").alias("line_no"))


_SHEET_ROW = "file string, sheet string, sheet_no int, row_no long, cells array<string>"


def workbook_rows(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """``file, sheet, sheet_no, row_no, cells`` of all sheets, or the first, of the workbooks below a path."""
    from shelfline.sources.archive import xlsx_sheets, xlsx_table

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option(
        "recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with open_input(file) as opened:
                    book = opened.read()
                for number, sheet in enumerate(xlsx_sheets(book)):
                    if number and first_only:
                        break
                    table = xlsx_table(book, sheet)
                    n = len(table)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * n, pa.string()), pa.array([sheet] * n, pa.string()),
                         pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int64()),
                         pa.array(table, pa.list_(pa.string()))],
                        names=["file", "sheet", "sheet_no", "row_no", "cells"])

    return files.mapInArrow(run, _SHEET_ROW)


def csv_rows(spark: SparkSession, path: str, block: int = split_csv.BLOCK_BYTES
             ) -> tuple[DataFrame, DataFrame]:
    """((file, row_no, cells), (file, header)) of the CSV files below a path, of any size and dialect."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
        "recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with open_input(file) as opened:
                    pieces = iter(lambda: opened.read(block), b"")
                    for number, content, ahead, lead in split_csv.cut_blocks(pieces, block):
                        yield pa.RecordBatch.from_pylist([{
                            "archive": file, "file_seq": 0, "block": number, "content": content,
                            "ahead": ahead, "lead": lead}], split_csv.schema_of(split_csv.BLOCK_ROW))

    keep = lambda df: written(df, "csv")
    records, tables = split_csv.split_tables(keep(files.mapInArrow(run, split_csv.BLOCK_ROW)), keep)
    return (records.select(F.col("archive").alias("file"), F.col("row_seq").alias("row_no"), "cells"),
            tables.where("header is not null").select(F.col("archive").alias("file"), "header"))


def read_side_files(spark: SparkSession, path: str, block: int = split_csv.BLOCK_BYTES) -> DataFrame:
    """Keyword and volume uploads below a path, CSV and first sheets of workbooks, as one table of text.

    Files may have different columns in any order.  The table has every column that some file has, under
    its trimmed name with dates as "Mon YYYY", in the order in which files sorted by name bring them;
    columns a file does not have are null in its rows, as are empty cells.  Of columns of one name in a
    file the first counts; columns without a name are left out.
    """
    records, headers = csv_rows(spark, path, block)
    sheets = workbook_rows(spark, path, first_only=True)
    heads = headers.unionByName(sheets.where("row_no = 0").select("file", F.col("cells").alias("header")))
    named = written(heads.select("file", F.transform("header", lambda h: date_header(strip_space(
        h))).alias("header")), "headers")
    # Column names of all files: as many as there are names, not files.
    places = named.select("file", F.posexplode("header").alias("at", "name")).where("name <> ''").groupBy(
        "name").agg(F.min(F.struct("file", "at")).alias("first")).orderBy("first").collect()
    rows = records.select("file", "cells").unionByName(sheets.where("row_no > 0").select("file", "cells"))
    joined = rows.join(named, "file")

    def cell(name: str):
        at = F.array_position("header", F.lit(name)).cast("int") - 1
        return F.when(at >= 0, F.nullif(F.get("cells", at), F.lit(""))).alias(name)

    return joined.select(*[cell(p["name"]) for p in places])
