"""Reports as ordered files of bounded size, with a manifest.

A report is a version: its files, numbered in the report's order, and a manifest that names the columns
and says which rows each file holds.  The manifest is written last and makes the version count; the
versions before it go then.  Column names may be repeated or untrimmed, as they are in uploads: files
hold columns by place and the manifest their names.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.batches import with_ordinal
from shelfline.sources.columns import first_of_each_column, rename_date_columns, trimmed_columns
from shelfline.sources.snapshot import clear_snapshot, whole_versions

FILE_ROWS = 100_000
# Nulls are told from empty text, and text may hold quotes and line ends.
_CSV = {"nullValue": "\\N", "escape": '"', "quote": '"', "multiLine": "true"}


def save_report(report: DataFrame, folder: str, row_id: str = "row_id", rows: int = FILE_ROWS,
                names: list[str] | None = None) -> None:
    """Write a report in ``row_id`` order, ``rows`` rows a file, as a new version.

    ``row_id`` is unique and not negative; it is not part of the report.  ``names`` are the columns'
    names in the report, their own by default.
    """
    spark = report.sparkSession
    columns = [c for c in report.columns if c != row_id]
    before = whole_versions(spark, folder)
    version = f"{folder}/version-{time.time_ns():020d}"
    placed = with_ordinal(report.select(F.col(f"`{row_id}`").alias("row_id"), *[
        F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(columns)]))
    numbered = placed.withColumn("file_no", F.floor(F.col("ordinal") / rows).cast("long")).drop("row_id")
    numbered.repartition("file_no").sortWithinPartitions("file_no", "ordinal").write.options(
        **_CSV).partitionBy("file_no").csv(f"{version}/files")
    written = _files_of(spark, version, len(columns))
    held = written.groupBy("file_no").agg(F.min("ordinal").alias("first"), F.count("*").alias("rows"))
    held.withColumn("names", F.array(*[F.lit(n) for n in names or columns])).coalesce(1).write.parquet(
        f"{version}/meta")
    for old in before:
        clear_snapshot(spark, old)


def _files_of(spark: SparkSession, version: str, columns: int) -> DataFrame:
    schema = ", ".join([*[f"_{i} string" for i in range(columns)], "ordinal long"])
    path = f"{version}/files"
    return spark.read.options(**_CSV).schema(schema + ", file_no long").csv(path)


def load_report(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(rows with their ``ordinal``, manifest) of the last version; None if nothing was saved.

    Names are trimmed, dates become "Mon YYYY", and of columns of one name the first stays.  Files that
    do not hold what the manifest says are an error.
    """
    found = whole_versions(spark, folder)
    if not found:
        return None
    manifest = spark.read.parquet(f"{found[-1]}/meta")
    head = manifest.first()
    if head is None:
        return spark.createDataFrame([], "ordinal long"), manifest
    names = head["names"]
    rows = _files_of(spark, found[-1], len(names))
    told = rows.groupBy("file_no").count().join(manifest, "file_no", "full").where(
        "not (count <=> rows)").limit(1).count()
    if told:
        raise ValueError(f"{found[-1]}: files do not hold what the manifest says")
    table = rows.select(*[f"_{i}" for i in range(len(names))], "ordinal").toDF(*names, "ordinal")
    return first_of_each_column(rename_date_columns(trimmed_columns(table))), manifest
