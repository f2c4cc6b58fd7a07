"""Saved catalogues, taxonomies and side files."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.text import strip_space
from shelfline.operators.taxonomy import parse_text_taxonomy
from shelfline.sources.columns import first_of_each_column, rename_date_columns, trimmed_columns
from shelfline.sources.ordered import numbered_lines, workbook_rows


# Updates of a version before it is written anew.
DELTAS = 8


def _files(spark: SparkSession, folder: str):
    """(Hadoop file system, path) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def whole_versions(spark: SparkSession, folder: str) -> list[str]:
    """Whole versions of a snapshot, oldest first; one that was not finished does not count."""
    system, path = _files(spark, folder)
    if not system.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())
    done = [f"{folder}/{n}" for n in names if n.startswith("version-")]
    return [d for d in done if system.exists(spark._jvm.org.apache.hadoop.fs.Path(
        f"{d}/meta/_SUCCESS"))]


def save_snapshot(catalog: DataFrame, folder: str, **meta: str) -> None:
    """Write the catalogue and one row about it as a new version, then drop the versions before it.

    The facts are written last, so a version either counts as a whole or not at all.
    """
    spark = catalog.sparkSession
    table = first_of_each_column(catalog)
    before = whole_versions(spark, folder)
    version = f"{folder}/version-{time.time_ns():020d}"
    table.write.parquet(f"{version}/catalog")
    facts = [(k, str(v)) for k, v in meta.items()] + [
        (f"column:{i:04d}", c) for i, c in enumerate(table.columns)]
    spark.createDataFrame(facts, "key string, value string").coalesce(1).write.parquet(
        f"{version}/meta")
    for old in before:
        clear_snapshot(spark, old)


def update_snapshot(changed: DataFrame, folder: str, key: str, removed: DataFrame | None = None,
                    most: int = DELTAS) -> None:
    """Add rows by ``key`` to the last version, in place of rows of that key; ``removed`` keys go.

    Only the changed rows are written, as a delta of the version; a delta counts as a whole or not at
    all.  A key is one row of ``changed``.  Beyond ``most`` deltas the catalogue is written anew.
    """
    spark = changed.sparkSession
    found = whole_versions(spark, folder)
    if not found:
        raise ValueError(f"nothing was saved in {folder}")
    table, facts = load_snapshot(spark, folder)
    gone = F.lit(False).alias("_removed")
    delta = changed.select(*[F.col(f"`{c}`") for c in table.columns], gone)
    if removed is not None:
        keys = removed.select(F.col(f"`{key}`")).distinct()
        delta = delta.join(keys, key, "left_anti").unionByName(
            keys.withColumn("_removed", F.lit(True)), allowMissingColumns=True)
    names = [f"_{i}" for i in range(len(table.columns))]
    delta.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(table.columns, names)], "_removed").withColumn(
        "_key", F.lit(names[table.columns.index(key)])).write.parquet(
        f"{found[-1]}/deltas/delta-{time.time_ns():020d}")
    if len(_deltas(spark, found[-1])) > most:
        save_snapshot(load_snapshot(spark, folder)[0], folder, **facts)


def _deltas(spark: SparkSession, version: str) -> list[str]:
    system, path = _files(spark, f"{version}/deltas")
    if not system.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())
    return [f"{version}/deltas/{n}" for n in names if system.exists(
        spark._jvm.org.apache.hadoop.fs.Path(f"{version}/deltas/{n}/_SUCCESS"))]


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]] | None:
    """The last saved catalogue with its updates, and its facts; None if nothing was saved.

    Faults of the storage are raised: they do not mean that nothing was saved.
    """
    found = whole_versions(spark, folder)
    if not found:
        return None
    facts = {r["key"]: r["value"] for r in spark.read.parquet(f"{found[-1]}/meta").collect()}
    table = spark.read.parquet(f"{found[-1]}/catalog")
    columns = [facts[k] for k in sorted(facts) if k.startswith("column:")]
    names = [f"_{i}" for i in range(len(columns))]
    table = table.toDF(*names)
    for path in _deltas(spark, found[-1]):
        delta = spark.read.parquet(path)
        head = delta.select("_key").first()
        if head is not None:
            # At most DELTAS joins; what replaces and what goes is small beside the table.
            key = head["_key"]
            table = table.join(delta.select(key), table[key].eqNullSafe(delta[key]), "left_anti").unionByName(
                delta.where("not _removed").select(*names))
    return table.toDF(*columns), {k: v for k, v in facts.items() if not k.startswith("column:")}


def clear_snapshot(spark: SparkSession, folder: str) -> bool:
    """Remove a saved catalogue through the file system it lies on."""
    system, path = _files(spark, folder)
    return system.delete(path, True)


def write_report(report: DataFrame, path: str, form: str = "csv") -> None:
    """The report's columns in order, as CSV with a header or as parquet."""
    writer = report.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy saved as CSV with ``product_type, Level 1, Level 2, Level 3``."""
    raw = trimmed_columns(spark.read.csv(path, header=True))
    return raw.select("product_type", *[F.col(f"`Level {i}`").alias(f"level{i}")
                                        for i in (1, 2, 3)])


def read_taxonomy_workbooks(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """Taxonomy workbooks: one sheet per product type, its first row the header.

    With ``places`` also where a row stands: ``file, sheet_no, row_no``, rows from 1.
    """
    rows = workbook_rows(spark, path)
    # A sheet is read by one task, which passes on its rows with the sheet's header.
    heads = rows.where("row_no = 0").select("file", "sheet_no", F.transform(
        "cells", lambda c: strip_space(c)).alias("header"))

    def level(i: int) -> Column:
        at = F.array_position("header", F.lit(f"Level {i}")).cast("int") - 1
        return F.when(at >= 0, F.nullif(F.get("cells", at), F.lit(""))).alias(f"level{i}")

    found = rows.where("row_no > 0").join(heads, ["file", "sheet_no"])
    where = ["file", "sheet_no", "row_no"] if places else []
    return found.select(*where, F.col("sheet").alias("product_type"), *[level(i) for i in (1, 2, 3)])


def read_text_taxonomy(spark: SparkSession, path: str, types=None) -> DataFrame:
    """A text taxonomy file, its paths in the order of its lines."""
    return parse_text_taxonomy(numbered_lines(spark, path), types)


def _workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, its first row the header, all text."""
    import pyarrow as pa

    from shelfline.sources.archive import xlsx_table

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                table = xlsx_table(content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(table)), pa.int64()), pa.array(table, pa.list_(pa.string()))],
                    names=["row_no", "cells"])

    cells = spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        rows, "row_no long, cells array<string>")
    header = cells.where("row_no = 0").first()["cells"]
    return cells.where("row_no > 0").select(*[
        F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(header)])


def read_side_file(spark: SparkSession, path: str) -> DataFrame:
    """A keyword or volume upload, CSV or XLSX: trimmed headers, dates as "Mon YYYY", all text."""
    raw = (_workbook(spark, path) if path.lower().endswith(".xlsx")
           else spark.read.csv(path, header=True))
    return first_of_each_column(rename_date_columns(trimmed_columns(raw)))
