"""Side files merged into a catalogue, and volumes in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.operators.consolidate import VOLUME_COLUMNS
from shelfline.operators.metrics import peak_seasonality
from shelfline.sources.columns import volume_columns


def _one_per_title(side: DataFrame, title: str, order: str | None) -> DataFrame:
    """One row per title: the first by ``order``, or the smallest row where none is given."""
    values = F.struct(*[c for c in side.columns if c not in (title, order)])
    pick = F.min_by(values, F.col(order)) if order else F.min(values)
    return side.groupBy(title).agg(pick.alias("_v")).select(title, "_v.*")


def cached_keywords(catalog: DataFrame, cache: DataFrame, title: str = "title",
                    keyword: str = "keyword", order: str | None = None) -> DataFrame:
    """Fill the keyword from a cache by title where the cache holds one."""
    held = _one_per_title(cache.select(title, F.col(keyword).alias("_cached"),
                                       *([order] if order else [])), title, order)
    joined = catalog.join(held, title, "left")
    kept = F.coalesce("_cached", keyword) if keyword in catalog.columns else F.col("_cached")
    return joined.select(*[c for c in catalog.columns if c != keyword], kept.alias(keyword))


def additive_merge(catalog: DataFrame, upload: DataFrame, title: str = "title",
                   keyword: str = "keyword", order: str | None = None) -> DataFrame:
    """Add the upload's new columns by title; of the existing ones only the keyword changes.

    Titles the upload does not hold keep their keyword.
    """
    new = [c for c in upload.columns if c not in catalog.columns and c != order]
    side = upload.select(title, F.col(keyword).alias("_uploaded"),
                         *[F.col(f"`{c}`") for c in new if c != keyword],
                         *([order] if order else []))
    joined = catalog.join(_one_per_title(side, title, order), title, "left")
    kept = F.coalesce("_uploaded", keyword) if keyword in catalog.columns else F.col("_uploaded")
    return joined.select(*[F.col(f"`{c}`") for c in catalog.columns if c != keyword],
                         kept.alias(keyword), *[F.col(f"`{c}`") for c in new if c != keyword])


def fill_report(report: DataFrame, keywords: DataFrame, volumes: DataFrame,
                title: str = "Product Title") -> DataFrame:
    """Put keyword, average volume, month volumes and peak seasonality into a report.

    ``keywords`` has a title and its ``keyword``, ``volumes`` has ``keyword, year, month, volume``.
    Titles without a keyword keep theirs; months without a volume stay blank.  The average is over
    all months there are, within the report's years and outside.  All other columns stay.
    """
    wide = volumes_wide(volumes, ["keyword"], fv.VOLUME_YEARS)
    means = volumes.groupBy("keyword").agg(F.avg("volume").alias("_mean"))
    measured = wide.join(means, "keyword").join(peak_seasonality(volumes, ["keyword"]), "keyword")
    side = _one_per_title(keywords.select(title, "keyword"), title, None).join(
        measured, "keyword", "left").select(
        F.col(title).alias("_title"), F.col("keyword").alias("_keyword"), "_mean",
        "peak_seasonality", *[F.col(f"`{c}`").alias(f"_{c}") for c in VOLUME_COLUMNS])
    filled = {"Product Keyword": "_keyword", "Product Keyword Avg MSV": "_mean",
              "Peak Seasonality": "peak_seasonality", **{c: f"_{c}" for c in VOLUME_COLUMNS}}
    joined = report.join(side, F.col(f"`{title}`") == F.col("_title"), "left")
    return joined.select(*[F.coalesce(F.col(f"`{filled[c]}`").cast("string"), F.col(f"`{c}`")).alias(c)
                           if c in filled else F.col(f"`{c}`") for c in report.columns])


def volumes_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Every "Mon YYYY" column to ``ids, year, month, volume``; blank volumes are left out."""
    present = volume_columns(wide.columns)["monthly"]
    if not present:
        return wide.select(*ids).limit(0).select(
            *ids, F.lit(0).alias("year"), F.lit("").alias("month"), F.lit(0.0).alias("volume"))
    cells = F.array(*[F.struct(F.lit(int(c[-4:])).alias("year"), F.lit(c[:3]).alias("month"),
                               F.col(f"`{c}`").try_cast("double").alias("volume"))
                      for c in present])
    return (wide.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.*")
            .filter("volume is not null"))


def volumes_wide(long: DataFrame, ids: list[str], years: list[int] | None = None,
                 summed: bool = False) -> DataFrame:
    """Month columns of the given years, by default of all years there are.

    Cells are summed first, then dealt by id, so that one task holds the wide rows of its own ids only: a
    combine ahead of that shuffle would hold a wide row for nearly every id in every task.  ``summed``: the
    caller has summed the cells, one row for each id and month.  Finding the years is a small job of its own;
    a report asks for ``fixed_values.VOLUME_YEARS``.
    """
    if years is None:
        years = sorted(r[0] for r in long.select("year").where("year is not null").distinct()
                       .collect())
    cell = lambda m, y: F.sum(F.when((F.col("month") == m) & (F.col("year") == y),
                                     F.col("volume"))).alias(f"{m} {y}")
    cells = long if summed else long.groupBy(*ids, "year", "month").agg(F.sum("volume").alias("volume"))
    return cells.repartition(*ids).groupBy(*ids).agg(*[cell(m, y) for y in years for m in fv.MONTHS])
