"""Catalogue counters and seasonal peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.peaks import peak_months


def has_keyword(keyword: Column) -> Column:
    """A keyword that is neither null nor blank; null comes from blank cells of a saved file."""
    return F.coalesce(keyword, F.lit("")) != ""


def catalog_stats(catalog: DataFrame, category: str = "level3", keyword: str = "keyword"
                  ) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("total_products"),
        F.countDistinct(category).alias("categories_count"),
        F.count_if(has_keyword(F.col(keyword))).alias("keywords_generated"))


def category_breakdown(catalog: DataFrame, *columns: str) -> DataFrame:
    """Products per value of one or more columns (categories, availability)."""
    return catalog.groupBy(*columns).agg(F.count("*").alias("products"))


def zero_volume_rate(volumes: DataFrame, volume: str = "volume") -> DataFrame:
    """Share of keywords whose volume is zero."""
    return volumes.agg(F.count("*").alias("keywords"),
                       F.count_if(F.col(volume) == 0).alias("zero_volume"),
                       F.avg(F.when(F.col(volume) == 0, 1.0).otherwise(0.0)).alias("zero_rate"))


def peak_seasonality(long: DataFrame, ids: list[str]) -> DataFrame:
    """Stable months among the four with the highest mean volume.

    The definition is ours: mean volume per calendar month, then the peak rule on descending means.
    Volumes are whole search counts, so their sums are exact in any order.
    """
    mean = lambda m: F.avg(F.when(F.col("month") == m, F.col("volume"))).alias(m)
    means = long.groupBy(*ids).agg(*[mean(m) for m in fv.MONTHS])
    return means.select(*ids, peak_months(
        [(m, F.col(m)) for m in fv.MONTHS], lowest_first=False).alias("peak_seasonality"))
