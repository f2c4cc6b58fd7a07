"""Twelve monthly feeds to one row per product.

Input is one long feed: ``feed_id, month, file_seq, row_seq, title, brand, availability, price,
popularity_rank``.  ``file_seq`` is the file's place in its archive and ``row_seq`` the row's place
in its file, so "first" is a value in the data and survives any shuffle.

Everything a product needs (its first title and brand, its twelve ranks, its December price and
availability) is one aggregation on (feed, product key): the feed is scanned and shuffled once, and
partial aggregation collapses a hot product before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.peaks import peak_popularity, to_number
from shelfline.functions.text import product_key

KEYS = ["feed_id", "product_key"]


def popularity_column(month: str) -> str:
    return f"Product Popularity {month}"


VOLUME_COLUMNS = [f"{m} {y}" for y in fv.VOLUME_YEARS for m in fv.MONTHS]
OUTPUT_COLUMNS = (
    ["Product Title", "Product Max Price", "Product Category L1", "Product Category L2",
     "Product Category L3", "Product Keyword", "Product Keyword Avg MSV", "Product Brand",
     "Availability"]
    + [popularity_column(m) for m in fv.MONTHS]
    + VOLUME_COLUMNS
    + ["Peak Seasonality", "Peak Popularity"])


def with_product_key(df: DataFrame, title: str = "title") -> DataFrame:
    """Add the key and drop rows whose title leaves nothing to key on."""
    # Asking the title for one key character is the same test as a non-empty key, and pushing it
    # down does not build the key a second time.
    return (df.filter(F.lower(F.col(title)).rlike("[a-z0-9]"))
            .withColumn("product_key", product_key(F.col(title))))


def _first_product() -> Column:
    return F.min_by(F.struct("title", "brand"), F.struct("file_seq", "row_seq")).alias("first")


def _month_rank(month: str) -> Column:
    # A null ordering value is ignored, so the condition picks the month inside one aggregation;
    # the first row of the month wins even when its own rank is null.
    return F.min_by(to_number(F.col("popularity_rank")),
                    F.when(F.col("month") == month, F.col("row_seq"))
                    ).alias(popularity_column(month))


def _december() -> Column:
    return F.min_by(F.struct("price", "availability"),
                    F.when(F.col("month") == "Dec", F.col("row_seq"))).alias("december")


def price_text(price: Column) -> Column:
    return F.coalesce(price.cast("string"), F.lit(fv.NO_PRICE))


def availability_text(availability: Column) -> Column:
    return F.when(F.trim(availability) != "", availability).otherwise(F.lit(fv.NO_AVAILABILITY))


def master_products(feed: DataFrame) -> DataFrame:
    """First title and brand per product, in archive order then row order."""
    return (with_product_key(feed).groupBy(*KEYS).agg(_first_product())
            .select(*KEYS, F.col("first.title").alias("title"), F.col("first.brand").alias("brand")))


def monthly_ranks(feed: DataFrame) -> DataFrame:
    """The first row's rank per product and month, long form."""
    return (with_product_key(feed).groupBy(*KEYS, "month")
            .agg(F.min_by(to_number(F.col("popularity_rank")), "row_seq").alias("popularity_rank")))


def december_attributes(feed: DataFrame) -> DataFrame:
    """The first December row's price and availability per product, with their defaults."""
    return (with_product_key(feed.filter(F.col("month") == "Dec")).groupBy(*KEYS)
            .agg(F.min_by(F.struct("price", "availability"), "row_seq").alias("december"))
            .select(*KEYS, price_text(F.col("december.price")).alias("price"),
                    availability_text(F.col("december.availability")).alias("availability")))


def popularity_pivot(feed: DataFrame) -> DataFrame:
    """One row per product with its twelve monthly ranks."""
    return with_product_key(feed).groupBy(*KEYS).agg(*[_month_rank(m) for m in fv.MONTHS])


def with_peak_popularity(wide: DataFrame) -> DataFrame:
    columns = {m: popularity_column(m) for m in fv.MONTHS}
    return wide.withColumn("Peak Popularity", peak_popularity(columns))


def product_records(feed: DataFrame) -> DataFrame:
    """Master list, December attributes and monthly ranks in a single aggregation."""
    grouped = with_product_key(feed).groupBy(*KEYS).agg(
        _first_product(), _december(), *[_month_rank(m) for m in fv.MONTHS])
    return grouped.select(
        *KEYS,
        F.col("first.title").alias("title"),
        F.col("first.brand").alias("brand"),
        price_text(F.col("december.price")).alias("price"),
        availability_text(F.col("december.availability")).alias("availability"),
        *[F.col(popularity_column(m)) for m in fv.MONTHS])


def output_row(records: DataFrame) -> DataFrame:
    """The report's columns in their order; columns still to be filled are blank text."""
    blank = F.lit("")
    filled = records.select(
        *[c for c in records.columns if c in KEYS],
        F.col("title").alias("Product Title"),
        F.col("price").alias("Product Max Price"),
        F.col("level1").alias("Product Category L1"),
        F.col("level2").alias("Product Category L2"),
        F.col("level3").alias("Product Category L3"),
        blank.alias("Product Keyword"),
        blank.alias("Product Keyword Avg MSV"),
        F.col("brand").alias("Product Brand"),
        F.col("availability").alias("Availability"),
        *[F.col(popularity_column(m)) for m in fv.MONTHS],
        *[blank.alias(c) for c in VOLUME_COLUMNS],
        blank.alias("Peak Seasonality"))
    return with_peak_popularity(filled)


def in_output_order(df: DataFrame, order=None) -> DataFrame:
    """The listed columns that exist, in list order; everything else is left out."""
    return df.select(*[F.col(f"`{c}`") for c in (order or OUTPUT_COLUMNS) if c in df.columns])
