"""End-to-end plans: feed to report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.operators.classify import with_category_levels
from shelfline.operators.consolidate import output_row, product_records
from shelfline.session import written


def consolidate(feed: DataFrame, dictionary: DataFrame, product_type) -> DataFrame:
    """The full report: keys plus 59 columns, one row per product of a feed.

    ``product_type`` is a type name or a column of it over ``feed_id``.  The only shuffle of feed
    rows is the one on (feed, product key).  Its products, a small part of the feed, are written to
    the shared folder: classification reads their titles first and joins back to them.
    """
    kind = product_type if hasattr(product_type, "alias") else F.lit(product_type)
    records = written(product_records(feed), "products").withColumn("product_type", kind)
    levels = with_category_levels(records, dictionary)
    return output_row(levels)
