import pytest
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.peaks import peak_months, to_number
from shelfline.functions.text import product_key
from shelfline.operators import consolidate as co
from shelfline.operators import merge
from shelfline.plans import views
from shelfline.plans.catalog import consolidate

SCHEMA = ("feed_id string, month string, file_seq long, row_seq long, title string, brand string, "
          "availability string, price string, popularity_rank string")


def feed(spark, *rows):
    return spark.createDataFrame([("f",) + r for r in rows], SCHEMA)


def test_product_key(spark):
    titles = [("Jack Daniel's  No.7", "jack daniels no7"), ("Whispering Angel Rosé",
              "whispering angel ros"), ("A B", "a b"), ("!!!", ""), (None, ""), (" x ", "x")]
    df = spark.createDataFrame(titles, "t string, want string")
    for row in df.select(product_key(F.col("t")).alias("k"), "want").collect():
        assert row.k == row.want


def test_first_title_follows_archive_order_not_calendar(spark):
    rows = [("Jan", 1, 0, "Red Wine!", "Y", "in", "2", "1"),
            ("Feb", 0, 1, "red wine", "X2", "in", "1", "2"),
            ("Feb", 0, 0, "RED wine", "X", "in", "1", "3"),
            ("Feb", 0, 2, "???", "Z", "in", "1", "3")]
    for parts in (1, 4):
        got = co.master_products(feed(spark, *rows).repartition(parts)).collect()
        assert [(r.product_key, r.title, r.brand) for r in got] == [("red wine", "RED wine", "X")]


def test_first_row_of_a_month_wins_even_when_null(spark):
    df = feed(spark, ("Jan", 0, 0, "a", "b", None, None, None),
              ("Jan", 0, 1, "A", "b", None, None, "5"), ("Feb", 1, 0, "a", "b", None, None, "7"))
    row = co.popularity_pivot(df).first()
    assert row["Product Popularity Jan"] is None and row["Product Popularity Feb"] == 7.0
    assert {(r.month, r.popularity_rank) for r in co.monthly_ranks(df).collect()} == {
        ("Jan", None), ("Feb", 7.0)}


def test_december_defaults(spark):
    df = feed(spark, ("Dec", 0, 0, "a", "b", "  ", None, "1"), ("Dec", 0, 1, "a", "b", "in", "3", "1"),
              ("Dec", 0, 2, "c", "b", " yes ", "4.50", "1"), ("Jan", 1, 0, "only jan", "b", "in", "3", "1"))
    rows = {r.product_key: r for r in co.product_records(df).collect()}
    assert (rows["a"].price, rows["a"].availability) == (fv.NO_PRICE, fv.NO_AVAILABILITY)
    assert (rows["c"].price, rows["c"].availability) == ("4.50", " yes ")
    assert (rows["only jan"].price, rows["only jan"].availability) == ("N/A", "Potential Gap")


@pytest.mark.parametrize("ranks, want", [
    ([1, 2], ""), ([1, 2, 3, 10], "Jan, Feb, Mar"), ([1, 1, 3, 3], "Jan, Feb, Mar, Apr"),
    ([5, 50, 51, 52, 900], "Feb, Mar, Apr"), ([], ""), ([7, 7, 7], "Jan, Feb, Mar"),
    ([9, 8, 7, 6, 5, 4, 3, 2, 1], "Aug, Jul")])
def test_peak_months(spark, ranks, want):
    cells = [F.lit(float(r)) for r in ranks] + [F.lit(None).cast("double")] * (12 - len(ranks))
    got = spark.range(1).select(peak_months(list(zip(fv.MONTHS, cells))).alias("p")).first().p
    if want:
        assert got == want if ranks != [9, 8, 7, 6, 5, 4, 3, 2, 1] else set(
            got.split(", ")) == {"Aug", "Jul"}
    else:
        assert got == ""


def test_to_number(spark):
    texts = [("12", 12.0), (" 3.5 ", 3.5), ("1e2", 100.0), ("1d", None), ("n/a", None), ("", None),
             (None, None), ("-4", -4.0), (".5", 0.5)]
    df = spark.createDataFrame(texts, "t string, want double")
    assert all(r.n == r.want for r in df.select(to_number(F.col("t")).alias("n"), "want").collect())


def test_report_has_59_columns_in_order(spark, tables):
    report = consolidate(views.monthly_feed(spark, tables), views.dictionary(spark, tables), "BWS")
    ordered = co.in_output_order(report)
    assert ordered.columns == co.OUTPUT_COLUMNS and len(ordered.columns) == 59
    first = {r["p"] for r in report.select(F.col("Peak Popularity").alias("p")).collect()}
    assert len(first) > 10


def test_consolidation_shuffles_the_feed_once(spark, tables):
    feed = views.monthly_feed(spark, tables)
    plan = co.product_records(feed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(feed_id") == 1
    report = consolidate(feed, views.dictionary(spark, tables), "BWS")
    rest = report._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in rest  # the feed is not read again
    for node in ("NestedLoopJoin", "CartesianProduct", "Python"):
        assert node not in plan and node not in rest


def test_volumes_are_made_wide_after_they_are_dealt_by_id(spark):
    """No wide row is held ahead of the last shuffle, where each task would have one of nearly every id."""
    rows = [(1, 2023, "Jan", 2.0), (1, 2023, "Jan", 3.0), (1, 2024, "Dec", None), (2, None, "Jan", 7.0),
            (None, 2024, "Feb", 4.0), (3, 2024, None, 1.0), (3, 2024, "Dec", 6.0)]
    long = spark.createDataFrame(rows, "row_id int, year int, month string, volume double")
    wide = merge.volumes_wide(long, ["row_id"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    last = plan.index("Exchange hashpartitioning(row_id")
    assert "2023" in plan[:last] and "2023" not in plan[last:]
    got = {r.row_id: {c: v for c, v in r.asDict().items() if v is not None and c != "row_id"}
           for r in wide.collect()}
    assert len(wide.columns) == 25 and wide.count() == 4
    assert got == {1: {"Jan 2023": 5.0}, 2: {}, None: {"Feb 2024": 4.0}, 3: {"Dec 2024": 6.0}}
