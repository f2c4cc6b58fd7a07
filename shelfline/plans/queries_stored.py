"""Queries: files made from the given tables, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.operators import consolidate as co
from shelfline.plans import views
from shelfline.plans.queries_archive import csv_bytes, workbook, written_uploads
from shelfline.plans.queries_catalog import LINES
from shelfline.plans.registry import quoted, query
from shelfline.session import shared_folder
from shelfline.sources import columns as sc
from shelfline.sources import ordered
from shelfline.sources import reports
from shelfline.sources import snapshot as sn

# Parts whose rows go to one file.
BUCKET = 1000


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("text_taxonomy_file", f"""with lines as (select p_partkey, trim(v) as v from (
 select p_partkey, {LINES.replace('as value', 'as v')} from part)),
kept as (select p_partkey, trim(substr(v, strpos(v, ' - ') + 3)) as path from lines
 where v <> '' and not starts_with(v, '#') and contains(v, ' - ')),
typed as (select p_partkey, case string_split(path, ' > ')[1]
  {' '.join(f"when '{k}' then '{v}'" for k, v in fv.TOP_LEVEL_TYPES.items())} end as product_type,
  path from kept where string_split(path, ' > ')[1] in ({quoted(fv.TOP_LEVEL_TYPES)}))
select product_type, path, row_number() over (partition by product_type order by p_partkey) - 1 as pos
 from typed""")
def _(spark, sf):
    """Lines in the order of keys over several files, whose names sort in that order."""
    folder = _folder(spark, "lines")
    views.select_from(spark, sf, "part", f"p_partkey, {LINES}").repartitionByRange(
        4, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(folder)
    return sn.read_text_taxonomy(spark, folder).withColumn("pos", F.col("pos").cast("bigint"))


SHEETS = f"""'shelves/' || cast(floor(p_partkey / {BUCKET}) as bigint) as upload, p_partkey,
 case when p_size % 3 = 0 then 'Toys' else 'Pets & Co' end as kind, p_brand as one,
 case when p_size > 40 then null else p_name end as two, case when p_size > 30 then null else p_type end as three"""


def taxonomy_book(own) -> bytes:
    """A sheet for each kind; one kind has its columns in another order, with blanks around a name."""
    own = own.sort_values("p_partkey")
    sheets = {}
    for kind in ("Toys", "Pets & Co"):
        rows = own[own["kind"] == kind]
        if kind == "Toys":
            sheets[kind] = [["Level 1", "Level 2", "Level 3"], *rows[["one", "two", "three"]].values.tolist()]
        else:
            sheets[kind] = [["Level 3", "Note", " Level 1", "Level 2 "], *[
                [c, "x", a, b] for a, b, c in rows[["one", "two", "three"]].values.tolist()]]
    return workbook(sheets)


@query("taxonomy_workbook", f"""select upload as file, kind as product_type,
 row_number() over (partition by upload, kind order by p_partkey) as row_no, one as level1, two as level2,
 three as level3 from (select {SHEETS} from part)""")
def _(spark, sf):
    folder = written_uploads(views.select_from(spark, sf, "part", SHEETS), taxonomy_book, ".xlsx")
    rows = sn.read_taxonomy_workbooks(spark, folder, places=True)
    return rows.drop("sheet_no").withColumn("file", F.regexp_extract("file", "(shelves/[0-9]+)[.]xlsx$", 1))


SIDE = f"""'side/' || cast(floor(p_partkey / {BUCKET // 4}) as bigint) as upload, p_partkey,
 {views.TITLE} as title, case when p_size > 40 then null else p_name || ', "' || p_brand || '"' end as keyword,
 p_size || '' as size, p_retailprice || '' as price"""
_ODD = f"cast(floor(p_partkey / {BUCKET // 4}) as bigint) % 2 = 1"


def _odd(own) -> bool:
    return int(own["upload"].iloc[0].split("/")[1]) % 2 == 1


def side_csv(own) -> bytes:
    own = own.sort_values("p_partkey")
    if _odd(own):
        table = [["2024-03-01 00:00:00", "Product Keyword", " Product Title ", "Product Title"], *[
            [p, k, t, "second"] for t, k, p in own[["title", "keyword", "price"]].values.tolist()]]
        return csv_bytes(table, "utf-16", ";")
    table = [["Product Title", "Product Keyword", "2023-01-01", "Product Keyword Avg MSV"],
             *own[["title", "keyword", "size", "price"]].values.tolist()]
    return csv_bytes(table, "utf-8", ",", 1)


def side_book(own) -> bytes:
    own = own.sort_values("p_partkey")
    table = [["Product Title", "", "Peak Seasonality"], *[[t, "no", s] for t, s in own[
        ["title", "size"]].values.tolist()]]
    return workbook({"Upload": table, "Other": [["Left", "Out"], ["a", "b"]]})


@query("side_files", f"""with s as (select *, {_ODD} as odd from (select {SIDE} from part))
select title as "Product Title", keyword as "Product Keyword", case when not odd then size end as "Jan 2023",
 case when not odd then price end as "Product Keyword Avg MSV", case when odd then price end as "Mar 2024",
 null::varchar as "Peak Seasonality" from s
union all select title, null, null, null, null, size from s""")
def _(spark, sf):
    """Uploads with differing columns, dialects and forms, as one table."""
    rows = views.select_from(spark, sf, "part", SIDE)
    folder = written_uploads(rows, side_csv, ".csv")
    books = written_uploads(rows, side_book, ".xlsx")
    names = ["Product Title", "Product Keyword", "Jan 2023", "Product Keyword Avg MSV", "Mar 2024",
             "Peak Seasonality"]
    found = ordered.read_side_files(spark, folder, block=16 << 10).unionByName(
        ordered.read_side_files(spark, books), allowMissingColumns=True)
    if set(found.columns) - set(names):
        return found
    # A small table may bring no file of one of the kinds.
    return found.select(*[F.col(n) if n in found.columns else F.lit(None).cast("string").alias(n) for n in names])


REPORT = f"""p_partkey * 7 as row_id, {views.TITLE} as "Product Title", p_brand as "Product Brand",
 case when p_size > 40 then null when p_size > 30 then '' else p_name || ',' || chr(34) || chr(10) || p_type end
 as "Product Keyword", p_size || '' as "Jan 2023", p_retailprice || '' as "Avg MSV" """


@query("report_roundtrip", f"""with r as (select {REPORT} from part)
select "Product Title", "Product Keyword", "Product Brand", "Jan 2023",
 row_number() over (order by row_id) - 1 as ordinal, 'Jan 2023' as monthly from r""")
def _(spark, sf):
    """Columns out of order and of others, in the report's order; names blurred on the way out."""
    folder = _folder(spark, "report")
    rows = views.select_from(spark, sf, "part", REPORT.replace('"', "`"))
    report = co.in_output_order(rows, ["row_id", *co.OUTPUT_COLUMNS])
    blurred = {"Product Title": " Product Title ", "Jan 2023": "2023-01-01 00:00:00"}
    twice = report.withColumn("again", F.lit("second"))
    reports.save_report(twice.limit(1), folder)
    reports.save_report(twice, folder, rows=BUCKET, names=[
        *[blurred.get(c, c) for c in report.columns if c != "row_id"], "Product Title"])
    table, _ = reports.load_report(spark, folder)
    return table.withColumn("monthly", F.lit(", ".join(sc.volume_columns(table.columns)["monthly"])))


@query("report_manifest", f"""select (place // {BUCKET})::bigint as file_no, min(place) as first,
 count(*) as rows from (select row_number() over (order by p_partkey) - 1 as place from part)
 group by all""")
def _(spark, sf):
    folder = _folder(spark, "report")
    reports.save_report(views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), "p_name"), folder, rows=BUCKET)
    return reports.load_report(spark, folder)[1].select("file_no", "first", "rows")


@query("snapshot_delta", """select p_partkey as "Row Id", case when p_size > 45 then 'second'
 when p_size > 40 then 'first' else p_name end as "Product Title" from part where p_size <> 7
union all select -p_partkey, 'added' from part where p_size = 1""")
def _(spark, sf):
    """A catalogue, two updates and keys that went, put together on reading."""
    parts, folder = views.table(spark, sf, "part"), _folder(spark, "snapshot")
    row = lambda df, title, key=F.col("p_partkey"): df.select(key.alias("Row Id"), title.alias("Product Title"))
    sn.save_snapshot(row(parts, F.col("p_name")), folder, product_type="BWS")
    sn.update_snapshot(row(parts.where("p_size > 40"), F.lit("first")).unionByName(
        row(parts.where("p_size = 1"), F.lit("added"), -F.col("p_partkey"))), folder, "Row Id")
    sn.update_snapshot(row(parts.where("p_size > 45"), F.lit("second")), folder, "Row Id",
                       removed=row(parts.where("p_size = 7"), F.lit("")))
    return sn.load_snapshot(spark, folder)[0]
