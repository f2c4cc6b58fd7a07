"""Queries: file names, headers, side files, counters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.operators import classify as cl
from shelfline.operators import consolidate as co
from shelfline.operators import merge as me
from shelfline.operators import metrics as mt
from shelfline.plans import views
from shelfline.plans.queries_catalog import DECEMBER, PEAKS
from shelfline.plans.registry import DICTIONARY, FEED, PRODUCTS, default_level1_sql, matches, query
from shelfline.session import shared_folder
from shelfline.sources import columns as sc
from shelfline.sources import filenames as fn
from shelfline.sources import snapshot as sn

_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast(month(o_orderdate) as int) - 2, 3)"
_LONG = ("split_part('January,February,March,April,May,June,July,August,September,October,November,"
         "December', ',', cast(month(o_orderdate) as int))")
FILE_COLUMNS = f"""o_orderkey as file_seq, o_custkey as archive,
 case o_orderpriority when '1-URGENT' then {_MON} || '-' || year(o_orderdate) || '.csv'
  when '2-HIGH' then 'BWS ' || {_LONG} || ' ' || year(o_orderdate) || '.xlsx'
  when '3-MEDIUM' then case when month(o_orderdate) = 9 then 'SEPT' else upper({_MON}) end || ' '
   || year(o_orderdate) || '.CSV'
  when '4-NOT SPECIFIED' then 'BWS ' || {_MON} || '-' || year(o_orderdate) || '.csv'
  else 'Foo-' || year(o_orderdate) || '.csv' end as file_name,
 case when o_totalprice < 50000 then 'no table' end as error"""

_PARSED = rf"""files as (select {FILE_COLUMNS} from orders),
shaped as (select *, case
  when regexp_matches(file_name, '{fv.FILE_NAME_PATTERNS[0]}', 'i')
   then regexp_extract(file_name, '{fv.FILE_NAME_PATTERNS[0]}', ['m', 'y', 'e'], 'i')
  when regexp_matches(file_name, '{fv.FILE_NAME_PATTERNS[1]}', 'i')
   then regexp_extract(file_name, '{fv.FILE_NAME_PATTERNS[1]}', ['m', 'y', 'e'], 'i')
  when regexp_matches(file_name, '{fv.FILE_NAME_PATTERNS[2]}', 'i')
   then regexp_extract(file_name, '{fv.FILE_NAME_PATTERNS[2]}', ['m', 'y', 'e'], 'i') end as g
  from files),
named as (select *, upper(left(g.m, 1)) || lower(substr(g.m, 2)) as spelled from shaped),
standard as (select *, case spelled
  {' '.join(f"when '{k}' then '{v}'" for k, v in fv.MONTH_ALIASES.items())} else spelled end as mon
  from named),
parsed as (select file_seq, archive, file_name, error,
  case when mon in ({', '.join(f"'{m}'" for m in fv.MONTHS)}) then mon end as month,
  case when mon in ({', '.join(f"'{m}'" for m in fv.MONTHS)}) then cast(g.y as int) end as year,
  case when mon in ({', '.join(f"'{m}'" for m in fv.MONTHS)}) then lower(g.e) end as extension
  from standard)"""


def _files(spark, sf):
    return fn.with_file_parts(views.select_from(spark, sf, "orders", FILE_COLUMNS))


@query("filename_parse", f"""with {_PARSED} select file_seq, file_name, month,
 cast(year as bigint) as year, extension from parsed""")
def _(spark, sf):
    return _files(spark, sf).select("file_seq", "file_name", "month",
                                    F.col("year").cast("bigint").alias("year"), "extension")


_STATUS = f"""{_PARSED}, taken as (select archive, month, min(file_seq) as first_seq from parsed
  where month is not null and error is null group by all),
status as (select p.*, case when p.month is null then '{fv.BAD_NAME}' || file_name
  when file_seq > first_seq then '{fv.SECOND_OF_MONTH}' || p.month
  when error is not null then '{fv.UNREADABLE}' || file_name || ': ' || error end as issue
  from parsed p left join taken t on p.archive = t.archive and p.month = t.month)"""


@query("duplicate_month_issues", f"""with {_STATUS} select archive, file_seq, issue from status
 where issue is not null""")
def _(spark, sf):
    return fn.file_status(_files(spark, sf)).filter("issue is not null").select(
        "archive", "file_seq", "issue")


@query("accepted_files", f"""with {_STATUS} select archive, file_seq, month from status
 where issue is null""")
def _(spark, sf):
    return fn.file_status(_files(spark, sf)).filter("accepted").select(
        "archive", "file_seq", "month")


@query("missing_december", f"""with {_STATUS} select distinct archive, 'Dec' as month from status
 where issue is null and archive not in (select archive from status where issue is null
  and month = 'Dec')""")
def _(spark, sf):
    accepted = fn.file_status(_files(spark, sf)).filter("accepted")
    return sc.missing_months(accepted, ["archive"])


@query("month_numbers", f"""with {_PARSED} select spelled as month, cast(coalesce(list_position(
 [{', '.join(f"'{m}'" for m in fv.MONTHS)}], spelled), 0) as bigint) as month_no, count(*) as files
 from standard where spelled is not null group by all""")
def _(spark, sf):
    first = F.regexp_extract("file_name", r"(?i)([A-Za-z]{3,9})[-\s]+\d{4}\.(xlsx|csv)$", 1)
    names = _files(spark, sf).filter("file_name not like 'BWS ___-%'").select(
        F.initcap(F.lower(first)).alias("month"))
    return names.select("month", fn.month_number(F.col("month")).cast("bigint").alias("month_no")
                        ).groupBy("month", "month_no").agg(F.count("*").alias("files"))


HEADERS = """c_custkey as file_id, case c_mktsegment
 when 'BUILDING' then 'Title,Brand,Availability,Price range max.,Popularity rank'
 when 'AUTOMOBILE' then ' product title ,BRAND,availability,Price range max..,Popularity rank.'
 when 'MACHINERY' then 'Name,Brand,Availability,brand'
 when 'HOUSEHOLD' then 'Product Title,Title,Title.,brand,Brand,Price Range Max.'
 else c_name || ',Popularity rank,title.' end as names"""


def _headers(spark, sf):
    files = views.select_from(spark, sf, "customer", HEADERS)
    return files.select("file_id", F.split("names", ",").alias("header"))


_BARE = f"""headed as (select file_id, string_split(names, ',') as header,
 list_transform(string_split(names, ','), lambda h: lower(trim(h))) as bare
 from (select {HEADERS} from customer))"""


def _found(required: str) -> str:
    tries = ", ".join(f"header[list_position(bare, '{n}')]" for n in sc.accepted_names(required))
    return f"coalesce({tries})"


@query("required_columns", f"with {_BARE} " + " union all ".join(
    f"select file_id, '{r}' as missing from headed where {_found(r)} is null"
    for r in fv.REQUIRED_COLUMNS))
def _(spark, sf):
    return sc.missing_columns(_headers(spark, sf), ["file_id"])


@query("column_mapping", f"with {_BARE} " + " union all ".join(
    f"select file_id, '{f}' as field, {_found(r)} as source from headed"
    for f, r in sc.FIELDS.items()))
def _(spark, sf):
    return sc.column_mapping(_headers(spark, sf), ["file_id"])


@query("date_headers", f"""select o_orderkey, {_MON} || ' ' || year(o_orderdate) as stamped,
 o_orderpriority as plain from orders""")
def _(spark, sf):
    return views.table(spark, sf, "orders").select(
        "o_orderkey", sc.date_header(F.col("o_orderdate").cast("string")).alias("stamped"),
        sc.date_header(F.col("o_orderpriority")).alias("plain"))


@query("scrub_cells", r"""select doc_id, regexp_replace(replace(text, chr(65279), ''),
 '^\s+|\s+$', '', 'g') as value from documents""")
def _(spark, sf):
    raw = F.concat(F.lit("﻿\x00 "), "text", F.lit(" \xff\xfe\x00"))
    return views.table(spark, sf, "documents").select("doc_id", sc.scrub(raw).alias("value"))


# --- volumes ------------------------------------------------------------------------------------

# A part's search volume in a month: what was kept of it.
VOLUMES = """l_partkey as row_id, cast(year(l_shipdate) as int) as year,
 substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast(month(l_shipdate) as int) - 2, 3) as month,
 case when l_returnflag = 'N' then l_quantity else 0.0e0 end as volume"""
_VOLUMES = f"""volumes as (select row_id, year, month, sum(volume) as volume from (
 select {VOLUMES} from lineitem) group by all)"""


def _volumes(spark, sf):
    return views.select_from(spark, sf, "lineitem", VOLUMES).groupBy("row_id", "year", "month").agg(
        F.sum("volume").alias("volume"))


@query("zero_volume_rate", f"""with {_VOLUMES} select count(*) as keywords,
 count_if(volume = 0) as zero_volume, avg(case when volume = 0 then 1.0e0 else 0.0e0 end) as zero_rate
 from volumes""")
def _(spark, sf):
    return mt.zero_volume_rate(_volumes(spark, sf))


@query("peak_seasonality", f"""with {_VOLUMES}, means as (select row_id, month, avg(volume) as v
  from volumes group by all),
pivoted as (select row_id, {', '.join(f'''max(-v) filter (where month = '{m}') as "Product Popularity {m}"''' for m in fv.MONTHS)}
  from means group by all), {PEAKS}
select row_id, peak as peak_seasonality from peaked""")
def _(spark, sf):
    return mt.peak_seasonality(_volumes(spark, sf), ["row_id"])


# A row without an id for every month of every year there is, so that each has its column.
@query("volumes_wide", f"""with {_VOLUMES}, months as (select unnest([{', '.join(
    f"'{m}'" for m in fv.MONTHS)}]) as month),
every as (select row_id, month || ' ' || year as c, volume from volumes union all
  select null, month || ' ' || year, null from months, (select distinct year from volumes
   where year is not null))
select * from (pivot every on c using sum(volume) group by row_id) where row_id is not null""")
def _(spark, sf):
    return me.volumes_wide(_volumes(spark, sf), ["row_id"], summed=True)


@query("volumes_long", f"""with {_VOLUMES} select row_id, year, month, volume from volumes""")
def _(spark, sf):
    wide = me.volumes_wide(_volumes(spark, sf), ["row_id"], summed=True)
    return me.volumes_long(wide, ["row_id"])


_REPORT_YEARS = 27  # what lies between the years of the table and those of a report


@query("filled_report", f"""with {_VOLUMES}, shifted as (select 'kw ' || row_id as keyword,
  year + {_REPORT_YEARS} as year, month, volume from volumes),
chosen as (select {views.TITLE} as title, min('kw ' || p_partkey) as keyword from part
  where p_size > 5 group by all),
measured as (select keyword, avg(volume) as mean, {', '.join(
    f"""sum(volume) filter (where month = '{c[:3]}' and year = {c[-4:]}) as "_{c}" """
    for c in co.VOLUME_COLUMNS)} from shifted group by keyword),
means as (select keyword as row_id, month, avg(volume) as v from shifted group by all),
pivoted as (select row_id, {', '.join(f'''max(-v) filter (where month = '{m}') as "Product Popularity {m}"''' for m in fv.MONTHS)}
  from means group by all), {PEAKS}
select p.p_partkey as row_id, coalesce(k.keyword, 'old') as "Product Keyword",
 mean is not null as measured, cast(mean as double) as mean, coalesce(peak, '') as "Peak Seasonality",
 {', '.join(f'cast("_{c}" as double) as "{c}"' for c in co.VOLUME_COLUMNS)}
from part p left join chosen k on k.title = {views.TITLE} left join measured m on m.keyword = k.keyword
 left join peaked on peaked.row_id = m.keyword""")
def _(spark, sf):
    blank = ["Product Keyword Avg MSV", *co.VOLUME_COLUMNS, "Peak Seasonality"]
    parts = views.table(spark, sf, "part")
    title = F.expr(views.TITLE)
    report = parts.select(F.col("p_partkey").alias("row_id"), title.alias("Product Title"),
                          F.lit("old").alias("Product Keyword"),
                          *[F.lit("").alias(c) for c in blank])
    name = F.concat(F.lit("kw "), F.col("p_partkey").cast("string"))
    keywords = parts.where("p_size > 5").select(title.alias("Product Title"), name.alias("keyword"))
    volumes = _volumes(spark, sf).select(
        F.concat(F.lit("kw "), F.col("row_id").cast("string")).alias("keyword"),
        (F.col("year") + _REPORT_YEARS).alias("year"), "month", "volume")
    filled = me.fill_report(report, keywords, volumes)
    number = lambda c: F.nullif(F.col(f"`{c}`"), F.lit("")).cast("double")
    mean = number("Product Keyword Avg MSV")
    return filled.select("row_id", "Product Keyword", mean.isNotNull().alias("measured"),
                         mean.alias("mean"), "Peak Seasonality",
                         *[number(c).alias(c) for c in co.VOLUME_COLUMNS])


@query("snapshot_roundtrip", f"""select p_partkey as "Row Id", {views.TITLE} as "Product Title",
 'BWS' as product_type from part""")
def _(spark, sf):
    catalog = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("Row Id"), F.expr(views.TITLE).alias("Product Title"))
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    sn.save_snapshot(catalog.limit(1), folder, product_type="old")
    sn.save_snapshot(catalog, folder, product_type="BWS")
    table, facts = sn.load_snapshot(spark, folder)
    return table.withColumn("product_type", F.lit(facts["product_type"]))


# --- counters and merges ------------------------------------------------------------------------

CATALOG = f"""p_partkey as row_id, {views.TITLE} as title, {views.BRAND} as brand,
 case when p_size > 40 then null else p_name end as level3,
 case when p_size > 30 then '' when p_size > 20 then null else p_name end as keyword"""
UPLOAD = f"""p_partkey as place, {views.TITLE} as title, 'other' as brand,
 lower(p_name) || ' ' || p_partkey as keyword, p_retailprice as avg_volume,
 case when p_size > 10 then 'Jan, Feb' end as peak_seasonality"""


def _catalog(spark, sf):
    return views.select_from(spark, sf, "part", CATALOG)


def _upload(spark, sf):
    return views.select_from(spark, sf, "part", UPLOAD).filter("avg_volume >= 950 or keyword like 'h%'")


@query("catalog_stats", f"""select count(*) as total_products,
 count(distinct level3) as categories_count, count_if(coalesce(keyword, '') <> '')
 as keywords_generated from (select {CATALOG} from part)""")
def _(spark, sf):
    return mt.catalog_stats(_catalog(spark, sf))


@query("category_breakdown", f"""with {PRODUCTS}, {DICTIONARY}, {matches('products')}
 select coalesce(string_split(b.path, ' > ')[1], {default_level1_sql('p.product_type')}) as level1,
  coalesce(string_split(b.path, ' > ')[2], 'Other') as level2,
  coalesce(string_split(b.path, ' > ')[3], 'Other') as level3, count(*) as products
 from products p left join best b on p.row_id = b.row_id group by all""")
def _(spark, sf):
    levels = cl.with_category_levels(views.products(spark, sf), views.dictionary(spark, sf))
    return mt.category_breakdown(levels, "level1", "level2", "level3")


@query("availability_summary", f"""with {FEED}, {DECEMBER}, every as (select distinct feed_id,
 product_key from keyed) select coalesce(availability, 'Potential Gap') as availability,
 count(*) as products from every left join december using (feed_id, product_key) group by all""")
def _(spark, sf):
    records = co.product_records(views.monthly_feed(spark, sf))
    return mt.category_breakdown(records, "availability")


_FIRST_UPLOAD = f"""upload as (select * from (select {UPLOAD} from part)
 where avg_volume >= 950 or keyword like 'h%'),
side as (select title, arg_min_null({{'k': keyword, 'v': avg_volume, 's': peak_seasonality}}, place)
 as u from upload group by title)"""


@query("additive_merge", f"""with {_FIRST_UPLOAD} select row_id, c.title, brand, level3,
 coalesce(u.k, keyword) as keyword, u.v as avg_volume, u.s as peak_seasonality
 from (select {CATALOG} from part) c left join side on c.title = side.title""")
def _(spark, sf):
    return me.additive_merge(_catalog(spark, sf), _upload(spark, sf), order="place")


@query("cached_keywords", f"""with {_FIRST_UPLOAD} select row_id, c.title,
 coalesce(u.k, keyword) as keyword from (select {CATALOG} from part) c
 left join side on c.title = side.title""")
def _(spark, sf):
    filled = me.cached_keywords(_catalog(spark, sf), _upload(spark, sf), order="place")
    return filled.select("row_id", "title", "keyword")
