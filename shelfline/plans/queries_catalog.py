"""Queries: keys, consolidation, classification, taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import leaf_of, level1_of, level_of, product_key
from shelfline.operators import classify as cl
from shelfline.operators import consolidate as co
from shelfline.operators import taxonomy as ta
from shelfline.operators.fuzzy import fuzzy_category, keyword_scores
from shelfline.plans import views
from shelfline.plans.catalog import consolidate
from shelfline.plans.registry import (DICTIONARY, FEED, GADGETS, PRODUCTS, TAXONOMY,
                                      default_level1_sql, key_of, mapped, matches, query, quoted)

RANK = "try_cast(popularity_rank as double)"
RANK_COLUMNS = ",\n  ".join(
    f"arg_min_null({RANK}, row_seq) filter (where month = '{m}') as \"Product Popularity {m}\""
    for m in fv.MONTHS)
PIVOT = f"""pivoted as (select feed_id, product_key, {RANK_COLUMNS} from keyed group by all)"""
PEAKS = """ranked as (select *, list_filter([%s], lambda e: e.v is not null) as es from pivoted),
topped as (select *, list_sort(es)[1:4] as top from ranked),
mean as (select *, list_reduce([0.0::double] || list_transform(top, lambda e: e.v),
    lambda x, y: x + y) / len(top) as mu from topped),
spread as (select *, sqrt(list_reduce([0.0::double] || list_transform(top,
    lambda e: (e.v - mu) * (e.v - mu)), lambda x, y: x + y) / len(top)) as sd from mean),
kept as (select *, list_filter(top, lambda e: abs(e.v - mu) <= sd) as stable from spread),
peaked as (select *, case when len(top) < 3 then ''
    when len(stable) = 0 then top[1].m
    else array_to_string(list_transform(stable, lambda e: e.m), ', ') end as peak from kept)
""" % ", ".join(f"{{'v': \"Product Popularity {m}\", 'i': {i}, 'm': '{m}'}}"
                for i, m in enumerate(fv.MONTHS))
MASTER = """firsts as (select feed_id, product_key,
    arg_min_null({'title': title, 'brand': brand}, {'f': file_seq, 'r': row_seq}) as f
  from keyed group by all),
master as (select feed_id, product_key, f.title as title, f.brand as brand from firsts)"""
DECEMBER = """december as (select feed_id, product_key, coalesce(d.price, 'N/A') as price,
    case when trim(d.availability) <> '' then d.availability else 'Potential Gap' end
      as availability
  from (select feed_id, product_key, arg_min_null({'price': price, 'availability': availability},
    row_seq) as d from keyed where month = 'Dec' group by all))"""


# --- consolidation ------------------------------------------------------------------------------

@query("product_key", f"with {FEED} select product_key, count(*) as n_rows from keyed group by all")
def _(spark, sf):
    return co.with_product_key(views.monthly_feed(spark, sf)).groupBy("product_key").agg(
        F.count("*").alias("n_rows"))


@query("document_key", f"select doc_id, {key_of('text')} as product_key from documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", product_key(F.col("text")).alias("product_key"))


@query("master_products", f"with {FEED}, {MASTER} select * from master")
def _(spark, sf):
    return co.master_products(views.monthly_feed(spark, sf))


@query("monthly_first_rank", f"""with {FEED} select feed_id, product_key, month,
 arg_min_null({RANK}, row_seq) as popularity_rank from keyed group by all""")
def _(spark, sf):
    return co.monthly_ranks(views.monthly_feed(spark, sf))


@query("december_attributes", f"with {FEED}, {DECEMBER} select * from december")
def _(spark, sf):
    return co.december_attributes(views.monthly_feed(spark, sf))


@query("popularity_pivot", f"with {FEED}, {PIVOT} select * from pivoted")
def _(spark, sf):
    return co.popularity_pivot(views.monthly_feed(spark, sf))


@query("peak_popularity", f"""with {FEED}, {PIVOT}, {PEAKS}
 select feed_id, product_key, peak as peak_popularity from peaked""")
def _(spark, sf):
    pivot = co.popularity_pivot(views.monthly_feed(spark, sf))
    return co.with_peak_popularity(pivot).select(
        "feed_id", "product_key", F.col("Peak Popularity").alias("peak_popularity"))


_CONSOLIDATED = f"""with {FEED}, {MASTER}, {DECEMBER}, {PIVOT}, {PEAKS}, {DICTIONARY},
titled as (select distinct title, 'BWS' as product_type from master),
numbered as (select row_number() over (order by title) as row_id, * from titled),
{matches('numbered')},
levels as (select n.title, coalesce(string_split(b.path, ' > ')[1], 'Alcoholic Beverages') as l1,
  coalesce(string_split(b.path, ' > ')[2], 'Other') as l2,
  coalesce(string_split(b.path, ' > ')[3], 'Other') as l3
  from numbered n left join best b on n.row_id = b.row_id)
select m.feed_id, m.product_key, m.title as "Product Title",
 coalesce(d.price, 'N/A') as "Product Max Price", l.l1 as "Product Category L1",
 l.l2 as "Product Category L2", l.l3 as "Product Category L3", '' as "Product Keyword",
 '' as "Product Keyword Avg MSV", m.brand as "Product Brand",
 coalesce(d.availability, 'Potential Gap') as "Availability",
 {', '.join(f'p."Product Popularity {m}"' for m in fv.MONTHS)},
 {', '.join(f"'' as {chr(34)}{c}{chr(34)}" for c in co.VOLUME_COLUMNS)},
 '' as "Peak Seasonality", p.peak as "Peak Popularity"
from master m left join december d using (feed_id, product_key)
 join peaked p using (feed_id, product_key) join levels l on l.title = m.title"""


@query("category_repeated_titles", f"""with {PRODUCTS}, {DICTIONARY}, {matches('products')}
 select l_orderkey, l_linenumber, coalesce(string_split(b.path, ' > ')[-1], 'Other') as category
 from lineitem l join products p on l.l_partkey = p.row_id left join best b on p.row_id = b.row_id""")
def _(spark, sf):
    lines = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(
        views.products(spark, sf), F.col("l_partkey") == F.col("row_id"))
    return cl.with_category(lines, views.dictionary(spark, sf)).select(
        "l_orderkey", "l_linenumber", "category")


@query("consolidated", _CONSOLIDATED)
def consolidated(spark, sf):
    return consolidate(views.monthly_feed(spark, sf), views.dictionary(spark, sf), "BWS")


# --- classification -----------------------------------------------------------------------------

@query("accessory_flags", f"""with {GADGETS}, {PRODUCTS}, dictionary as (select '' as product_type,
 '' as path, 0 as pos, '' as keyword), {matches('gadgets')}
 select row_id, phone_accessory, controller, camera_accessory, main_camera, pet_food, pet_accessory
 from flagged""")
def _(spark, sf):
    flags = cl.accessory_flags(cl.fold_title(F.col("title")))
    return views.gadgets(spark, sf).select("row_id", *[c.alias(n) for n, c in flags.items()])


@query("category_match", f"""with {PRODUCTS}, {DICTIONARY}, {matches('products')}
 select p.row_id, b.path as category_path from products p left join best b on p.row_id = b.row_id""")
def _(spark, sf):
    return cl.match_categories(views.products(spark, sf), views.dictionary(spark, sf)).select(
        "row_id", "category_path")


@query("category_levels", f"""with {GADGETS}, {DICTIONARY}, {matches('gadgets')}
 select g.row_id, coalesce(string_split(b.path, ' > ')[1], {default_level1_sql('g.product_type')})
   as level1, coalesce(string_split(b.path, ' > ')[2], 'Other') as level2,
 coalesce(string_split(b.path, ' > ')[3], 'Other') as level3
 from gadgets g left join best b on g.row_id = b.row_id""")
def _(spark, sf):
    return cl.with_category_levels(views.gadgets(spark, sf), views.dictionary(spark, sf)).select(
        "row_id", "level1", "level2", "level3")


@query("category_leaf", f"""with {GADGETS}, {DICTIONARY}, {matches('gadgets')}
 select g.row_id, coalesce(string_split(b.path, ' > ')[-1], 'Other') as category
 from gadgets g left join best b on g.row_id = b.row_id""")
def _(spark, sf):
    return cl.with_category(views.gadgets(spark, sf), views.dictionary(spark, sf)).select(
        "row_id", "category")


@query("default_level1", f"""with {PRODUCTS} select row_id, product_type,
 {mapped('product_type')} as mapped_type, {default_level1_sql('product_type')} as level1
 from products""")
def _(spark, sf):
    kind = F.col("product_type")
    return views.products(spark, sf).select(
        "row_id", "product_type", cl.mapped_type(kind).alias("mapped_type"),
        cl.default_level1(kind).alias("level1"))


@query("path_levels", f"""with {TAXONOMY} select product_type, path,
 string_split(path, ' > ')[-1] as leaf, string_split(path, ' > ')[1] as level1,
 coalesce(string_split(path, ' > ')[2], 'Other') as level2,
 coalesce(string_split(path, ' > ')[3], 'Other') as level3 from paths""")
def _(spark, sf):
    path = F.col("path")
    return ta.taxonomy_paths(views.taxonomy(spark, sf)).select(
        "product_type", "path", leaf_of(path).alias("leaf"), level1_of(path).alias("level1"),
        level_of(path, 2).alias("level2"), level_of(path, 3).alias("level3"))


FUZZY = rf"""{PRODUCTS}, {TAXONOMY},
levels as (select product_type, path, list_transform(string_split(path, ' > '),
  lambda l: regexp_replace(trim(lower(l)), '[^a-z0-9\s&-]', '', 'g')) as ls from paths),
words as (select distinct product_type, path, keyword from (
 select product_type, path, unnest(ls) as keyword from levels union all
 select product_type, path, w from (select product_type, path,
  unnest(string_split_regex(array_to_string(ls, ' '), '\s+')) as w from levels)
 where length(w) > 3 and w not in ({quoted(fv.TAXONOMY_STOP_WORDS)}))),
pairs as (select distinct title, {mapped('product_type')} as kind from products),
points as (select p.title, p.kind, w.path, sum(case when contains(lower(coalesce(p.title, '')), w.keyword)
  then length(w.keyword) * case when regexp_matches(lower(p.title), '\b' || regexp_escape(w.keyword)
   || '\b') then 3 else 2 end else 0 end) as s
  from pairs p left join words w on w.product_type = p.kind group by all)"""


@query("fuzzy_keyword_score", f"""with {FUZZY}
 select title, kind as product_type, cast(coalesce(max(s), 0) as integer) as score from points
 group by all""")
def _(spark, sf):
    paths = ta.positioned(ta.taxonomy_paths(views.taxonomy(spark, sf)))
    return keyword_scores(views.products(spark, sf), paths)


# The partial ratio, window by window: the longest common subsequence of the shorter text and a window
# is what is left of a row of bits after one step for each character.
@query("fuzzy_category", f"""with {FUZZY},
rivals as (select title, kind, path, s, lower(coalesce(title, '')) as text,
  lower(string_split(path, ' > ')[-1]) as leaf from points where path is not null
  qualify s + {100 * fv.FUZZY_WEIGHT} >= max(s) over (partition by title, kind)),
texts as (select distinct text, leaf from rivals),
turned as (select text, leaf, leaf as a, text as b from texts where length(leaf) <= length(text)
  union all select text, leaf, text, leaf from texts where length(text) <= length(leaf)),
masks as (select *, length(a) as w, (1::hugeint << length(a)) - 1 as full_row, map_from_entries(
  list_transform(list_distinct(string_split(a, '')), lambda c: {{'k': c, 'v': list_sum(list_transform(
    range(1, length(a) + 1), lambda i: case when a[i] = c then 1::hugeint << (i - 1) else 0::hugeint end)
    )::hugeint}})) as bits from turned where not contains(b, a)),
windows as (select text, leaf, w, full_row, bits, substr(b, greatest(f, 0) + 1,
   least(f + w, length(b)) - greatest(f, 0)) as part from (
  select *, unnest(range(1 - w, length(b))) as f from masks where w > 0)),
stepped as (select text, leaf, w, length(part) as n, list_reduce(list_prepend(full_row, list_transform(
   string_split(part, ''), lambda c: coalesce(bits[c], 0::hugeint))), lambda x, m:
   ((x + (x & m)) | (x - (x & m))) & full_row) as state from windows),
ratios as (select text, leaf, max(r) as ratio from (
  select text, leaf, 2 * (w - bit_count(state)) / (w + n) as r from stepped
  union all select text, leaf, case when a <> '' or b = '' then 1.0 else 0.0 end from turned
   where contains(b, a)) group by all),
totals as (select *, s + {fv.FUZZY_WEIGHT} * (100.0::double * ratio::double) as total
  from rivals join ratios using (text, leaf) join paths p on p.product_type = kind and p.path = rivals.path),
best as (select title, kind, string_split(path, ' > ')[-1] as category, total from totals
  qualify row_number() over (partition by title, kind order by total desc, pos) = 1)
select row_id, coalesce(b.category, '{fv.NO_CATEGORY}') as category,
 round(case when total is null then 0.0 else least(total / 100, 1.0) end::double, 6) as confidence
from products left join best b on b.title is not distinct from products.title
 and b.kind = {mapped('product_type')} and total > {fv.FUZZY_THRESHOLD}""")
def fuzzy(spark, sf):
    paths = ta.positioned(ta.taxonomy_paths(views.taxonomy(spark, sf)))
    return fuzzy_category(views.products(spark, sf), paths).select(
        "row_id", "category", F.round("confidence", 6).alias("confidence"))


# --- taxonomy -----------------------------------------------------------------------------------

@query("taxonomy_l1_l2", f"""with {TAXONOMY}, c as (select distinct product_type,
 level1 || ' > ' || level2 as category from taxonomy where level1 is not null
 and level2 is not null)
select *, row_number() over (partition by product_type order by category) as place from c""")
def _(spark, sf):
    return ta.in_sorted_order(ta.category_pairs(views.taxonomy(spark, sf)), ["product_type", "category"],
                              ["product_type"])


@query("type_categories", f"""with {TAXONOMY}, c as (select distinct product_type, trim(category) as category
 from (select product_type, unnest(string_split(path, ' > ')[2:]) as category from paths))
select *, row_number() over (partition by product_type order by category) as place from c""")
def _(spark, sf):
    return ta.in_sorted_order(ta.deep_categories(ta.taxonomy_paths(views.taxonomy(spark, sf))),
                              ["product_type", "category"], ["product_type"])


@query("all_categories", f"""with {TAXONOMY}, c as (select distinct
 trim(string_split(path, ' > ')[-1]) as category from paths)
select *, row_number() over (order by category) as place from c""")
def _(spark, sf):
    return ta.in_sorted_order(ta.leaf_categories(ta.taxonomy_paths(views.taxonomy(spark, sf))), ["category"])


@query("taxonomy_aliases", f"""with {TAXONOMY} select product_type, level1, level2, level3
 from taxonomy union all select 'BWS', level1, level2, level3 from taxonomy
 where product_type = 'Alcoholic Beverages'""")
def _(spark, sf):
    return ta.with_aliases(views.taxonomy(spark, sf))


@query("taxonomy_gaps", f"""with {TAXONOMY} select t.product_type,
 'No taxonomy rows for type ' || t.product_type as issue
 from (select unnest([{quoted(fv.PRODUCT_TYPES)}]) as product_type) t
 where t.product_type not in (select product_type from taxonomy)""")
def _(spark, sf):
    return ta.missing_types(views.taxonomy(spark, sf))


@query("category_text", f"""with {TAXONOMY}, {PRODUCTS},
pairs as (select distinct product_type, level1 || ' > ' || level2 as category from taxonomy
  where level1 is not null and level2 is not null),
numbered as (select *, row_number() over (partition by product_type order by category) as place
  from pairs),
texts as (select product_type, string_agg(place || '. ' || category, chr(10) order by place)
  as categories from numbered group by product_type)
select t.product_type, coalesce(x.categories, 'No categories available') as categories
 from (select distinct product_type from products) t left join texts x
 on t.product_type = x.product_type""")
def _(spark, sf):
    return ta.category_text(views.taxonomy(spark, sf), views.products(spark, sf))


@query("taxonomy_keywords", rf"""with {TAXONOMY},
levels as (select product_type, path, list_transform(string_split(path, ' > '),
  lambda l: regexp_replace(trim(lower(l)), '[^a-z0-9\s&-]', '', 'g')) as ls from paths)
select distinct product_type, path, keyword from (
 select product_type, path, unnest(ls) as keyword from levels union all
 select product_type, path, w from (select product_type, path,
  unnest(string_split_regex(array_to_string(ls, ' '), '\s+')) as w from levels)
 where length(w) > 3 and w not in ({quoted(fv.TAXONOMY_STOP_WORDS)}))""")
def _(spark, sf):
    paths = ta.taxonomy_paths(views.taxonomy(spark, sf))
    return paths.select("product_type", "path", F.explode(
        ta.taxonomy_keywords(F.col("path"))).alias("keyword"))


@query("keyword_index", f"with {DICTIONARY} select product_type, path, pos, keyword from dictionary")
def _(spark, sf):
    return views.dictionary(spark, sf)


LINES = """case when p_size = 1 then '# ' || p_name when p_size = 2 then '' when p_size = 3 then p_name
 when p_size <= 20 then '  ' || p_partkey || ' - Hardware > ' || p_name || ' > ' || p_brand || ' '
 when p_size <= 30 then p_partkey || ' - Toys & Games > ' || p_name || ' - ' || p_brand
 when p_size <= 40 then p_partkey || ' - Food, Beverages & Tobacco > ' || p_name
 else p_partkey || ' - Software > ' || p_name end as value"""


@query("text_taxonomy", f"""with lines as (select trim(v) as v from (select {LINES.replace('as value', 'as v')}
 from part)), kept as (select trim(substr(v, strpos(v, ' - ') + 3)) as path from lines
 where v <> '' and not starts_with(v, '#') and contains(v, ' - '))
select case string_split(path, ' > ')[1]
  {' '.join(f"when '{k}' then '{v}'" for k, v in fv.TOP_LEVEL_TYPES.items())} end as product_type,
 path from kept where string_split(path, ' > ')[1] in ({quoted(fv.TOP_LEVEL_TYPES)})""")
def _(spark, sf):
    return ta.parse_text_taxonomy(views.select_from(spark, sf, "part", LINES))
