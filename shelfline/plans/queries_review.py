"""Queries: batches, replies, backfills, reviews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions import replies as rp
from shelfline.operators import answers as answer_log
from shelfline.operators import batches as ba
from shelfline.operators import review as re_
from shelfline.plans import stand_ins, views
from shelfline.plans.registry import query
from shelfline.session import shared_folder

CATALOG = f"""p_partkey as row_id, {views.TITLE} as title, {views.BRAND} as brand,
 case when p_size > 30 then 'Other' else p_name end as category,
 case when p_size > 20 then '' else lower(p_name) end as keyword"""
_CATALOG = f"catalog as (select {CATALOG} from part)"
_FIRST = "string_split(title, ' ')[1]"
# Place in a batch of 20, from 1.
_NUMBERED = f"""{_CATALOG}, numbered as (select *, cast((row_number() over (order by row_id) - 1) % 20
 + 1 as bigint) as number from catalog)"""


def _catalog(spark, sf):
    return views.select_from(spark, sf, "part", CATALOG)


@query("row_ordinals", """select o_orderkey * 5003 + 7 as row_id,
 row_number() over (order by o_orderkey) - 1 as ordinal from orders""")
def _(spark, sf):
    ids = views.table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 5003 + 7).alias("row_id"))
    return ba.with_ordinal(ids)


@query("batch_assembly", """with n as (select o_orderkey * 3 as row_id, o_orderpriority,
  (row_number() over (order by o_orderkey) - 1) // 20 as batch_no from orders)
 select batch_no, count(*) as n_items, min(row_id) as first_id, max(row_id) as last_id,
  string_agg(o_orderpriority, ',' order by row_id) as items from n group by batch_no""")
def _(spark, sf):
    rows = views.table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 3).alias("row_id"), "o_orderpriority")
    batches = ba.assemble(rows, F.col("o_orderpriority"), fv.KEYWORD_BATCH)
    return batches.select(
        "batch_no", F.size("items").cast("bigint").alias("n_items"),
        F.col("items")[0]["row_id"].alias("first_id"),
        F.element_at("items", -1)["row_id"].alias("last_id"),
        F.array_join(F.transform("items", lambda i: i["item"]), ",").alias("items"))


@query("row_ordinals_sparse", """select o_orderkey * 1000000000000 + 7 as row_id,
 row_number() over (order by o_orderkey) - 1 as ordinal from orders""")
def _(spark, sf):
    return ba.with_ordinal(views.table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 1000000000000 + 7).alias("row_id")))


@query("batch_limit", """with n as (select o_orderkey as row_id,
  row_number() over (order by o_orderkey) - 1 as place from orders)
 select place // 20 as batch_no, count(*) as n_items, max(row_id) as last_id from n where place < 130
 group by all""")
def _(spark, sf):
    rows = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    batches = ba.assemble(rows, F.lit(""), fv.KEYWORD_BATCH, limit=130)
    return batches.select("batch_no", F.size("items").cast("bigint").alias("n_items"),
                          F.element_at("items", -1)["row_id"].alias("last_id"))


@query("request_items", rf"""with {_CATALOG}, f as (select row_id, substr(trim(title), 1, 100) as t,
  substr(trim(coalesce(brand, '')), 1, 100) as b, brand, title, category from catalog)
 select row_id, '{{"product": "' || t || case when lower(b) in ('', 'nan', 'none') then ''
   else ' (by ' || b || ')' end || '", "id": "' || row_id || '"}}' as keyword_item,
  'item=' || row_id || chr(10) || 'name=' || title || chr(10) || 'maker='
   || coalesce(brand, '') as product_item,
  '#' || row_id || ' ' || title || chr(10) || 'made by ' || coalesce(brand, 'an unnamed maker')
   || chr(10) || 'filed under ' || category as review_item from f""")
def _(spark, sf):
    c = F.col
    return _catalog(spark, sf).select(
        "row_id", rp.keyword_item(c("row_id"), c("title"), c("brand")).alias("keyword_item"),
        rp.product_item(c("row_id"), c("title"), c("brand")).alias("product_item"),
        rp.review_item(c("row_id"), c("title"), c("brand"), c("category")).alias("review_item"))


@query("category_lists", """with g as (select p_brand, list(distinct p_name order by p_name) as names
  from part group by p_brand union all
  select 'all', list(distinct p_name || p_type order by p_name || p_type) from part)
 select p_brand as source, case when len(names) > 100 then 'Choose one of ' || len(names)
   || ' shelves, such as ' || array_to_string(names[1:50], ', ') || ' or another'
  else 'Choose one of these shelves: ' || array_to_string(names, ', ') end as line from g""")
def _(spark, sf):
    parts = views.table(spark, sf, "part")
    # Names are distinct before they are gathered: a list is as long as there are categories.
    by_brand = parts.select(F.col("p_brand").alias("source"), F.col("p_name").alias("name"))
    every = parts.select(F.lit("all").alias("source"), F.concat("p_name", "p_type").alias("name"))
    return (by_brand.unionByName(every).distinct().groupBy("source")
            .agg(F.array_sort(F.collect_list("name")).alias("names"))
            .select("source", rp.category_list(F.col("names")).alias("line")))


# --- replies ------------------------------------------------------------------------------------

@query("reply_json_parse", """select event_id, 'k' as id, json_extract_string(props, '$.k') as answer
 from events where json_extract_string(props, '$.k') is not null""")
def _(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id", F.explode(rp.id_values(F.col("props"))).alias("id", "answer"))


LOOSE = """p_partkey as row_id, 'noise {"' || p_partkey || '": "' || p_name || ' ", "' || (p_partkey + 1)
 || '" : "' || p_brand || '", "x": "skip", "' || p_size || '": 7' as reply"""


@query("reply_loose_parse", """select row_id, cast(id as varchar) as id, answer from (
 select p_partkey as row_id, p_partkey as id, p_name as answer from part
 union all select p_partkey, p_partkey + 1, p_brand from part)""")
def _(spark, sf):
    return views.select_from(spark, sf, "part", LOOSE).select(
        "row_id", F.explode(rp.id_values(F.col("reply"), loose=True)).alias("id", "answer"))


ENTITY_REPLY = """p_partkey as row_id, case when p_size = 1 then 'sorry' else '```json
{"brand": "' || p_brand || '", "vintage": null, "age_statement": ' || p_size ||
', "product_name": "' || p_name || '", "other": 1}
```' end as reply"""


@query("entity_reply", f"""select p_partkey as row_id,
 case when p_size = 1 then '' else p_brand end as brand,
 case when p_size = 1 then '' else p_name end as product_name, '' as vintage,
 case when p_size = 1 then '' else cast(p_size as varchar) end as age_statement,
 {', '.join(f"'' as {f}" for f in fv.ENTITY_FIELDS[4:])} from part""")
def _(spark, sf):
    return views.select_from(spark, sf, "part", ENTITY_REPLY).withColumn(
        "e", rp.entity_struct(F.col("reply"))).select("row_id", "e.*")


# --- backfills ----------------------------------------------------------------------------------

@query("category_backfill", f"""with {_CATALOG} select row_id, case when category = 'Other'
 and not starts_with(title, 'Brand') then {_FIRST} else category end as category from catalog""")
def category_backfill(spark, sf):
    return re_.backfill_categories(_catalog(spark, sf), stand_ins.category_model).select(
        "row_id", "category")


@query("brand_backfill", f"""with {_CATALOG} select row_id,
 case when lower(trim(coalesce(brand, ''))) in ('', 'nan', 'none', 'null') then
  case when contains(title, '|') then 'Unbranded' else {_FIRST} end else brand end as brand
 from catalog""")
def brand_backfill(spark, sf):
    return re_.backfill_brands(_catalog(spark, sf), stand_ins.brand_model).select(
        "row_id", "brand")


@query("keyword_batches", f"""with {_CATALOG} select row_id, case when contains(title, 'Gift')
 then keyword else array_to_string(string_split(lower(title), ' ')[1:2], ' ') end as keyword
 from catalog""")
def keyword_batches(spark, sf):
    return re_.batch_keywords(_catalog(spark, sf), stand_ins.keyword_model).select(
        "row_id", "keyword")


@query("stored_keywords", f"""with {_CATALOG} select row_id, case when contains(title, 'Gift')
 then keyword else array_to_string(string_split(lower(title), ' ')[1:2], ' ') end as keyword
 from catalog""")
def _(spark, sf):
    """A call that breaks off, one that resumes from its log, and one that finds all it asks for."""
    store = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    catalog = _catalog(spark, sf)

    def breaks_off(requests):
        if stand_ins.unlucky(requests[0]):
            raise SystemError("the model went away")
        return stand_ins.keyword_model(requests)

    re_.batch_keywords(catalog, breaks_off, store=store, attempts=1, pause=0)
    answer_log.compact(spark, store)
    re_.batch_keywords(catalog, stand_ins.keyword_model, store=store, pause=0)
    return re_.batch_keywords(catalog, stand_ins.no_model, store=store, pause=0).select("row_id", "keyword")


@query("keyword_singles", rf"""with {_CATALOG} select row_id, lower(trim(regexp_replace(
 regexp_replace(replace(array_to_string(string_split(title, ' ')[1:3], ' '), '&', 'And'),
  '[^A-Za-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))) as keyword from catalog""")
def _(spark, sf):
    return re_.single_keywords(_catalog(spark, sf), stand_ins.phrase_model).select(
        "row_id", "keyword")


@query("entity_keywords", f"""with {_CATALOG} select row_id,
 case when contains(lower(title), 'gift') then keyword else 'Pick' end as keyword,
 not contains(lower(title), 'gift') as found from catalog""")
def _(spark, sf):
    return re_.entity_keywords(_catalog(spark, sf), stand_ins.pick_model).select(
        "row_id", "keyword", F.col("keyword_error").isNull().alias("found"))


# --- reviews ------------------------------------------------------------------------------------

_REVIEWED = f"""{_NUMBERED}, reviewed as (select row_id, title, category as assigned,
 case when number % 5 in (0, 1) or length(title) % 2 = 1 then category else 'Whisky' end as suggested,
 number % 5 in (0, 1) or length(title) % 2 = 1 as is_correct,
 case when number % 5 in (0, 1) then 'unknown' when length(title) % 2 = 1 then 'medium'
  when number % 2 = 1 then 'high' else 'low' end as confidence,
 case when number % 5 = 1 then 'short answer line' end as parse_error from numbered)"""


def _reviewed(spark, sf):
    names = F.array(*[F.lit(c) for c in fv.PRODUCT_TYPES])
    return re_.review_categories(_catalog(spark, sf), stand_ins.review_model, categories=names)


@query("review_parse", f"with {_REVIEWED} select * from reviewed")
def review_parse(spark, sf):
    return _reviewed(spark, sf)


@query("review_report", f"""with {_REVIEWED} select count(*) as total_products,
 count_if(is_correct) as correct, count_if(not is_correct) as incorrect,
 count_if(is_correct) / count(*) as accuracy, count_if(confidence = 'high') as high_confidence,
 count_if(confidence = 'medium') as medium_confidence, count_if(confidence = 'low') as low_confidence
 from reviewed""")
def _(spark, sf):
    return re_.review_report(_reviewed(spark, sf))


@query("label_report", """select count(*) as total_products, count_if(quality = 1) as correct,
 count_if(quality <> 1) as incorrect, count_if(quality = 1) / count(*) as accuracy,
 count_if(toxic = 1) as high_confidence, 0 as medium_confidence, count_if(toxic = 0) as low_confidence
 from labels""")
def _(spark, sf):
    verdicts = views.table(spark, sf, "labels").select(
        (F.col("quality") == 1).alias("is_correct"),
        F.when(F.col("toxic") == 1, "high").otherwise("low").alias("confidence"))
    return re_.review_report(verdicts)


@query("wrong_categories", f"""with {_REVIEWED} select row_id, title, assigned, suggested, confidence
 from reviewed where not is_correct""")
def _(spark, sf):
    return re_.wrong_categories(_reviewed(spark, sf)).select(
        "row_id", "title", "assigned", "suggested", "confidence")


@query("dual_agreement", f"""with {_NUMBERED}, d as (select row_id, title,
 category as keyword_category, case when number % 3 = 0 or length(title) < 45 then category
  else 'Goods' end as model_category from numbered)
 select *, keyword_category = model_category as agree, model_category as final_category from d""")
def dual_agreement(spark, sf):
    return re_.dual_classify(_catalog(spark, sf), stand_ins.classify_model)


@query("keyword_check", f"""with {_CATALOG} select row_id,
 case when contains(title, '|') then 'N' when starts_with(lower(title), keyword) then 'Y' else 'N' end
  as match, case when contains(title, '|') then 'Error: offer in title' else 'by prefix' end as reason
 from catalog""")
def _(spark, sf):
    return re_.verify_keywords(_catalog(spark, sf), stand_ins.check_model).select(
        "row_id", "match", "reason")
