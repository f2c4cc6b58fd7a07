"""Named queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfline.functions import fixed_values as fv
from shelfline.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
COMPARISONS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say it."""
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            COMPARISONS[name] = sql
        return build
    return add


# --- SQL for the comparison engine --------------------------------------------------------------

def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def blanked(expr: str, patterns, flags: str = "gi") -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, '{p}', ' ', '{flags}')"
    return expr


def squeezed(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def unaccented(expr: str) -> str:
    return f"translate(replace({expr}, 'ß', 'ss'), '{fv.ACCENTED}', '{fv.UNACCENTED}')"


def aged(expr: str) -> str:
    for p, _ in fv.AGE_PATTERNS:
        expr = rf"regexp_replace({expr}, '{p}', '\1yr', 'gi')"
    return expr


def split_words(expr: str) -> str:
    return rf"list_filter(string_split_regex({expr}, '\s+'), lambda w: w <> '')"


def key_of(expr: str) -> str:
    return squeezed(rf"regexp_replace(lower({expr}), '[^a-z0-9\s]', '', 'g')")


def any_of(expr: str, terms) -> str:
    return "(" + " or ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


PRODUCTS = f"products as (select {views.PRODUCT_COLUMNS} from part)"
GADGETS = f"gadgets as (select {views.GADGET_COLUMNS} from part)"
ENTITIES = f"entities as (select {views.ENTITY_COLUMNS} from part)"
FEED = f"""feed as (select {views.LINE_COLUMNS} from lineitem join (
 select {views.PART_COLUMNS} from part) on l_partkey = p_partkey),
keyed as (select * from (select *, {key_of('title')} as product_key from feed)
 where product_key <> '')"""
TAXONOMY = f"""taxonomy as (select * from (select {views.TAXONOMY_COLUMNS} from part)
 where product_type <> 'Unlisted'),
paths as (select product_type, path,
  row_number() over (partition by product_type order by path) - 1 as pos from (
   select distinct product_type, level1 as path from taxonomy where level1 is not null
   union select product_type, level1 || ' > ' || level2 from taxonomy where level2 is not null
   union select product_type, level1 || ' > ' || level2 || ' > ' || level3 from taxonomy
     where level2 is not null and level3 is not null))"""
DICTIONARY = rf"""{TAXONOMY},
names as (select *, {squeezed(r"regexp_replace(lower(string_split(path, ' > ')[-1]), '[^a-z0-9\s&-]', '', 'g')")}
  as name from paths),
worded as (select *, {split_words('name')} as words from names),
dictionary as (select distinct product_type, path, pos, keyword from (
   select product_type, path, pos, array_to_string(words, ' ') as keyword from worded
   union all select product_type, path, pos, unnest(list_transform(range(1, len(words)),
     lambda i: words[i] || ' ' || words[i + 1])) from worded
   union all select product_type, path, pos, unnest(list_filter(words,
     lambda w: w not in ({quoted(fv.GENERIC_INDEX_WORDS)}))) from worded)
  where keyword <> '')"""


def mapped(expr: str) -> str:
    return f"case when {expr} = 'BWS' then 'Alcoholic Beverages' else {expr} end"


def default_level1_sql(expr: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in fv.DEFAULT_LEVEL1.items())
    return f"case {mapped(expr)} {cases} else '{fv.NO_LEVEL1}' end"


def matches(source: str) -> str:
    """CTEs from ``source`` to the best path per row, by testing every keyword of the type."""
    return rf"""folded as (select *, replace(lower(coalesce(title, '')), 'whiskey', 'whisky') as t
  from {source}),
flagged as (select *, {any_of('t', fv.PHONE_ACCESSORY_TERMS)} and {any_of('t', fv.PHONE_BRANDS)}
    as phone_accessory, {any_of('t', fv.CONTROLLER_TERMS)} as controller,
  {any_of('t', fv.CAMERA_ACCESSORY_TERMS)} as camera_accessory,
  {any_of('t', fv.CAMERA_BRANDS)} and contains(t, 'camera')
    and not {any_of('t', fv.CAMERA_ACCESSORY_TERMS)} as main_camera,
  {any_of('t', fv.PET_FOOD_TERMS)} as pet_food,
  {any_of('t', fv.PET_ACCESSORY_TERMS)} and not {any_of('t', fv.PET_FOOD_TERMS)}
    as pet_accessory from folded),
hits as (select f.row_id, d.path, length(d.keyword) as n,
    len(string_split(d.path, ' > ')) as depth, d.pos
  from flagged f join dictionary d on d.product_type = {mapped('f.product_type')}
    and case when contains(f.t, d.keyword)
      then regexp_matches(f.t, '\b' || regexp_escape(d.keyword) || '\b') else false end
  where not (f.phone_accessory and not {any_of('d.path', fv.PHONE_PATHS)})
    and not (f.controller and not {any_of('d.path', fv.CONTROLLER_PATHS)})
    and not (f.camera_accessory and not {any_of('d.path', fv.CAMERA_ACCESSORY_PATHS)})
    and not (f.main_camera and {any_of('d.path', fv.CAMERA_ACCESSORY_PATHS)})
    and not (f.pet_food and not {any_of('d.path', fv.PET_FOOD_PATHS)})
    and not (f.pet_accessory and {any_of('d.path', fv.FOOD_PATHS)})),
best as (select row_id, path from (select *, row_number() over (
  partition by row_id order by n desc, depth, pos) as k from hits) where k = 1)"""
