"""The given tables seen as catalogue inputs.

There is no product feed among the tables, so these views derive one: a line item is one row of a
monthly feed file, a part is a product, an order names a feed file.  The text rules are plain SQL
expressions, used as they are by the comparison queries as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE = """case p_type
 when 'ECONOMY' then p_name || ' ' || p_brand || ' Mixed Case ' || p_size || 'x330ml'
 when 'PROMO' then 'Personalised ' || p_name || ' ' || p_brand || ' Gift Set | Save ' || p_size || '%'
 when 'SMALL' then p_name || ' ' || p_brand || ' ' || p_size || 'cl (' || p_size || ' pack)'
 when 'LARGE' then p_brand || ' ' || p_size || ' Year Old ' || p_name || ' Single Malt Whiskey 40% ABV'
 when 'MEDIUM' then p_name || ' Château Rosé Wine ' || (1970 + p_size) || ' - ' || p_brand || ' 13.5% vol'
 else p_brand || '''s ' || p_name || ' & ' || p_name || ' bundles' end"""

BRAND = """case when p_size <= 3 then null when p_size = 4 then ' ' when p_size = 5 then 'NaN'
 when p_size <= 10 then p_brand || ' & Sons' else p_brand end"""

PRODUCT_TYPE = """case p_type when 'ECONOMY' then 'BWS' when 'PROMO' then 'Party & Celebration'
 when 'SMALL' then 'Pets' when 'LARGE' then 'Alcoholic Beverages' when 'MEDIUM' then 'Electronics'
 else 'Unlisted' end"""

# A line's own spelling of its product title: same key, different text.
LINE_TITLE = """case l_returnflag when 'A' then upper(p_title) when 'R' then p_title || '!'
 else p_title end"""

PART_COLUMNS = f"p_partkey, {TITLE} as p_title, {BRAND} as p_maker, p_retailprice"

LINE_COLUMNS = f"""
 cast(year(l_shipdate) as bigint) as feed_id,
 substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast(month(l_shipdate) as int) - 2, 3) as month,
 cast(13 - month(l_shipdate) as bigint) as file_seq,
 (l_orderkey * 8 + l_linenumber) * 16777216 + (l_partkey * 1009 + l_suppkey) % 16777216 as row_seq,
 {LINE_TITLE} as title,
 p_maker as brand,
 case when l_discount = 0 then null when l_discount = 0.01 then '  ' when l_linestatus = 'F'
      then 'sold out' else 'in stock' end as availability,
 case when l_tax = 0.08 then null else cast(p_retailprice as varchar(32)) end as price,
 case when l_tax = 0 then null when l_tax = 0.01 and l_discount < 0.05 then 'n/a'
      else cast(cast(l_quantity as int) as varchar(16)) end as popularity_rank"""

PRODUCT_COLUMNS = f"""p_partkey as row_id, {TITLE} as title, {BRAND} as brand,
 {PRODUCT_TYPE} as product_type"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, spread over the cores when it has fewer splits than there are cores.

    A small table is one file with one row group, so a single task would do all the work on it.  A
    table of real size has more splits than cores and is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        # On the leading id, skipping rows that share it only in tables with no better column.
        return df.repartition(cores, *df.columns[:2])
    return df


def _select(df: DataFrame, columns: str) -> DataFrame:
    # varchar lengths matter to neither engine here; Spark expressions want plain string.
    text = columns.replace("varchar(32)", "string").replace("varchar(16)", "string")
    # Braces in a text expression are not placeholders.
    text = text.replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"select {text} from {{df}}", df=df)


def monthly_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a feed row; the ship year is the feed, the ship month its file."""
    lines = table(spark, sf_dir, "lineitem")
    # Titles are built once per part, ahead of the join, not once per line.
    parts = _select(table(spark, sf_dir, "part"), PART_COLUMNS)
    return _select(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), LINE_COLUMNS)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a catalogue product with a stable row id."""
    return _select(table(spark, sf_dir, "part"), PRODUCT_COLUMNS)


# The part names seen as a taxonomy: noun, a kind of it, a line of that; 'Unlisted' has none.
NOUN = "upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)"
TAXONOMY_COLUMNS = f"""distinct
 case when ({PRODUCT_TYPE}) = 'BWS' then 'Alcoholic Beverages' else {PRODUCT_TYPE} end as product_type,
 {NOUN} as level1,
 case when p_size > 48 then null when p_brand = 'Brand#1' then {NOUN} || ' Phone Cases'
      when p_brand = 'Brand#2' then {NOUN} || ' Controllers'
      when p_brand = 'Brand#3' then {NOUN} || ' Camera Bags'
      when p_brand = 'Brand#5' then {NOUN} || ' & Dog Food' else p_name end as level2,
 case when p_size > 40 then null when p_type = 'MEDIUM' then p_name || ' Château'
      when p_type = 'LARGE' then p_name || ' Single Malt' else p_name || ' Brand' end as level3"""

# Product titles that set off the accessory rules.
GADGET_COLUMNS = f"""p_partkey as row_id, {PRODUCT_TYPE} as product_type,
 case p_brand when 'Brand#1' then p_name || ' iPhone Case' when 'Brand#2' then p_name || ' Controller'
 when 'Brand#3' then p_name || ' Camera Bag' when 'Brand#4' then 'Canon ' || p_name || ' camera'
 when 'Brand#5' then p_name || ' & Dog Food' when 'Brand#6' then p_name || ' dog bowl'
 when 'Brand#7' then 'Irish Whiskey ' || p_name when 'Brand#8' then null
 when 'Brand#9' then p_type || p_name else p_name || ' leader' end as title"""

# What a model would extract from a product title.
ENTITY_COLUMNS = f"""p_partkey as row_id, {TITLE} as title,
 case when p_size = 1 then null when p_size <= 12 then 'Majestic' when p_size = 13 then ''
      when p_size <= 20 then p_brand || ' Château' else p_brand end as brand,
 case when p_type = 'STANDARD' then '' when p_type = 'SMALL' then upper(p_name) else p_name end
   as product_name,
 case p_type when 'MEDIUM' then '' || (1970 + p_size) else null end as vintage,
 case p_type when 'LARGE' then '' || p_size else '' end as age_statement,
 case p_type when 'LARGE' then 'Whisky' when 'SMALL' then 'Liqueur' else '' end as product_type,
 case when p_type = 'MEDIUM' and p_size > 25 then 'Bordeaux' else '' end as region,
 case when p_type = 'MEDIUM' and p_size <= 25 then 'Rosé' else null end as varietal,
 case p_type when 'ECONOMY' then 'Case of 6' else '' end as pack_format,
 case when p_type = 'PROMO' or p_size > 45 then 'Definition' else '' end as collection"""


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-level taxonomy from the part names: as many nodes as there are names, times types."""
    return _select(table(spark, sf_dir, "part"), TAXONOMY_COLUMNS).filter(
        "product_type != 'Unlisted'")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword index of that taxonomy."""
    from shelfline.operators.taxonomy import keyword_index, positioned, taxonomy_paths

    return keyword_index(positioned(taxonomy_paths(taxonomy(spark, sf_dir))))


def gadgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with titles that set off the accessory rules."""
    return _select(table(spark, sf_dir, "part"), GADGET_COLUMNS)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the nine entity fields of their titles."""
    return _select(table(spark, sf_dir, "part"), ENTITY_COLUMNS)


def select_from(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    """A given table through SQL expressions."""
    return _select(table(spark, sf_dir, name), columns)
