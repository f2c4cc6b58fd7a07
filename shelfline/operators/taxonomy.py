"""Taxonomy tables: category lists, keyword index, taxonomy keywords.

A taxonomy is a table ``product_type, level1, level2, level3``; paths are joined with " > ".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import _U, strip_space, words_of
from shelfline.operators.classify import mapped_type
from shelfline.session import written


def with_aliases(taxonomy: DataFrame, aliases=None) -> DataFrame:
    """Repeat each type under its legacy short names."""
    pairs = [(short, full) for short, full in (aliases or fv.PRODUCT_TYPE_ALIASES).items()]
    names = taxonomy.sparkSession.createDataFrame(pairs, "alias string, product_type string")
    renamed = taxonomy.join(F.broadcast(names), "product_type").drop("product_type")
    return taxonomy.unionByName(renamed.withColumnRenamed("alias", "product_type"))


def missing_types(taxonomy: DataFrame, required=None) -> DataFrame:
    """Required types the taxonomy has no row for, as issues."""
    wanted = taxonomy.sparkSession.createDataFrame(
        [(t,) for t in (required or fv.PRODUCT_TYPES)], "product_type string")
    held = taxonomy.select("product_type").distinct()
    return wanted.join(held, "product_type", "left_anti").select(
        "product_type", F.concat(F.lit("No taxonomy rows for type "), "product_type")
        .alias("issue"))


def category_pairs(taxonomy: DataFrame) -> DataFrame:
    """Distinct "level 1 > level 2" per type, both present."""
    return (taxonomy.filter("level1 is not null and level2 is not null")
            .select("product_type", F.concat_ws(" > ", "level1", "level2").alias("category"))
            .distinct())


def in_sorted_order(df: DataFrame, by: list[str], within: list[str] | None = None, into: str = "place"
                    ) -> DataFrame:
    """Number rows from 1 in the order of ``by``, over all of them or for each value of ``within``.

    ``within`` are the first of ``by``.

    Rows are dealt out by ranges and numbered within; what is summed over ranges is one count each.
    ``by`` tells rows apart, so the numbers do not depend on the ranges.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = written(df.repartitionByRange(width, *by).sortWithinPartitions(*by).select(
        "*", F.spark_partition_id().alias("_range"), at.alias("_at")), "ranges")
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.join(F.broadcast(counts), "_range").select(  # a row for each range
        *df.columns, (F.col("_before") + F.col("_at") + 1).alias(into))
    if not within:
        return numbered
    firsts = numbered.groupBy(*within).agg(F.min(into).alias("_first"))
    return numbered.join(firsts, within).select(*df.columns, (F.col(into) - F.col("_first") + 1).alias(into))


def numbered_categories(taxonomy: DataFrame) -> DataFrame:
    """Category pairs with their place in the type's sorted list."""
    place = F.row_number().over(W.partitionBy("product_type").orderBy("category"))
    return category_pairs(taxonomy).withColumn("place", place)


def category_text(taxonomy: DataFrame, types: DataFrame) -> DataFrame:
    """One numbered text per requested type; a type without categories gets the fixed text.

    A type's list is taxonomy, not product data: its length is what a prompt can hold.
    """
    numbered = numbered_categories(taxonomy)
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.col("category"))
    texts = numbered.groupBy("product_type").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", line.alias("line")))),
        lambda x: x["line"]), "\n").alias("categories"))
    return (types.select("product_type").distinct().join(texts, "product_type", "left")
            .withColumn("categories", F.coalesce("categories", F.lit(fv.NO_CATEGORIES_TEXT))))


def deep_categories(paths: DataFrame) -> DataFrame:
    """Distinct level names below the first, per type, from ``product_type, path``.

    ``in_sorted_order`` gives lists of categories their places.
    """
    below = F.expr("slice(split(path, ' > '), 2, greatest(size(split(path, ' > ')) - 1, 0))")
    return (paths.select(mapped_type(F.col("product_type")).alias("product_type"),
                         F.explode(below).alias("category"))
            .select("product_type", strip_space(F.col("category")).alias("category")).distinct())


def leaf_categories(paths: DataFrame) -> DataFrame:
    """Distinct leaf names over all types."""
    return paths.select(strip_space(F.element_at(F.split("path", " > "), -1))
                        .alias("category")).distinct()


def taxonomy_paths(taxonomy: DataFrame) -> DataFrame:
    """Every node of a three-level taxonomy as a path: the levels and all their prefixes."""
    prefixes = [F.array("level1"), F.array("level1", "level2"),
                F.array("level1", "level2", "level3")]
    complete = lambda levels: F.forall(levels, lambda x: x.isNotNull())
    return (taxonomy.select("product_type", F.explode(F.array(*prefixes)).alias("levels"))
            .filter(complete(F.col("levels")))
            .select("product_type", F.array_join("levels", " > ").alias("path")).distinct())


def positioned(paths: DataFrame) -> DataFrame:
    """Paths with their place (from 0) in the type's order; a type holds taxonomy, not data."""
    place = F.row_number().over(W.partitionBy("product_type").orderBy("path")) - 1
    return paths.withColumn("pos", place.cast("bigint"))


def keyword_index(paths: DataFrame, generic=None, injected: DataFrame | None = None) -> DataFrame:
    """A keyword dictionary from ``product_type, path, pos``.

    A path gives its leaf name, the name's adjacent word pairs and its words that are not generic.
    ``injected`` adds known brand words: ``product_type, path, keyword``.
    """
    listed = list(generic or fv.GENERIC_INDEX_WORDS)
    leaf = F.element_at(F.split("path", " > "), -1)
    name = F.trim(F.regexp_replace(F.regexp_replace(
        F.lower(leaf), _U + r"[^a-z0-9\s&-]", ""), _U + r"\s+", " "))

    def phrases(words: Column) -> Column:
        pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
        return F.concat(F.array(F.array_join(words, " ")),
                        F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                        F.filter(words, lambda w: ~w.isin(listed)))

    built = paths.select("product_type", "path", "pos", words_of(name).alias("words")).select(
        "product_type", "path", "pos",
        F.explode(F.array_distinct(phrases(F.col("words")))).alias("keyword"))
    if injected is not None:
        added = injected.join(paths, ["product_type", "path"]).select(*built.columns)
        built = built.unionByName(added).distinct()
    return built.filter("keyword != ''")


def taxonomy_keywords(path: Column) -> Column:
    """Cleaned level names and their longer words, distinct over the path."""
    names = F.transform(F.split(path, " > "), lambda level: F.regexp_replace(
        strip_space(F.lower(level)), _U + r"[^a-z0-9\s&-]", ""))
    words = lambda name: F.filter(words_of(name), lambda w: (
        F.length(w) >= fv.TAXONOMY_MIN_WORD) & ~w.isin(fv.TAXONOMY_STOP_WORDS))
    return F.array_distinct(F.flatten(F.transform(
        names, lambda n: F.concat(F.array(n), words(n)))))


def parse_text_taxonomy(lines: DataFrame, types=None) -> DataFrame:
    """``ID - A > B > C`` lines (column ``value``) to type, path and place; the rest is skipped.

    With a ``line_no`` the paths of a type are numbered in its order from 0 in ``pos``.
    """
    text = strip_space(F.col("value"))
    pairs = [(top, kind) for top, kind in (types or fv.TOP_LEVEL_TYPES).items()]
    tops = lines.sparkSession.createDataFrame(pairs, "top string, product_type string")
    path = strip_space(F.element_at(F.split(text, " - ", 2), 2))
    keep = (text != "") & ~text.startswith("#") & text.contains(" - ")
    order = ["line_no"] if "line_no" in lines.columns else []
    found = (lines.filter(keep).select(path.alias("path"), *order)
             .withColumn("top", F.element_at(F.split("path", " > "), 1))
             .join(F.broadcast(tops), "top").select("product_type", "path", *order))
    if not order:
        return found
    place = F.row_number().over(W.partitionBy("product_type").orderBy("line_no")) - 1
    return found.select("product_type", "path", place.alias("pos"))
