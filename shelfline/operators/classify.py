"""Three-level classification of titles with a keyword dictionary.

A dictionary is a table ``product_type, path, pos, keyword`` where ``pos`` is the path's place in
its type.  "The keyword occurs in the title on word boundaries" is a theta join; it runs as an
equi-join instead:

* a title is cut into alternating runs of word and non-word characters;
* every stretch of runs that has boundaries at both ends, and as many runs as some keyword has, is
  a gram of the title;
* a keyword matches exactly when it is one of the grams, so grams and keywords join on equality.

Only grams leave a title, never title-keyword pairs; how many there are does not depend on how
many keywords share a word.  A match is one packed number, so its minimum is a hash aggregation.
A dictionary beyond the broadcast bound is joined by a shuffle past the grams that many titles share:
those are few, and their entries are broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import leaf_of, let, level_of, path_parts
from shelfline.session import BROADCAST_BYTES, BROADCAST_ROWS, join_past_heavy, written

_RUN = r"(?Ud)(\w+|\W+)"
_WORD_START = r"(?Ud)^\w"

# A packed match: longest keyword first, then the shallowest path, then the earliest.
_LENGTHS = 1 << 16
_DEPTH_BIT = 40
_LENGTH_BIT = 44

FLAGS = ["phone_accessory", "controller", "camera_accessory", "main_camera", "pet_food",
         "pet_accessory"]


def fold_title(title: Column) -> Column:
    """Lower case with one spelling of whisky; a null title becomes empty."""
    return F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit("whiskey"), F.lit("whisky"))


def _holds_any(text: Column, terms) -> Column:
    return reduce(or_, [F.contains(text, F.lit(t)) for t in terms])


def accessory_flags(folded: Column) -> dict[str, Column]:
    """Six substring tests on a folded title."""
    camera_accessory = _holds_any(folded, fv.CAMERA_ACCESSORY_TERMS)
    pet_food = _holds_any(folded, fv.PET_FOOD_TERMS)
    return {
        "phone_accessory": _holds_any(folded, fv.PHONE_ACCESSORY_TERMS)
        & _holds_any(folded, fv.PHONE_BRANDS),
        "controller": _holds_any(folded, fv.CONTROLLER_TERMS),
        "camera_accessory": camera_accessory,
        "main_camera": _holds_any(folded, fv.CAMERA_BRANDS) & F.contains(folded, F.lit("camera"))
        & ~camera_accessory,
        "pet_food": pet_food,
        "pet_accessory": _holds_any(folded, fv.PET_ACCESSORY_TERMS) & ~pet_food,
    }


def _path_traits(path: Column) -> dict[str, Column]:
    """What the accessory rules ask of a path; constant per dictionary entry."""
    return {
        "phone_path": _holds_any(path, fv.PHONE_PATHS),
        "controller_path": _holds_any(path, fv.CONTROLLER_PATHS),
        "camera_accessory_path": _holds_any(path, fv.CAMERA_ACCESSORY_PATHS),
        "pet_food_path": _holds_any(path, fv.PET_FOOD_PATHS),
        "food_path": _holds_any(path, fv.FOOD_PATHS),
    }


def _allowed() -> Column:
    """The accessory rules over title flags and path traits."""
    c = F.col
    camera = (F.when(c("camera_accessory"), c("camera_accessory_path"))
              .when(c("main_camera"), ~c("camera_accessory_path")).otherwise(F.lit(True)))
    food = (F.when(c("pet_food"), c("pet_food_path"))
            .when(c("pet_accessory"), ~c("food_path")).otherwise(F.lit(True)))
    return ((~c("phone_accessory") | c("phone_path"))
            & (~c("controller") | c("controller_path")) & camera & food)


def mapped_type(product_type: Column, aliases=None) -> Column:
    """Legacy short names become the type they stand for."""
    mapped = product_type
    for short, full in (aliases or fv.PRODUCT_TYPE_ALIASES).items():
        mapped = F.when(product_type == short, F.lit(full)).otherwise(mapped)
    return mapped


def default_level1(product_type: Column, defaults=None) -> Column:
    pairs = (defaults or fv.DEFAULT_LEVEL1).items()
    by_type = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(by_type, mapped_type(product_type)),
                      F.try_element_at(by_type, product_type), F.lit(fv.NO_LEVEL1))


def dictionary_entries(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows ready to be joined: shape of the keyword, packed rank, traits of the path."""
    depth = F.size(F.split("path", " > ")) - 1
    rank = (F.shiftleft((F.lit(_LENGTHS) - F.length("keyword")).cast("bigint"), _LENGTH_BIT)
            + F.shiftleft(depth.cast("bigint"), _DEPTH_BIT) + F.col("pos").cast("bigint"))
    return dictionary.filter("keyword != ''").select(
        F.col("product_type").alias("entry_type"), "keyword",
        F.col("keyword").rlike(_WORD_START).alias("starts_in_word"),
        F.size(F.regexp_extract_all(F.col("keyword"), F.lit(_RUN), 1)).alias("n_runs"),
        rank.alias("rank"), "pos", "path",
        *[c.alias(n) for n, c in _path_traits(F.col("path")).items()])


def _grams(folded: Column, shapes: list[tuple[bool, int]]) -> Column:
    """Distinct stretches of a title in the given shapes: (starts in a word, number of runs).

    Runs alternate, so the starts of one shape are every second run.  A stretch that begins with a
    non-word run has a boundary there only if a run precedes it, and one that ends with a non-word
    run only if a run follows.
    """
    def of_shape(runs: Column, word: bool, size: int) -> Column:
        leads = F.get(runs, F.lit(0)).rlike(_WORD_START)
        first = F.when(leads == F.lit(word), 1 if word else 3).otherwise(2)
        ends_in_word = word == (size % 2 == 1)
        last = F.size(runs) - size + (1 if ends_in_word else 0)
        text = lambda i: F.get(runs, i - 1) if size == 1 else F.array_join(
            F.slice(runs, i, F.lit(size)), "")
        return F.when(last >= first, F.transform(
            F.sequence(first, last, F.lit(2)), text)).otherwise(
            F.array().cast("array<string>"))

    return let(F.regexp_extract_all(folded, F.lit(_RUN), 1), lambda runs: F.array_distinct(
        F.flatten(F.array(*[of_shape(runs, w, n) for w, n in shapes]))))


def match_categories(titles: DataFrame, dictionary: DataFrame, title: str = "title",
                     product_type: str = "product_type", path: str = "category_path") -> DataFrame:
    """Add the path of the longest matching keyword, or null.

    Every row stays, equal rows included.  Each distinct (title, type) is matched once: only those
    two and the accessory flags are laid out gram by gram, and the answer joins back to the rows.
    """
    # Worked out once: it is read for the shapes of grams and its size, the probes and the places.
    entries = written(dictionary_entries(dictionary), "dictionary")
    shapes, rows, size, deepest = entries.agg(
        F.collect_set(F.struct("starts_in_word", "n_runs")), F.count("*"),
        F.sum(F.octet_length("keyword") + F.octet_length("path")),
        F.max(F.size(F.split("path", " > ")))).first()
    if rows == 0:
        return titles.withColumn(path, F.lit(None).cast("string"))
    if deepest > 1 << (_LENGTH_BIT - _DEPTH_BIT):
        raise ValueError(f"a path of {deepest} levels is deeper than a packed match can say")
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    kind = mapped_type(F.col(product_type))
    # Flags come before the grams: next to an explode they would be worked out per gram.
    # Titles are short and gramming them is not: left to their size in bytes they would be put
    # together into a few tasks.  The hash keeps this exchange: one on the same columns would be taken
    # for the one of ``distinct``.
    width = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = titles.select(F.col(title).alias("_title"), kind.alias("_type")).distinct().repartition(
        width, F.xxhash64("_title", "_type")).withColumn("_folded", fold_title(F.col("_title"))).select(
        "_title", "_type", "_folded",
        *[c.alias(n) for n, c in accessory_flags(F.col("_folded")).items()])
    opened = flagged.select(*[c for c in flagged.columns if c != "_folded"], F.explode(_grams(
        F.col("_folded"), sorted((s[0], s[1]) for s in shapes))).alias("_gram"))

    # Paths sharing a keyword and the same traits match the same titles, so only the best of them
    # is probed.
    traits = list(_path_traits(F.lit("")))
    probes = entries.groupBy("entry_type", "keyword", *traits).agg(F.min("rank").alias("rank"))

    def joined(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str],
               condition: Column | None = None) -> DataFrame:
        if not small:
            return join_past_heavy(left, right, left_on, right_on, condition)
        same = reduce(and_, [F.col(a) == F.col(b) for a, b in zip(left_on, right_on)])
        return left.join(F.broadcast(right), same if condition is None else same & condition)

    matched = joined(opened, probes, ["_gram", "_type"], ["keyword", "entry_type"], _allowed())
    position = F.col("_rank").bitwiseAND((1 << _DEPTH_BIT) - 1)
    best = matched.groupBy("_title", "_type").agg(F.min("rank").alias("_rank")).select(
        "_title", "_type", position.alias("_pos"))

    places = entries.select(F.col("entry_type").alias("_place_type"), F.col("pos").alias("_place"),
                            F.col("path").alias(path)).distinct()
    named = joined(best, places, ["_type", "_pos"], ["_place_type", "_place"]).select(
        "_title", "_type", path)
    return (titles.withColumn("_kind", kind).alias("t")
            .join(named.alias("b"), (F.col(f"t.{title}") == F.col("b._title"))
                  & (F.col("t._kind") == F.col("b._type")), "left")
            .select(*[F.col(f"t.`{c}`") for c in titles.columns], F.col(f"b.{path}")))


def with_category_levels(titles: DataFrame, dictionary: DataFrame, title: str = "title",
                         product_type: str = "product_type") -> DataFrame:
    """Level 1 to 3 per title: the type's default level 1 and "Other" where nothing matches."""
    matched = match_categories(titles, dictionary, title, product_type, "_path")
    path = F.col("_path")
    return matched.select(
        *titles.columns,
        F.coalesce(path_parts(path)[0], default_level1(F.col(product_type))).alias("level1"),
        level_of(path, 2).alias("level2"), level_of(path, 3).alias("level3"))


def with_category(titles: DataFrame, dictionary: DataFrame, title: str = "title",
                  product_type: str = "product_type", into: str = "category") -> DataFrame:
    """The single-column form: the leaf of the matched path, or "Other"."""
    matched = match_categories(titles, dictionary, title, product_type, "_path")
    return matched.select(*titles.columns, F.coalesce(
        leaf_of(F.col("_path")), F.lit(fv.NO_CATEGORY)).alias(into))
