"""Search keywords from extracted entities: candidates, weights, best one.

Entities arrive as nine string columns (brand, product_name, ...).  Candidates stay an array inside
their row and are scored there, so the whole rule is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import ascii_fold, let


def _field(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _folded(name: str) -> Column:
    return F.trim(ascii_fold(F.lower(F.coalesce(F.col(name), F.lit("")))))


def _phrase(*parts: Column) -> Column:
    """The non-empty parts joined by spaces, lower-cased and folded to ASCII."""
    held = F.filter(F.array(*parts), lambda p: p != "")
    return F.trim(ascii_fold(F.lower(F.array_join(held, " "))))


def candidates() -> Column:
    """All template keywords of a row, distinct, in template order."""
    brand, product, vintage, age, kind, region, varietal, pack, collection = map(
        _field, fv.ENTITY_FIELDS)
    has = {n: c != "" for n, c in zip(
        ["brand", "product", "vintage", "age", "kind", "region", "varietal", "pack",
         "collection"],
        [brand, product, vintage, age, kind, region, varietal, pack, collection])}
    word = F.lit

    def when(*needed: str, text: tuple, unless: str | None = None) -> Column:
        test = F.lit(True)
        for name in needed:
            test = test & has[name]
        if unless:
            test = test & ~has[unless]
        return F.when(test, _phrase(*text))

    templates = F.array(
        # a named product
        when("product", text=(product,)),
        when("product", "vintage", text=(product, vintage)),
        when("product", "brand", text=(brand, product)),
        when("product", "brand", "vintage", text=(brand, product, vintage)),
        when("product", "brand", "kind", text=(brand, product, kind)),
        when("product", text=(product, word("wine"))),
        # an age statement
        when("brand", "age", text=(brand, age)),
        when("brand", "age", "kind", text=(brand, age, kind)),
        # brand and type without an age
        when("brand", "kind", text=(brand, kind), unless="age"),
        # grape and region
        when("varietal", "vintage", text=(varietal, vintage)),
        when("varietal", "vintage", "collection", text=(collection, varietal, vintage)),
        when("varietal", text=(varietal, word("majestic"))),
        when("region", "vintage", text=(region, vintage, word("wine"))),
        when("region", "vintage", "collection", text=(collection, region, vintage)),
        # packs
        when("pack", "brand", "product", text=(brand, product, word("case"))),
        when("pack", "product", text=(product, word("mixed case"))),
        when("pack", "product", text=(product, word("6 bottle case"))),
        when("pack", "product", text=(product, word("wine case"))),
        when("pack", "brand", "product", text=(brand, product, word("wine"))))
    # A brand alone stands in only when no template applies, which needs neither product, type,
    # age nor varietal; so its varietal forms cannot arise.
    fallback = F.array(when("brand", text=(brand,)))
    present = lambda a: F.filter(a, lambda c: c.isNotNull())
    return F.array_distinct(let(present(templates), lambda found: F.when(
        F.size(found) > 0, found).otherwise(present(fallback))))


def _evidence(title: Column) -> Column:
    """What candidates of a row are weighed against, worked out once per row."""
    brand, age = _folded("brand"), _folded("age_statement")
    pack = _folded("pack_format")
    return F.struct(
        *[_folded(f).alias(f) for f in fv.ENTITY_FIELDS],
        brand.isin(fv.ENTITY_RETAILER_BRANDS).alias("retailer"),
        (F.contains(F.lower(title), F.lit("case")) | F.contains(pack, F.lit("case"))).alias("case"),
        F.concat(F.regexp_extract_all(brand, F.lit(r"(\d+)"), 1),
                 F.filter(F.array(age), lambda a: a != "")).alias("critical"))


def candidate_score(candidate: Column, e: Column) -> Column:
    """Weight of one candidate given the row's evidence."""
    text = F.lower(candidate)
    zero = F.lit(0)
    points = lambda test, weight: F.when(test, F.lit(weight)).otherwise(zero)
    given = lambda *fields: [e[f] != "" for f in fields]
    held = lambda field: (e[field] != "") & F.contains(text, e[field])
    lacks = lambda field: ~F.contains(text, e[field])

    def exactly(*fields: str) -> Column:
        test = F.concat_ws(" ", *[e[f] for f in fields]) == text
        for one in given(*fields):
            test = one & test
        return test

    lost = F.size(F.filter(e["critical"], lambda t: ~F.contains(text, t)))
    generic = ((e["brand"] != "") & lacks("brand") & ~e["retailer"]
               & ((e["collection"] == "") | lacks("collection")))
    return (points(held("product_name"), fv.W_PRODUCT)
            + points(held("vintage"), fv.W_VINTAGE)
            + F.when(held("brand"), F.when(e["retailer"], F.lit(fv.W_RETAILER_BRAND)).otherwise(
                F.lit(fv.W_BRAND))).otherwise(zero)
            + points(exactly("brand", "age_statement"), fv.W_BRAND_AGE)
            + points((e["age_statement"] == "") & exactly("brand", "product_type"),
                     fv.W_BRAND_TYPE)
            + points(exactly("brand", "product_name", "product_type"), fv.W_BRAND_PRODUCT_TYPE)
            + points(e["case"] & F.contains(text, F.lit("case")), fv.W_CASE)
            + lost * F.lit(fv.W_LOST_TOKEN)
            + points(F.contains(text, F.lit("year old")) | F.contains(text, F.lit("years old")),
                     fv.W_VERBOSE_AGE)
            + points(generic, fv.W_GENERIC))


def scored_candidates(found: Column, title: Column) -> Column:
    """``array<struct<rank, length, candidate>>``; its minimum is the best candidate.

    Ties on score and length go to the alphabetically first text.
    """
    return let(_evidence(title), lambda e: F.transform(found, lambda c: F.struct(
        (-candidate_score(c, e)).alias("rank"), F.length(c).alias("length"),
        c.alias("candidate"))))


def has_entities() -> Column:
    return F.exists(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fv.ENTITY_FIELDS]),
                    lambda v: v != "")
