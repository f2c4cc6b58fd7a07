import pytest
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions import text as tx
from shelfline.operators import keywords as kw

PHRASES = [
    ("Torvane 18 Year Old The Smoky Heart of Highland Peat Single Malt Whisky", "Torvane", "Torvane Peat Whisky"),
    ("Millers Small Batch Rye 700ml", "Millers", "Millers Rye"),
    ("Harbour Lane Pale Crate 12x440ml", "Harbour Lane", "Harbour Lane Pale Crate"),
    ("Glenmorra 21 Year Old Single Malt Whisky", "Glenmorra", "Glenmorra 21Yr Whisky"),
    ("Personalised Deluxe Silver Heron Gin Gift Hamper", "Silver Heron", "Silver Heron Gin"),
    ("Personalised Crystal Brandy Set", "", "Crystal Brandy"),
    ("Tic Tac Pinho Tinto 2021", "Tic Tac", "Tic Tac Pinho Tinto"),
    ("Corvins Spritzers 2L Corvins Raspberry Bellini Spritzer", "Corvins", "Corvins Spritzers Raspberry Bellini"),
    ("Rum UK Easter Edition Pineapple Splash Rum", "", "Rum Uk Easter Pineapple"),
    ("Quiet River Rosé Cider", "Quiet River", "Quiet River Rose Cider"),
    ("Crème & Châtel Demi Sec", "Crème & Châtel", "Creme Chatel Demi Sec"),
    ("Black Friday Lorenzos Bestsellers", "Lorenzos", "Lorenzos Bestsellers"),
    ("City Badger Ginger Cordial 70cl 18% ABV", "City Badger", "City Badger Ginger Cordial"),
    ("Buy Wobbly Goose Stout Red Barn Shop", "Wobbly Goose", "Wobbly Goose Stout Red"),
    ("Fenwicks Premium White Port Selection", "Fenwicks", "Fenwicks White Port"),
    ("Old Tom's Kentucky Whiskey", "Old Tom's", "Toms Whiskey"),
    ("Delacroix Special Reserve Champagne", "Delacroix", "Delacroix"),
    ("Summit Merlot 14.5%", "Summit", "Summit Merlot 14"),
    ("Lowland Mist 1.5l", "Old Tom's", "Old TomS Mist 1"),
    ("Blåbær Likør", "", "Blbr Likr"),
    ("", "Acme", ""), (None, None, ""), ("   ", None, ""),
]

ENTITIES = [
    ("Domaine Arvelle 2018", "Domaine Arvelle 2018", dict(brand="Domaine Arvelle", product_name="Arvelle", vintage="2018", region="Medoc", varietal="Red Blend")),
    ("Clare Riesling 2021", "Riesling 2021", dict(vintage="2021", region="Clare", varietal="Riesling")),
    ("Linha 9 12 Bottle Case", "Linha 9 White Wine Case", dict(brand="Linha 9", product_name="White Wine", region="Porto", pack_format="12 Bottle Case")),
    ("Old Tom's Kentucky Whiskey", "Tom's Kentucky Whiskey", dict(brand="Old Tom's", product_name="Kentucky Whiskey")),
    ("Majestic Le Rocher Doré 2023", "Le Rocher Dore 2023", dict(brand="Majestic", product_name="Le Rocher Doré", vintage="2023")),
    ("Chosen by Majestic Nero 2020/22", "Nero 2020", dict(brand="Majestic", product_name="Nero", vintage="2020", varietal="Nero", collection="Chosen by Majestic")),
    ("Majestic Domaine Arvelle 2018/19", "Majestic Medoc 2018", dict(brand="Domaine Arvelle", vintage="2018", region="Medoc", collection="Majestic")),
    ("Torvane", "Torvane 18", dict(brand="Torvane", age_statement="18", product_type="Whisky")),
    ("Kilnara", "Kilnara Coffee Cream Liqueur", dict(brand="Kilnara", product_name="Coffee Cream", product_type="Liqueur")),
    ("Mono", "Mono", dict(brand="Mono")),
]


def test_phrase_keyword(spark):
    df = spark.createDataFrame(PHRASES, "title string, brand string, want string")
    for r in kw.phrase_keyword(df).collect():
        assert r.keyword == r.want, r.title


def test_phrase_keyword_keeps_columns_and_takes_limits(spark):
    df = spark.createDataFrame([(7, "Glenmorra 21 Year Old Malt Whisky", "Glenmorra", "old")],
                               "row_id long, title string, brand string, keyword string")
    row = kw.phrase_keyword(df, max_words=2).first()
    assert row.asDict() == {"row_id": 7, "title": df.first().title, "brand": "Glenmorra",
                            "keyword": "Glenmorra 21Yr"}


def test_hybrid_keyword(spark):
    cases = [("Glenmorra 21 Year Old Single Malt Whisky 700ml", "Glenmorra", "Glenmorra 21Yr Whisky"),
             ("Millers Small Batch Rye 700ml", "Millers", "Millers Small Batch Rye"),
             ("Harbour Lane Pale Crate 12x440ml", "Harbour Lane", "Harbour Lane Pale Ale"),
             ("Buy Wobbly Goose Stout Red Barn Shop", "Wobbly Goose", "Wobbly Goose Red Stout"),
             ("Tic Tac Pinho Tinto 2021 750ml", "Tic Tac", "Tic Tac Pinho Tinto"),
             ("Old Tom's Kentucky Whiskey 40%", "Old Tom's", "Old Toms Kentucky Whiskey"),
             (None, None, "")]
    df = spark.createDataFrame(cases, "title string, brand string, want string")
    for r in kw.hybrid_keyword(df).collect():
        assert r.keyword == r.want, r.title


def test_merchant_name_is_removed_anywhere(spark):
    df = spark.createDataFrame([("Acme Gin by ACME Stores", "x", "acme"), ("Dry Gin", "x", None)],
                               "t string, b string, m string")
    got = [r.v for r in df.select(tx.squeeze(tx.strip_names(F.col("t"), F.col("m"))).alias("v")).collect()]
    assert got == ["gin by stores", "dry gin"]


def test_entity_keyword(spark):
    rows = [(t, w, *[e.get(f, "") for f in fv.ENTITY_FIELDS]) for t, w, e in ENTITIES]
    schema = "title string, want string, " + ", ".join(f"{f} string" for f in fv.ENTITY_FIELDS)
    for r in kw.entity_keyword(spark.createDataFrame(rows, schema)).collect():
        assert r.keyword == r.want and r.keyword_error is None, r.title


def test_entity_keyword_reasons(spark):
    schema = "title string, " + ", ".join(f"{f} string" for f in fv.ENTITY_FIELDS)
    rows = [("nothing", *[None] * 9), ("region", *[None] * 5, "Rioja", None, None, None)]
    got = {r.title: r.keyword_error for r in kw.entity_keyword(
        spark.createDataFrame(rows, schema)).collect()}
    assert got == {"nothing": "No entities extracted for: nothing",
                   "region": "No candidates generated for: region"}


@pytest.mark.parametrize("rule, cases", [
    (tx.fold_accents, [("Rosé Straße Ñ ø", "Rose Strasse N ø"), (None, None)]),
    (tx.ascii_fold, [("Rosé Straße ø Å", "Rose Strae  A")]),
    (tx.simplify_ages, [("12 Year Old", "12yr"), ("12-years-old 5YO", "12yr 5yr")]),
    (tx.title_case, [("12yr daniel's x-y", "12Yr Daniel'S X-Y"), ("ABC", "Abc")]),
    (tx.deduplicate, [("Vodka burst vodka VODKA", "Vodka burst"), ("", "")]),
    (tx.deduplicate_stems, [("cocktails Cocktail berries berry glass boxes box", "cocktails berries glass boxes"),
                            ("cookies cookieses", "cookies")]),
    (tx.normalize_title, [("Linha 9 | Mix Any Six & Save", "linha 9"), ("A - B – C", "a b c"),
                          ("Save now", "save now"), (None, ""), ("Rosé, co-op!", "rose co-op")]),
    (tx.clean_keyword, [("torvane 12 year old single malt", "Torvane 12"),
                        ("old tom's a 6 6", "Tom's 6"), (None, "")]),
    (tx.clean_brand, [("The Crème & Châtel's", "Creme Chatels"), (None, "")]),
])
def test_text_rules(spark, rule, cases):
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.select("t", "want", rule(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_word_scores_repeat_within_a_text(spark):
    df = spark.createDataFrame([(1, "blue ale and ale"), (2, "blue")], "id long, text string")
    got = {(r.id, r.word): (r.freq, r.degree, r.score) for r in kw.word_scores(df, ["id"], "text").collect()}
    assert got == {(1, "blue"): (1, 1, 2.0), (1, "ale"): (2, 1, 1.5), (2, "blue"): (1, 0, 1.0)}


def test_top_phrase_with_repeats(spark):
    # Hyphens make the words of one token repeat, so the length rule does not apply.
    df = spark.createDataFrame([("blue ale-ale and red wine cup",), ("one the two",)], "t string")
    got = [r.p for r in df.select(kw.top_phrase(tx.candidate_phrases(F.col("t"))).alias("p")).collect()]
    assert got == ["blue ale ale", "one"]


def test_keyword_plans_stay_in_one_stage(spark):
    df = spark.range(5).select(F.lit("Red Wine 75cl").alias("title"), F.lit("Acme").alias("brand"))
    for build in (kw.phrase_keyword, kw.hybrid_keyword):
        plan = build(df)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
