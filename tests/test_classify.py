import random
import re

import pytest
from pyspark.sql import functions as F

from shelfline.operators import classify as cl
from shelfline.operators import taxonomy as ta
from shelfline.session import join_past_heavy
from shelfline.operators.fuzzy import KindIndex, LeafMasks, fuzzy_category, partial_ratio

DICT_SCHEMA = "product_type string, path string, pos long, keyword string"
ENTRIES = [
    ("Alcoholic Beverages", "Beer", 0, ["beer"]),
    ("Alcoholic Beverages", "Beer > Ale > IPA", 1, ["hop", "xpa"]),
    ("Alcoholic Beverages", "Beer > Ale > Pale Ale", 2, ["pale ale", "xpa"]),
    ("Alcoholic Beverages", "Beer > Lager", 3, ["nordsee", "lager"]),
    ("Alcoholic Beverages", "Beer > Lager > Pilsner", 4, ["nordsee", "pilsner"]),
    ("Alcoholic Beverages", "Spirits > Whisky", 5, ["whisky", "kilnara"]),
    ("Alcoholic Beverages", "Spirits > Whisky > Bourbon", 6, ["old toms", "bourbon"]),
    ("Alcoholic Beverages", "Spirits > Whisky > Irish", 7, ["kilnara", "irish whiskey"]),
    ("Alcoholic Beverages", "Wine", 8, ["wine"]),
    ("Alcoholic Beverages", "Liqueurs & Cordials", 9, ["& cordials", "pre-mix"]),
    ("Electronics", "Mobile > Phones", 0, ["iphone", "iphone 13"]),
    ("Electronics", "Mobile > Mobile Phone Accessories > Phone Cases", 1, ["case"]),
    ("Electronics", "Gaming > Consoles", 2, ["ps5"]),
    ("Electronics", "Gaming > Gaming Controllers", 3, ["controller"]),
    ("Cameras & Optics", "Cameras", 0, ["canon"]),
    ("Cameras & Optics", "Camera Accessories > Camera Bags", 1, ["camera bag", "canon"]),
    ("Pets", "Dog Supplies > Dog Food", 0, ["adult dog"]),
    ("Pets", "Dog Supplies > Bowls", 1, ["dog bowl", "dog food bowl"]),
]
CASES = [
    ("Old Toms Kentucky Whiskey", "BWS", "Spirits", "Whisky", "Bourbon"),
    ("Nordsee Premium Lager", "Alcoholic Beverages", "Beer", "Lager", "Other"),
    ("Kilnara Irish Whiskey", "Alcoholic Beverages", "Spirits", "Whisky", "Other"),
    ("Quiet River Rosé Wine", "BWS", "Wine", "Other", "Other"),
    ("Brewpoint XPA", "BWS", "Beer", "Ale", "IPA"),
    ("iPhone 13 Case", "Electronics", "Mobile", "Mobile Phone Accessories", "Phone Cases"),
    ("PS5 Controller", "Electronics", "Gaming", "Gaming Controllers", "Other"),
    ("Canon Camera Bag", "Cameras & Optics", "Camera Accessories", "Camera Bags", "Other"),
    ("Canon EOS R5 Camera", "Cameras & Optics", "Cameras", "Other", "Other"),
    ("Waggles Adult Dog Food 20kg", "Pets", "Dog Supplies", "Dog Food", "Other"),
    ("Seafood Platter Wine", "BWS", "Alcoholic Beverages", "Other", "Other"),
    ("Mystery Item", "Pets", "Pet Supplies", "Other", "Other"),
    ("Headphones", "Nowhere", "Uncategorized", "Other", "Other"),
    ("Syrup& Cordials", "BWS", "Liqueurs & Cordials", "Other", "Other"),
    ("Syrup & Cordials", "BWS", "Alcoholic Beverages", "Other", "Other"),
    ("A pre-mix, chilled", "BWS", "Liqueurs & Cordials", "Other", "Other"),
    ("", "Pets", "Pet Supplies", "Other", "Other"),
    (None, "BWS", "Alcoholic Beverages", "Other", "Other"),
]


def dictionary(spark):
    rows = [(t, p, n, k) for t, p, n, ks in ENTRIES for k in ks]
    return spark.createDataFrame(rows, DICT_SCHEMA)


def test_levels(spark):
    rows = [(i, c[0], c[1]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id long, title string, product_type string")
    got = {r.row_id: (r.level1, r.level2, r.level3)
           for r in cl.with_category_levels(df, dictionary(spark)).collect()}
    assert got == {i: c[2:] for i, c in enumerate(CASES)}
    leaf = {r.row_id: r.category for r in cl.with_category(df, dictionary(spark)).collect()}
    assert leaf[0] == "Bourbon" and leaf[11] == "Other" and leaf[1] == "Lager"


def test_empty_dictionary_matches_nothing(spark):
    df = spark.createDataFrame([(1, "beer", "BWS")], "row_id long, title string, product_type string")
    empty = dictionary(spark).filter("false")
    assert cl.with_category(df, empty).first().category == "Other"


def test_grams_equal_word_boundary_search(spark):
    rng = random.Random(7)
    bits = ["red", "wine", "x", "&", "-", " ", "  ", "rosé", "12", "ale", "_", "'", "é", "."]
    keywords = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
                       for _ in range(120)} - {" ", "  "})
    titles = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    entries = spark.createDataFrame(
        [("T", f"P{i:03d}", i, k) for i, k in enumerate(keywords)], DICT_SCHEMA)
    df = spark.createDataFrame(list(enumerate(titles)), "row_id long, title string").withColumn(
        "product_type", F.lit("T"))
    got = {r.row_id: r.category_path for r in cl.match_categories(df, entries).collect()}
    assert len(got) == len(titles)
    hits = 0
    for i, title in enumerate(titles):
        found = [(-len(k), n) for n, k in enumerate(keywords)
                 if re.search(r"\b" + re.escape(k) + r"\b", title.lower())]
        want = f"P{min(found)[1]:03d}" if found else None
        hits += bool(found)
        assert got[i] == want, (title, got[i], want)
    assert hits > 100


def test_match_plan_is_an_equi_join(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.concat(
        F.lit("red wine "), "id").alias("title"), F.lit("BWS").alias("product_type"))
    plan = cl.with_category_levels(df, dictionary(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_equal_rows_stay(spark):
    rows = [("red wine", "BWS")] * 3 + [(None, "BWS")] * 2 + [("red wine", None)] * 2
    df = spark.createDataFrame(rows, "title string, product_type string")
    got = [(r.title, r.product_type, r.category) for r in cl.with_category(
        df, dictionary(spark)).collect()]
    assert sorted(got, key=str) == sorted(
        [("red wine", "BWS", "Wine")] * 3 + [(None, "BWS", "Other")] * 2
        + [("red wine", None, "Other")] * 2, key=str)


@pytest.mark.parametrize("rows, size", [(0, 1 << 30), (1 << 30, 0)])
def test_beyond_the_broadcast_bound_the_match_shuffles(spark, monkeypatch, rows, size):
    monkeypatch.setattr(cl, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(cl, "BROADCAST_BYTES", size)
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)],
                               "row_id long, title string, product_type string")
    got = {r.row_id: (r.level1, r.level2, r.level3)
           for r in cl.with_category_levels(df, dictionary(spark)).collect()}
    assert got == {i: c[2:] for i, c in enumerate(CASES)}


def test_heavy_grams_are_joined_apart(spark, monkeypatch):
    """A gram that half of all titles share, beyond the bound: one broadcast, one shuffle, equal rows."""
    rows = [(i, f"{'wine' if i % 2 else 'beer'} {i}" + (" pale ale" if i % 50 == 0 else ""), "BWS")
            for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, title string, product_type string")
    whole = sorted(map(tuple, cl.with_category_levels(df, dictionary(spark)).collect()))
    monkeypatch.setattr(cl, "BROADCAST_ROWS", 0)
    split = cl.with_category_levels(df, dictionary(spark))
    assert sorted(map(tuple, split.collect())) == whole and len({r[4] for r in whole}) > 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cl.with_category_levels(df, dictionary(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan and "NestedLoop" not in plan


def test_join_past_heavy_keys_is_the_join(spark):
    left = spark.createDataFrame([(i % 3 if i < 900 else i, i, "x") for i in range(1500)] + [(None, -1, "x")],
                                 "k long, v long, c string")
    right = spark.createDataFrame([(i, c) for i in range(0, 1500, 2) for c in "xy"] + [(None, "x")], "k2 long, c2 string")
    both = lambda df: sorted(map(tuple, df.collect()))
    for condition in (None, F.col("c") == F.col("c2")):
        same = F.col("k") == F.col("k2")
        want = left.join(right, same if condition is None else same & condition)
        assert both(join_past_heavy(left, right, ["k"], ["k2"], condition)) == both(want)
    assert join_past_heavy(left.limit(0), right, ["k"], ["k2"]).count() == 0


def test_keyword_index(spark):
    paths = spark.createDataFrame([
        ("T", "Spirits > Gin > London Dry Gin", 0), ("T", "Liqueurs & Cordials", 1),
        ("T", "Wine", 2), ("T", "Wine > Rosé Wine", 3)], "product_type string, path string, pos long")
    got = {}
    for r in ta.keyword_index(paths).collect():
        got.setdefault(r.pos, set()).add(r.keyword)
    assert got[0] == {"london dry gin", "london dry", "dry gin", "london"}
    assert got[1] == {"liqueurs & cordials", "liqueurs &", "& cordials", "liqueurs", "cordials"}
    assert got[2] == {"wine"} and got[3] == {"ros wine", "ros"}
    extra = spark.createDataFrame([("T", "Wine", "rioja")],
                                  "product_type string, path string, keyword string")
    assert ("Wine", "rioja") in {(r.path, r.keyword)
                                 for r in ta.keyword_index(paths, injected=extra).collect()}


def test_text_taxonomy(spark):
    lines = ["# header", "", "1 - Hardware > Tools", "no separator", "2 - Nothing > X",
             " 3 - Toys & Games > A - B "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {(r.product_type, r.path) for r in ta.parse_text_taxonomy(df).collect()} == {
        ("Hardware", "Hardware > Tools"), ("Toys", "Toys & Games > A - B")}
    numbered = spark.createDataFrame(
        [(9, "1 - Hardware > Tools"), (2, "2 - Hardware > Zinc"), (4, "3 - Toys & Games > B")],
        "line_no long, value string")
    assert {(r.path, r.pos) for r in ta.parse_text_taxonomy(numbered).collect()} == {
        ("Hardware > Zinc", 0), ("Hardware > Tools", 1), ("Toys & Games > B", 0)}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        nxt = [0]
        for j, y in enumerate(b):
            nxt.append(row[j] + 1 if x == y else max(row[j + 1], nxt[-1]))
        row = nxt
    return row[-1]


def _slow_ratio(a, b):
    if len(a) == len(b):
        return max(_slow_one_way(a, b), _slow_one_way(b, a))
    return _slow_one_way(a, b) if len(a) < len(b) else _slow_one_way(b, a)


def _slow_one_way(s, t):
    m = len(s)
    if not m:
        return 0.0 if t else 100.0
    windows = ([t[i:i + m] for i in range(len(t) - m + 1)] + [t[:k] for k in range(1, m)]
               + [t[-k:] for k in range(1, m)])
    return 100 * max(2 * _lcs(s, w) / (m + len(w)) for w in windows)


def test_partial_ratio_of_one_length_goes_both_ways():
    assert partial_ratio("abyy", "axbx") == partial_ratio("axbx", "abyy") == pytest.approx(200 / 3)
    assert LeafMasks().ratios(["abyy"], "axbx") == LeafMasks().ratios(["axbx"], "abyy")


def test_partial_ratio():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 8)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
        assert partial_ratio(a, b) == pytest.approx(_slow_ratio(a, b))
        assert LeafMasks().ratios([a, "ab", a], b) == [partial_ratio(x, b) for x in (a, "ab", a)]


def test_fuzzy_category_equals_search_over_all_pairs(spark):
    rng = random.Random(5)
    words = ["dog", "food", "bed", "dry", "cat", "toys", "bowls", "leads", "wet", "premium"]
    paths = sorted({" > ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 2)))
                               for _ in range(rng.randint(1, 3))).title() for _ in range(60)})
    titles = [" ".join(rng.choice(words + ["zz", "blue"]) for _ in range(rng.randint(1, 5)))
              for _ in range(60)] + ["", "qqqq"]
    table = spark.createDataFrame([("Pets", p, i) for i, p in enumerate(paths)],
                                  "product_type string, path string, pos long")
    df = spark.createDataFrame([(i, t, "Pets") for i, t in enumerate(titles)],
                               "row_id long, title string, product_type string")
    keys = {r.path: r.k for r in table.select(
        "path", ta.taxonomy_keywords(F.col("path")).alias("k")).collect()}
    got = {r.row_id: (r.category, round(r.confidence, 9))
           for r in fuzzy_category(df, table).collect()}
    # A taxonomy beyond the bound goes in several blocks.
    assert got == {r.row_id: (r.category, round(r.confidence, 9))
                   for r in fuzzy_category(df, table, size=6000).collect()}
    for i, title in enumerate(titles):
        best, top = None, 0
        for path in paths:
            score = 0.5 * _slow_ratio(path.split(" > ")[-1].lower(), title)
            for k in keys[path]:
                if k in title:
                    score += len(k) * (3 if re.search(rf"\b{re.escape(k)}\b", title) else 2)
            if score > top + 1e-9:
                best, top = path, score
        want = (best.split(" > ")[-1], round(min(top / 100, 1.0), 9)) if best and top > 20 else (
            "Other", 0.0)
        assert got[i] == want, title


def test_bounds_of_leaves_are_never_below_their_ratios():
    rng = random.Random(8)
    text = lambda most: "".join(rng.choice("abcde ") for _ in range(rng.randint(0, most)))
    index = KindIndex([(i, text(9), [], "") for i in range(50)])
    for _ in range(100):
        title = text(14)
        for leaf, bound in zip(index.leaves, index.bounds(title)):
            assert partial_ratio(leaf, title) <= bound + 1e-9


def test_fuzzy_category_outside_the_taxonomy(spark):
    table = spark.createDataFrame([("Pets", "Dogs", 0)], "product_type string, path string, pos long")
    df = spark.createDataFrame([(1, "dogs", "Toys"), (2, None, "Pets"), (3, "dogs", None)],
                               "row_id long, title string, product_type string")
    got = {r.row_id: (r.category, r.confidence) for r in fuzzy_category(df, table).collect()}
    assert got == {1: ("Other", 0.0), 2: ("Other", 0.0), 3: ("Other", 0.0)}
