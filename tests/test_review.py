import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfline.functions import replies as rp
from shelfline.operators import answers as answer_log
from shelfline.operators import batches as ba
from shelfline.operators import merge as me
from shelfline.operators import metrics as mt
from shelfline.operators import review as rv


def test_ordinals_over_sparse_and_hot_spans(spark):
    ids = [0, 1, 4095, 4096, 10 ** 6, 2 ** 36, 2 ** 36 + 1, 2 ** 50] + list(range(70_000, 72_000))
    df = spark.createDataFrame([(i,) for i in ids], "row_id long").repartition(7)
    got = {r.row_id: r.ordinal for r in ba.with_ordinal(df).collect()}
    assert got == {x: n for n, x in enumerate(sorted(ids))}


def test_sums_of_spans_do_not_draw_the_rows_into_one_task(spark, tmp_path):
    # The sums leave one task; a table whose files are small would be broadcast to it.
    for n, ids in enumerate(([0, 5, 9000], [0, 5, 2 ** 36])):
        spark.createDataFrame([(i,) for i in ids], "row_id long").write.parquet(str(tmp_path / str(n)))
        plan = ba.with_ordinal(spark.read.parquet(str(tmp_path / str(n))))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_batches_are_contiguous_and_limited(spark):
    df = spark.range(45).select((F.col("id") * 3).alias("row_id"), F.col("id").cast("string").alias("t"))
    got = {r.batch_no: [i.row_id for i in r["items"]] for r in ba.assemble(df, F.col("t"), 20).collect()}
    assert got == {0: [3 * i for i in range(20)], 1: [3 * i for i in range(20, 40)],
                   2: [3 * i for i in range(40, 45)]}
    assert ba.assemble(df, F.col("t"), 20, limit=5).first()["items"][-1].row_id == 12


def test_call_model_retries_only_quota_and_empty_replies(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(requests):
        calls.add(1)
        if requests[0] == "quota":
            raise RuntimeError("429 quota exceeded")
        if requests[0] == "boom":
            raise ValueError("boom")
        return ["" if requests[0] == "empty" else "ok " + requests[0]]

    df = spark.createDataFrame([("a",), ("quota",), ("boom",), ("empty",)], "request string").coalesce(1)
    got = {r.request: (r.reply, r.call_error) for r in ba.call_model(df, model, pause=0).collect()}
    assert got == {"a": ("ok a", None), "quota": (None, "429 quota exceeded"), "boom": (None, "boom"),
                   "empty": (None, "empty reply")}
    assert calls.value == 1 + 3 + 1 + 3


def test_columns_of_a_request_go_through_as_they_are(spark):
    rows = [("a", 2 ** 53 + 1, [(1, None)]), ("b", None, None)]
    df = spark.createDataFrame(rows, "request string, n long, items array<struct<x:int,y:long>>").coalesce(1)
    got = ba.call_model(df, lambda requests: ["ok"], pause=0)
    assert [(r.request, r.n, r["items"], r.reply) for r in got.collect()] == [(*r, "ok") for r in rows]
    assert got.filter("false").collect() == []


def test_unreadable_replies_and_resource_errors_are_tried_again(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(requests):
        calls.add(1)
        if requests[0] == "busy":
            raise RuntimeError("RESOURCE exhausted")
        return ["no object"]

    df = spark.createDataFrame([("a",), ("busy",)], "request string").coalesce(1)
    got = {r.request: (r.reply, r.call_error) for r in ba.call_model(
        df, model, pause=0, readable=ba.holds_object).collect()}
    assert got == {"a": ("no object", None), "busy": (None, "RESOURCE exhausted")}
    assert calls.value == 3 + 3
    assert ba.holds_object('x {"a": 1} y') and not ba.holds_object("[1]")
    assert ba.holds_pairs('{"12": "a",}') and not ba.holds_pairs('{"x": "a",}')


def test_stored_answers_are_asked_once_and_resumed(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(requests):
        calls.add(1)
        if requests[0] == "down" and calls is not None and not (tmp_path / "up").exists():
            raise ValueError("down")
        return ["ok " + requests[0]]

    store = str(tmp_path / "answers")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "down")], "id int, request string")
    first = ba.call_model(df, model, store=store)
    for _ in range(2):
        assert {(r.id, r.reply, r.call_error) for r in first.collect()} == {
            (1, "ok a", None), (2, "ok a", None), (3, None, "down")}
    assert calls.value == 2  # one call for each different request, over two actions
    (tmp_path / "up").touch()
    again = ba.call_model(df, model, store=store)
    assert {(r.id, r.reply, r.call_error) for r in again.collect()} == {
        (1, "ok a", None), (2, "ok a", None), (3, "ok down", None)}
    assert calls.value == 3


def test_entity_keywords_keep_what_is_there(spark):
    def model(requests):
        if "fail" in requests[0]:
            raise ValueError("boom")
        return ["{}" if "nothing" in requests[0] else '{"brand": "Acme", "product_name": "Gin"}']

    df = spark.createDataFrame([("fail", "kept"), ("nothing", "kept"), ("gin", "old"), ("fail", None)],
                               "title string, keyword string")
    got = sorted((r.title, r.keyword) for r in rv.entity_keywords(df, model, pause=0).collect())
    assert got == [("fail", ""), ("fail", "kept"), ("gin", "Acme Gin"), ("nothing", "kept")]
    bare = rv.entity_keywords(df.drop("keyword"), model, pause=0).collect()
    assert sorted(r.keyword for r in bare) == ["", "", "", "Acme Gin"]


def test_a_repeated_id_keeps_its_last_value(spark):
    df = spark.createDataFrame([('{"1": "a", "2": "b", "1": "c"}',)], "t string")
    assert df.select(rp.id_values(F.col("t")).alias("m")).first().m == {"2": "b", "1": "c"}


def test_ordinals_refuse_null_and_negative_ids(spark):
    for bad in (None, -1):
        df = spark.createDataFrame([(5,), (bad,)], "row_id long")
        with pytest.raises(Exception, match="neither null nor negative"):
            ba.with_ordinal(df).collect()
    ids = [(x * 0x9E3779B97F4A7C15) >> 1 & (1 << 63) - 1 for x in range(1, 300)]
    got = {r.row_id: r.ordinal for r in ba.with_ordinal(
        spark.createDataFrame([(i,) for i in ids], "row_id long")).collect()}
    assert got == {x: n for n, x in enumerate(sorted(ids))}


def _review(spark, reply):
    df = spark.createDataFrame([(i, f"t{i}", "b", f"c{i}") for i in (1, 2, 3)],
                               "row_id long, title string, brand string, category string")
    return rv.review_categories(df, lambda requests: [reply for _ in requests])


def test_review_replies(spark):
    out = _review(spark, "1|INCORRECT|Whisky|HIGH\n2|CORRECT\n10|x|y|z\n")
    got = {r.row_id: (r.suggested, r.is_correct, r.confidence, r.parse_error is None) for r in out.collect()}
    assert got == {1: ("Whisky", False, "high", True), 2: ("c2", True, "unknown", False),
                   3: ("c3", True, "unknown", True)}
    assert rv.review_report(out).first().asDict() == {
        "total_products": 3, "correct": 2, "incorrect": 1, "accuracy": 2 / 3, "high_confidence": 1,
        "medium_confidence": 0, "low_confidence": 0}
    assert [r.row_id for r in rv.wrong_categories(out).collect()] == [1]
    assert rv.review_report(out.filter("false")).first().accuracy == 0.0


def test_a_reply_is_cut_into_lines_once_a_batch(spark):
    df = spark.createDataFrame([(1, "t", "b", "c")], "row_id long, title string, brand string, category string")
    for read in (rv.review_categories, rv.dual_classify):
        plan = read(df, lambda requests: ["1|x" for _ in requests])._jdf.queryExecution().optimizedPlan()
        rows, batches = plan.toString().split("Generate", 1)
        assert "reply#" not in rows and "reply#" in batches


def test_failed_review_call_leaves_rows_correct(spark):
    df = spark.createDataFrame([(1, "t", None, "c")],
                               "row_id long, title string, brand string, category string")

    def model(requests):
        raise RuntimeError("down")

    row = rv.review_categories(df, model).first()
    assert (row.is_correct, row.confidence, row.suggested) == (True, "unknown", "c")


def test_backfills_keep_ids_in_their_batch(spark):
    df = spark.createDataFrame([(1, "a", None, "Other"), (2, "b", "nan", "Kept"), (3, "c", "Unbranded", "Other")],
                               "row_id long, title string, brand string, category string")
    cats = rv.backfill_categories(df, lambda r: ['x {"1": "A > B ", "2": "Z", "3": "Other"} y'] * len(r))
    assert {r.row_id: r.category for r in cats.collect()} == {1: "B", 2: "Kept", 3: "Other"}
    brands = rv.backfill_brands(df, lambda r: ['{"1": "Acme", "2": "", "9": "Q"}'] * len(r))
    assert {r.row_id: r.brand for r in brands.collect()} == {1: "Acme", 2: "nan", 3: "Unbranded"}


def test_reply_fields(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert one(rp.unfenced(F.lit('a ```json\n{"x": 1}\n``` b'))) == '{"x": 1}'
    assert one(rp.unfenced(F.lit("```json {x"))) == "{x"
    assert one(rp.unfenced(F.lit(" plain "))) == "plain"
    assert one(rp.braces(F.lit("none"))) is None
    assert one(rp.id_values(F.lit('{"1": "a", "2": 5'), loose=True)) == {"1": "a"}
    assert one(rp.id_values(F.lit('x "1": "a", "1" : " b " x'), loose=True)) == {"1": "b"}
    assert one(rp.id_values(F.lit("not json"))) is None
    assert one(rp.reply_keyword(F.lit("\n ' \"\n"))) is None
    assert one(rp.reply_keyword(F.lit('"Gin & Tonic!"\nx'))) == "gin and tonic"
    assert one(rp.entity_struct(F.lit('{"brand": "A", "vintage": 2016, "region": null}')))[:6] == (
        "A", "", "2016", "", "", "")
    assert tuple(one(rp.match_answer(F.lit('{"match": true}'), F.lit(None).cast("string")))) == (
        "Y", "No reason provided")
    assert one(rp.match_answer(F.lit("junk"), F.lit(None).cast("string"))).match == "N"
    long = F.lit("x" * 120 + '"')
    assert one(rp.prompt_field(long)) == "x" * 100
    assert one(rp.category_list(F.sequence(F.lit(1), F.lit(101)).cast("array<string>"))).startswith(
        "Choose one of 101 shelves, such as 1, 2") and one(rp.category_list(
            F.array(F.lit("a"), F.lit("b")))) == "Choose one of these shelves: a, b"


def test_entity_keywords_from_replies(spark):
    df = spark.createDataFrame([(1, "Dalmore 15 Year Old"), (2, "broken")], "row_id long, title string")
    out = rv.entity_keywords(df, lambda r: [
        '{"brand": "Dalmore", "age_statement": 15}' if "dalmore" in x else "sorry" for x in r])
    got = {r.row_id: (r.keyword, r.keyword_error) for r in out.collect()}
    assert got == {1: ("Dalmore 15", None), 2: ("", "No entities extracted for: broken")}


def test_additive_merge_touches_only_new_columns_and_the_keyword(spark):
    catalog = spark.createDataFrame([("a", "B", "old"), ("z", "C", "own")],
                                    "title string, brand string, keyword string")
    upload = spark.createDataFrame([("a", "no", "new", 5, 2), ("a", "no", "first", 7, 1)],
                                   "title string, brand string, keyword string, `Jan 2023` int, place int")
    got = me.additive_merge(catalog, upload, order="place")
    assert got.columns == ["title", "brand", "keyword", "Jan 2023"]
    assert {tuple(r) for r in got.collect()} == {("a", "B", "first", 7), ("z", "C", "own", None)}


def test_counters_treat_null_keywords_as_blank(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "")], "level3 string, keyword string")
    assert tuple(mt.catalog_stats(df).first()) == (3, 1, 1)


def test_answers_outlive_a_job_that_dies(spark, tmp_path):
    """The model ends the job half-way; the second call asks only what is left, the third nothing."""
    calls, store = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()

    def model(requests):
        (calls / f"{requests[0]}-{uuid.uuid4().hex}").touch()
        if requests[0] == "q17" and not (tmp_path / "up").exists():
            raise SystemExit("killed")
        return ["ok " + requests[0]]

    def asked():
        return Counter(p.name.rsplit("-", 1)[0] for p in calls.iterdir())

    def ask(text):
        return model([text])[0], None

    df = spark.createDataFrame([(f"q{i}",) for i in range(40)] + [("q1",), (None,)], "request string")
    with pytest.raises(Exception):
        answer_log.ask(df, store, ask, tasks=2, piece=3)
    kept = {r.request for r in answer_log.answers(spark, store).collect()}
    assert 0 < len(kept) < 40 and "q17" not in kept
    before = asked()
    (tmp_path / "up").touch()
    assert answer_log.ask(df, store, ask, tasks=3, piece=3) == 40 - len(kept)
    assert all(asked()[q] == before[q] for q in kept)
    assert answer_log.ask(df, store, ask, tasks=3, piece=3) == 0
    for _ in range(2):
        got = {r.request: (r.reply, r.error) for r in answer_log.answers(spark, store).collect()}
        assert got == {f"q{i}": (f"ok q{i}", None) for i in range(40)}
        answer_log.compact(spark, store)
    assert not list((tmp_path / "log" / "pieces").glob("*.parquet")) and len(
        list((tmp_path / "log" / "tables").iterdir())) == 1


def test_a_piece_is_not_asked_twice(spark, tmp_path):
    """A task that runs again finds its pieces; pieces with errors are asked again."""
    count = spark.sparkContext.accumulator(0)

    def ask(text):
        count.add(1)
        return (None, "no") if text == "bad" and not (tmp_path / "up").exists() else ("yes", None)

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "request string")
    store = str(tmp_path / "log")
    assert answer_log.ask(df, store, ask, tasks=1) == 3
    assert {(r.request, r.error) for r in answer_log.answers(spark, store).collect()} == {
        ("a", None), ("bad", "no"), ("b", None)}
    assert answer_log.ask(df, store, ask, tasks=1) == 1
    (tmp_path / "up").touch()
    assert answer_log.ask(df, store, ask, tasks=1) == 1 and count.value == 5
    assert {(r.reply, r.error) for r in answer_log.answers(spark, store).collect()} == {("yes", None)}
