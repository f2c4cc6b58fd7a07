"""Model-backed steps: backfills, keywords, category review, keyword checks, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions import replies as rp
from shelfline.functions.text import leaf_of, let, normalize_title
from shelfline.operators.batches import (apply_answers, assemble, call_model, holds_object,
                                          holds_pairs)
from shelfline.operators.keywords import entity_keyword


def missing_brand(brand: Column) -> Column:
    return F.coalesce(F.lower(F.trim(brand)), F.lit("")).isin(fv.MISSING_BRANDS)


def category_column(columns: list[str]) -> str:
    """Level 3 if there is one, else the single legacy column."""
    for name in ("level3", "Product Category L3", "category", "Product Category"):
        if name in columns:
            return name
    raise ValueError("no category column: expected level3 or category")


def request_text(items: Column, head: str = "") -> Column:
    lines = F.array_join(F.transform(items, lambda i: i["item"]), "\n")
    return F.concat(F.lit(head), lines)


def batch_answers(batches: DataFrame, model, head: str = "", known_ids_only: bool = True,
                  loose: bool = False, **call) -> DataFrame:
    """Ask once per batch; one row per answered id: ``row_id, answer``."""
    call.setdefault("readable", holds_pairs if loose else holds_object)
    asked = call_model(batches.withColumn("request", request_text(F.col("items"), head)),
                       model, **call)
    return parse_answers(asked, known_ids_only, loose)


def parse_answers(asked: DataFrame, known_ids_only: bool = True, loose: bool = False) -> DataFrame:
    """``items, reply`` rows to answers; ids outside the batch are dropped on request."""
    text = rp.unfenced(F.col("reply")) if loose else rp.braces(F.col("reply"))
    found = asked.select("items", F.explode(rp.id_values(text, loose)).alias("id", "answer"))
    answered = found.withColumn("row_id", F.col("id").try_cast("bigint")).filter(
        "row_id is not null and answer is not null and answer != ''")
    if known_ids_only:
        answered = answered.filter(F.exists("items", lambda i: i["row_id"] == F.col("row_id")))
    return answered.select("row_id", "answer")


def backfill_categories(df: DataFrame, model, column: str | None = None, size: int =
                        fv.BACKFILL_BATCH, head: str = "", **call) -> DataFrame:
    """Ask for a category where it is "Other" and keep the leaf of any other answer."""
    column = column or category_column(df.columns)
    todo = df.filter(F.col(column) == fv.NO_CATEGORY)
    batches = assemble(todo, rp.product_item(F.col("row_id"), F.col("title"), F.col("brand")), size)
    answers = batch_answers(batches, model, head, **call).filter(
        F.col("answer") != fv.NO_CATEGORY).withColumn("answer", leaf_of(F.col("answer")))
    return apply_answers(df, answers, column)


def backfill_brands(df: DataFrame, model, column: str = "brand", size: int = fv.BACKFILL_BATCH,
                    head: str = "", **call) -> DataFrame:
    """Ask for a brand where there is none; "Unbranded" is an answer and is not asked again."""
    todo = df.filter(missing_brand(F.col(column)))
    batches = assemble(todo, rp.product_item(F.col("row_id"), F.col("title")), size)
    answers = batch_answers(batches, model, head, known_ids_only=False, **call)
    return apply_answers(df, answers, column)


def batch_keywords(df: DataFrame, model, column: str = "keyword", size: int = fv.KEYWORD_BATCH,
                   limit: int | None = None, head: str = "", **call) -> DataFrame:
    """Ask for keywords a batch at a time; refusals are no answer."""
    if column not in df.columns:
        df = df.withColumn(column, F.lit(""))
    item = rp.keyword_item(F.col("row_id"), F.col("title"), F.col("brand"))
    answers = batch_answers(assemble(df, item, size, limit=limit), model, head,
                            known_ids_only=False, loose=True, **call)
    return apply_answers(df, answers.filter(~F.lower("answer").isin(fv.REFUSED_KEYWORDS)), column)


def single_keywords(df: DataFrame, model, column: str = "keyword", **call) -> DataFrame:
    """Ask for one product at a time; the first line of the reply is the keyword."""
    if column not in df.columns:
        df = df.withColumn(column, F.lit(""))
    brand = F.substring(F.translate(F.coalesce("brand", F.lit("")), '"', "'"), 1, 50)
    title = F.substring(F.translate(F.coalesce("title", F.lit("")), '"', "'"), 1, 200)
    request = F.concat(F.lit("name= "), title, F.when(brand != "", F.concat(
        F.lit("\nmaker= "), brand)).otherwise(""))
    asked = call_model(df.withColumn("request", request), model, **call)
    return asked.withColumn(column, F.coalesce(rp.reply_keyword(F.col("reply")), column)).drop(
        "request", "reply")


def entity_keywords(df: DataFrame, model, **call) -> DataFrame:
    """Ask for entities of the normalised title, then pick the best candidate keyword."""
    asked = call_model(df.withColumn("request", normalize_title(F.col("title"))), model, **call)
    fields = rp.entity_struct(F.coalesce("reply", F.lit("")))
    # The row is packed away: its columns may have the names of entity fields.
    staged = asked.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                          "call_error", F.col("title"), fields.alias("_e")).select(
        "_row", "call_error", "title", "_e.*")
    picked = entity_keyword(staged)
    # Only a keyword that was found replaces the one there is.
    found = F.nullif(F.col("keyword"), F.lit(""))
    old = [F.col("_row.keyword")] if "keyword" in df.columns else []
    return picked.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != "keyword"],
                         F.coalesce(found, *old, F.lit("")).alias("keyword"),
                         F.coalesce("call_error", "keyword_error").alias("keyword_error"))


# --- category review ----------------------------------------------------------------------------

def _answered(asked: DataFrame) -> DataFrame:
    """``row_id, line``: every row of ``items, reply`` batches with the line that answers its number.

    A reply is cut into lines once for its batch, not once for each of its rows.
    """
    rows = let(rp.answer_lines(F.col("reply")), lambda lines: F.transform("items", lambda i, n: F.struct(
        i["row_id"].alias("row_id"), rp.answer_line(lines, n + 1).alias("line"))))
    return asked.select(F.explode(rows).alias("_n")).select("_n.*")


def review_batches(df: DataFrame, category: str, size: int = fv.KEYWORD_BATCH,
                   categories: Column | None = None) -> DataFrame:
    """Review requests; rows are numbered from 1 inside their batch.

    With ``categories``, an array of the names there are, a line that lists them goes first.
    """
    item = F.struct(F.col("title"), F.col("brand"), F.col(category).alias("category"))
    batches = assemble(df, item, size)
    lines = F.transform("items", lambda i, n: rp.review_item(
        n + 1, i["item"]["title"], i["item"]["brand"], i["item"]["category"]))
    text = F.array_join(lines, "\n\n")
    if categories is not None:
        text = F.concat(rp.category_list(categories), F.lit("\n\n"), text)
    return batches.withColumn("request", text)


def review_results(df: DataFrame, asked: DataFrame, category: str) -> DataFrame:
    """Verdict per row from ``items, reply`` batches; a failed call leaves rows as correct."""
    placed = _answered(asked).join(
        df.select("row_id", "title", F.col(category).alias("assigned")), "row_id")
    answer = rp.review_answer(F.col("line"), F.col("assigned"))
    return placed.withColumn("_a", answer).select(
        "row_id", "title", "assigned", "_a.suggested", "_a.is_correct", "_a.confidence",
        "_a.parse_error")


def review_categories(df: DataFrame, model, category: str = "category",
                      size: int = fv.KEYWORD_BATCH, categories: Column | None = None, **call) -> DataFrame:
    """Ask whether categories are right; ``categories`` are the names the model is told of."""
    return review_results(df, call_model(review_batches(df, category, size, categories), model, **call),
                          category)


def dual_results(df: DataFrame, asked: DataFrame, category: str) -> DataFrame:
    """Keyword and model category side by side; the model's answer is final."""
    mine = F.coalesce(F.col(category), F.lit(fv.NO_CATEGORY))
    placed = _answered(asked).join(
        df.select("row_id", "title", mine.alias("keyword_category")), "row_id")
    answer = rp.dual_answer(F.col("line"), F.col("keyword_category"))
    return placed.withColumn("_a", answer).select(
        "row_id", "title", "keyword_category", "_a.model_category", "_a.agree",
        "_a.final_category")


def dual_classify(df: DataFrame, model, category: str = "category", size: int = fv.KEYWORD_BATCH,
                  categories: Column | None = None, **call) -> DataFrame:
    """Ask for the category beside the one there is; ``categories`` are the names to choose from."""
    return dual_results(df, call_model(review_batches(df, category, size, categories), model, **call), category)


def review_report(results: DataFrame) -> DataFrame:
    """One row of counters; ``unknown`` confidence is in none of the three levels."""
    count = lambda test: F.coalesce(F.count_if(test), F.lit(0))
    total, right = F.count("*"), count(F.col("is_correct"))
    level = lambda name: count(F.col("confidence") == name)
    return results.agg(
        total.alias("total_products"), right.alias("correct"), (total - right).alias("incorrect"),
        F.when(total > 0, right / total).otherwise(F.lit(0.0)).alias("accuracy"),
        level("high").alias("high_confidence"), level("medium").alias("medium_confidence"),
        level("low").alias("low_confidence"))


def wrong_categories(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("is_correct"))


# --- keyword check ------------------------------------------------------------------------------

def verify_keywords(df: DataFrame, model, title: str = "title", keyword: str = "keyword",
                    **call) -> DataFrame:
    """Ask per row whether the keyword fits the title: ``match`` (Y/N) and ``reason``."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    request = F.concat(F.lit("name= "), text(title), F.lit("\nphrase= "), text(keyword))
    asked = call_model(df.withColumn("request", request), model, **call)
    answer = rp.match_answer(F.col("reply"), F.col("call_error"))
    return asked.withColumn("_a", answer).select(
        *[c for c in df.columns if c not in ("match", "reason")], "_a.match", "_a.reason")
