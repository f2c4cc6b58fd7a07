"""Request lines and reply parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import let, plain_keyword, strip_space


# --- requests -----------------------------------------------------------------------------------

def prompt_field(text: Column, chars: int = fv.PROMPT_FIELD_CHARS) -> Column:
    """One-line form of a field: double quotes to single, line ends and backslashes to spaces."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\"\n\r\\", "'   ")
    return F.substring(strip_space(flat), 1, chars)


def keyword_item(row_id: Column, title: Column, brand: Column) -> Column:
    """One JSON line per product; the brand only where it says something."""
    name = prompt_field(brand)
    known = ~F.lower(name).isin("", "nan", "none")
    shown = F.concat(prompt_field(title), F.when(known, F.concat(F.lit(" (by "), name, F.lit(")")))
                     .otherwise(""))
    return F.concat(F.lit('{"product": "'), shown, F.lit('", "id": "'), row_id.cast("string"),
                    F.lit('"}'))


def product_item(row_id: Column, title: Column, brand: Column | None = None) -> Column:
    lines = [F.concat(F.lit("item="), row_id.cast("string")),
             F.concat(F.lit("name="), F.coalesce(title, F.lit("")))]
    if brand is not None:
        lines.append(F.concat(F.lit("maker="), F.coalesce(brand, F.lit(""))))
    return F.concat_ws("\n", *lines)


def review_item(number: Column, title: Column, brand: Column, category: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("#"), number.cast("string"), F.lit(" "), title),
        F.concat(F.lit("made by "), F.coalesce(brand, F.lit("an unnamed maker"))),
        F.concat(F.lit("filed under "), category))


def category_list(categories: Column, limit: int = fv.CATEGORY_LIST_LIMIT,
                  shown_first: int = fv.CATEGORY_LIST_SHOWN) -> Column:
    """The category line of a request.

    A list of more than ``limit`` entries shows the first ``shown_first`` and its size.
    """
    shown = F.concat(F.lit("Choose one of "), F.size(categories).cast("string"),
                     F.lit(" shelves, such as "),
                     F.array_join(F.slice(categories, 1, shown_first), ", "),
                     F.lit(" or another"))
    return F.when(F.size(categories) > limit, shown).otherwise(
        F.concat(F.lit("Choose one of these shelves: "), F.array_join(categories, ", ")))


# --- replies ------------------------------------------------------------------------------------

def unfenced(reply: Column) -> Column:
    """The content of the first code fence, or the text itself."""
    inside = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = strip_space(reply)
    return F.when(~F.contains(bare, F.lit("```")), bare).when(
        bare.rlike(r"(?s)```(?:json)?\s*(.*?)\s*```"), strip_space(inside)).otherwise(
        strip_space(F.replace(F.replace(bare, F.lit("```json"), F.lit("")),
                              F.lit("```"), F.lit(""))))


def braces(reply: Column) -> Column:
    """From the first ``{`` to the last ``}``; null where there is none."""
    cut = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(cut != "", cut)


def id_values(text: Column, loose: bool = False) -> Column:
    """``map<id, value>`` from a JSON object; ``loose`` falls back to its "digits": "text" pairs.

    A repeated id keeps its last value either way.
    """
    read = F.map_entries(F.from_json(text, "map<string,string>"))
    strict = F.map_from_entries(let(read, lambda es: F.filter(es, lambda e, i: ~F.exists(
        F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))))
    if not loose:
        return strict
    pairs = F.regexp_extract_all(text, F.lit(r'("\d+"\s*:\s*"[^"]*")'), 1)
    key = lambda p: F.regexp_extract(p, r'^"(\d+)"', 1)
    value = lambda p: F.trim(F.regexp_extract(p, r':\s*"([^"]*)"$', 1))
    last = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(
        F.slice(ps, i + 2, F.size(ps)), lambda q: key(q) == key(p))))
    found = F.map_from_entries(F.transform(last, lambda p: F.struct(key(p), value(p))))
    return F.coalesce(strict, found)


def entity_struct(reply: Column) -> Column:
    """The nine entity fields of a reply as text; nulls and unreadable replies give blanks."""
    schema = ", ".join(f"{f} string" for f in fv.ENTITY_FIELDS)
    parsed = F.from_json(unfenced(reply), schema)
    return F.struct(*[F.coalesce(parsed[f], F.lit("")).alias(f) for f in fv.ENTITY_FIELDS])


def reply_keyword(reply: Column) -> Column:
    """First non-empty line, unquoted, plain and lower-cased; null where nothing is left."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: strip_space(x)),
                     lambda x: x != "")
    bare = F.regexp_replace(F.regexp_replace(F.get(lines, F.lit(0)), r'^"+|"+$', ""),
                            r"^'+|'+$", "")
    word = F.lower(plain_keyword(bare))
    return F.when(word != "", word)


def answer_lines(reply: Column) -> Column:
    """The lines of a reply, without space at their ends."""
    return F.transform(F.split(strip_space(reply), "\n"), lambda x: strip_space(x))


def answer_line(lines: Column, number: Column) -> Column:
    """The first line that answers ``number``; null where there is none."""
    lead = F.concat(number.cast("string"), F.lit("|"))
    return F.get(F.filter(lines, lambda x: F.startswith(x, lead)), F.lit(0))


def review_answer(line: Column, assigned: Column) -> Column:
    """``struct<suggested, is_correct, confidence, parse_error>`` of the line that answers a row.

    A missing or short line leaves the assigned category standing, with unknown confidence.
    """
    parts = F.split(line, r"\|")

    def read(p: Column) -> Column:
        whole = F.size(p) >= 4
        field = lambda i: strip_space(F.get(p, F.lit(i)))
        return F.struct(
            F.when(whole, field(2)).otherwise(assigned).alias("suggested"),
            F.when(whole, F.upper(field(1)) == "CORRECT").otherwise(True).alias("is_correct"),
            F.when(whole, F.lower(field(3))).otherwise("unknown").alias("confidence"),
            F.when(p.isNotNull() & ~whole, F.lit("short answer line")).alias("parse_error"))

    return let(parts, read)


def dual_answer(line: Column, keyword_category: Column) -> Column:
    """``struct<model_category, agree, final_category>``: the model's answer wins."""
    mine = F.coalesce(keyword_category, F.lit(fv.NO_CATEGORY))
    answer = F.coalesce(strip_space(F.get(F.split(line, r"\|"), F.lit(1))), mine)
    return let(answer, lambda a: F.struct(
        a.alias("model_category"), (a == mine).alias("agree"), a.alias("final_category")))


def match_answer(reply: Column, error: Column) -> Column:
    """``struct<match, reason>`` of a keyword check: TRUE/FALSE read as Y/N, failures as N."""
    parsed = F.from_json(reply, "match string, reason string")
    said = F.upper(F.coalesce(parsed["match"], F.lit("N")))
    flag = F.when(said == "TRUE", "Y").when(said == "FALSE", "N").otherwise(said)
    failed = error.isNotNull() | reply.isNull() | parsed.isNull()
    return F.struct(
        F.when(failed, "N").otherwise(flag).alias("match"),
        F.when(failed, F.concat(F.lit("Error: "), F.coalesce(error, F.lit("unreadable reply"))))
        .otherwise(F.coalesce(parsed["reason"], F.lit("No reason provided"))).alias("reason"))
