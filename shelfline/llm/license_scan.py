"""License scans: an exact set-similarity join of text blocks with license notices.

A block is a sentence of a text: what stands between ends of sentences and empty lines.  A template is
a sentence of a license notice.  A block meets a template if it holds at least ``containment`` of the
template's distinct words, O = ceil(containment * size) of them.  Words are put into one global order,
rarest in the corpus first.  Then

* prefix: a block that shares O words with a template holds one of its first size - O + 1 words, so
  only those are indexed, and texts without any of them are not cut into blocks at all;
* length: a block with fewer than O template words is passed over;
* position: from a shared word at places i and j of the two orders, no more than
  1 + min(size - i - 1, block - j - 1) words can be shared, which has to reach O;

and the pairs that are left are counted exactly.  Of the templates that a block meets, those of
greatest containment label it.  Phrases that stand word by word (``PHRASES``) label a text as well.

Everything is DataFrame and SQL functions.  Templates and phrases are parameters; their words are the
only thing that is collected or sent to all tasks, and both are bounded by them.  Texts are read twice
(word frequencies, scan), and only texts with an indexed word are written and cut into blocks.

Defined results: a null text is an empty text, without words, labels and places, score 0.  Keys may be
null or repeated; equal rows give equal rows.  Columns other than key and text are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, table, whole
from shelfline.llm.registry import query
from shelfline.session import broadcast_within

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
BLOCK_END = r"[.!?;:]\s+|\n[\x20\t\r]*\n"
CONTAINMENT = 0.9
# Phrases that label a text wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2",
           "cc by nc": "cc-by-nc"}
# Sentences of well-known notices, by label.
TEMPLATES = {
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction"],
    "apache-2": ["licensed under the apache license version 2 0",
                 "you may not use this file except in compliance with the license"],
    "gpl-2": ["licensed under the gnu general public license version 2"],
    "gpl-3": ["licensed under the gnu general public license version 3"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license"],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "agpl-3": ["under the terms of the gnu affero general public license"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0",
              "licensed under the mozilla public license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted"],
    "cc-by-nc": ["licensed under cc by nc 4 0",
                 "licensed under a creative commons attribution noncommercial 4 0 international "
                 "license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4 0 international "
                 "license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, CAPITALS, SMALL)


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def ranked(df: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """The place of each template word in the global order: rarest first, ties alphabetically."""
    held = df.select(F.explode(F.array_intersect(words_in(lowered(whole(text))), strings(
        vocabulary))).alias("word"))
    count = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}


def spaced(words: Column) -> Column:
    """Every word between blanks of its own, so that phrases may touch."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def places(phrase: str, line: Column, n_words: Column) -> Column:
    """(n, first, last) of a phrase in a spaced line: places and the smallest and largest start."""
    own = phrase.split()
    mark = "".join(f" {w} " for w in own)

    def blanks(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    before = F.substr(line, F.lit(1), F.locate(mark, line) - 1)
    back = F.reverse(line)
    after = F.substr(back, F.lit(1), F.locate(mark[::-1], back) - 1)
    return F.when(F.contains(line, F.lit(mark)), F.struct(
        F.regexp_count(line, F.lit(f"(?={re.escape(mark)})")).cast("long").alias("n"),
        (blanks(before) / 2).cast("long").alias("first"),
        (n_words - (blanks(after) / 2).cast("long") - len(own)).cast("long").alias("last")))


class Templates:
    """Templates as sorted arrays of word ranks, and the index of their prefixes."""

    def __init__(self, templates: dict[str, list[str]], rank: dict[str, int], containment: float):
        self.rank, self.rows = rank, []
        for label, sentences in templates.items():
            for sentence in sentences:
                own = sorted({rank[w] for w in sentence.split()})
                # Guards against 0.9 * 10 being a hair above 9.
                least = max(1, math.ceil(containment * len(own) - 1e-9))
                self.rows.append((len(self.rows), label, own, least))
        self.prefix = sorted({r for _, _, own, least in self.rows for r in own[:len(own) - least + 1]})
        names = {r: w for w, r in rank.items()}
        self.prefix_words = [names[r] for r in self.prefix]

    def index(self, spark: SparkSession) -> DataFrame:
        """(rank, place, template, label, ranks, least) for every word of every prefix."""
        made = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"),
                         F.array(*map(F.lit, own)).alias("ranks"), F.lit(least).alias("least"))
                for n, label, own, least in self.rows]
        kind = "array<struct<template:int,label:string,ranks:array<int>,least:int>>"
        rows = spark.range(1).select(F.explode(F.array(*made).cast(kind)).alias("t")).select("t.*")
        return rows.select("*", F.posexplode(F.slice(
            "ranks", F.lit(1), F.size("ranks") - F.col("least") + 1)).alias("place", "rank"))


def scanned(df: DataFrame, key: str, text: str, phrases: dict[str, str], indexed: list[str]
            ) -> DataFrame:
    """(key, hash, n_words, base, body): words, phrases, and the text where an indexed word stands."""
    wanted = sorted({w for p in phrases for w in p.split()} | set(indexed))
    rows = df.select(F.col(f"`{key}`").alias("key"), lowered(whole(text)).alias("body"))
    rows = rows.withColumn("words", words_in(F.col("body")))
    rows = rows.withColumn("held", F.array_intersect("words", strings(wanted))).withColumn(
        "n_words", F.size("words").cast("long"))
    # A phrase is looked for only where all its words stand somewhere.
    may = [F.size(F.array_intersect("held", strings(p.split()))) == len(set(p.split()))
           for p in phrases]
    some = F.lit(False)
    for m in may:
        some = some | m
    rows = rows.withColumn("line", F.when(some, spaced(F.col("words"))))
    found = [F.struct(F.lit(label).alias("label"), F.when(m, places(
        p, F.col("line"), F.col("n_words"))).alias("at"))
        for (p, label), m in zip(phrases.items(), may)]
    kind = "array<struct<label:string,at:struct<n:bigint,first:bigint,last:bigint>>>"
    return rows.select(
        "key", F.xxhash64("body").alias("hash"), "n_words",
        F.filter(F.array(*found).cast(kind), lambda x: x["at"].isNotNull()).alias("base"),
        F.when(F.arrays_overlap("held", strings(indexed)), F.col("body")).alias("body"))


def blocks(rows: DataFrame, rank: dict[str, int]) -> DataFrame:
    """(key, hash, block, ranks) of the blocks of rows with a body: their template words in order."""
    pairs = [x for w, r in rank.items() for x in (F.lit(w), F.lit(r))]
    cut = rows.where("body is not null").select("key", "hash", F.posexplode(F.split(
        "body", BLOCK_END, -1)).alias("block", "sentence"))
    held = cut.withColumn("held", F.array_intersect(words_in(F.col("sentence")), strings(list(rank))))
    return held.where(F.size("held") > 0).select("key", "hash", "block", F.array_sort(F.transform(
        "held", lambda w: F.element_at(F.create_map(*pairs), w))).alias("ranks"))


def meeting(cut: DataFrame, index: DataFrame) -> DataFrame:
    """(key, hash, block, label, containment): every block and template that meet, exactly.

    The index is broadcast after its size is checked; a larger one is joined by a shuffle on ranks.
    """
    laid = cut.select("key", "hash", "block", F.col("ranks").alias("own"), F.posexplode(
        "ranks").alias("at", "rank"))
    size, held = F.size("ranks"), F.size("own")
    near = laid.join(broadcast_within(index), "rank").where(
        (held >= F.col("least")) & (1 + F.least(size - F.col("place") - 1, held - F.col("at") - 1)
                                    >= F.col("least")))
    shared = F.size(F.array_intersect("own", "ranks"))
    # A pair that meets at several prefix words is one row after the first group.
    return near.withColumn("shared", shared).where(F.col("shared") >= F.col("least")).groupBy(
        "key", "hash", "block", "template").agg(
        F.first("label").alias("label"), F.max(F.col("shared") / size).alias("containment"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text",
         templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None,
         containment: float = CONTAINMENT) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, found_labels, score) of every row.

    ``base_labels`` and ``found_labels`` are sorted arrays, of the phrases and of the templates.  The
    score is 1 where a phrase stands, otherwise the greatest containment found, or 0.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    vocabulary = sorted({w for own in templates.values() for s in own for w in s.split()})
    held = Templates(templates, ranked(df, text, vocabulary), containment)
    scratch = Scratch(df.sparkSession, "licenses")
    rows = scratch.keep(scanned(df, key, text, phrases, held.prefix_words))
    met = meeting(blocks(rows, held.rank), held.index(df.sparkSession))
    best = met.groupBy("key", "hash", "block").agg(F.max(F.struct(
        "containment")).alias("best"), F.collect_set(F.struct("label", "containment")).alias("all"))
    marks = best.select("key", "hash", "best.containment", F.transform(F.filter(
        "all", lambda x: x["containment"] == F.col("best.containment")),
        lambda x: x["label"]).alias("labels"))
    # Labels are as many as the templates; a row per label keeps what a text gathers bounded.
    marks = marks.select(F.col("key").alias("k"), F.col("hash").alias("h"), "containment",
                         F.explode("labels").alias("label")).groupBy("k", "h").agg(
        F.sort_array(F.collect_set("label")).alias("found"), F.max("containment").alias("most"))
    joined = rows.select("key", "hash", "n_words", "base").join(marks, F.col("key").eqNullSafe(
        F.col("k")) & (F.col("hash") == F.col("h")), "left")
    base = F.col("base")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("key").alias(key), "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda a, x: a + x["at"]["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["at"]["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["at"]["last"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))).alias("base_labels"),
        F.coalesce("found", none).alias("found_labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


# Every block against every template, without an index.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') AS body
  FROM documents),
w AS (SELECT id, doc_id, regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM docs),
p AS (SELECT string_split(phrase, ' ') AS phrase, label FROM (VALUES {_values(list(PHRASES.items()))}
      ) AS v(phrase, label)),
stand AS (
  SELECT id, label, i - 1 AS start FROM (
    SELECT id, words, label, phrase, unnest(range(1, len(words) + 1)) AS i FROM w, p
    WHERE list_has_all(words, phrase))
  WHERE words[i:i + len(phrase) - 1] = phrase),
base AS (
  SELECT id, doc_id, any_value(len(words)) AS n_words, count(start) AS n_base,
    min(start) AS first_word, max(start) AS last_word,
    coalesce(list(DISTINCT label ORDER BY label) FILTER (label IS NOT NULL), []) AS labels
  FROM w LEFT JOIN stand USING (id) GROUP BY id, doc_id),
t AS (SELECT label, list_distinct(string_split(sentence, ' ')) AS own FROM (VALUES {_values(
    [(k, s) for k, v in TEMPLATES.items() for s in v])}) AS v(label, sentence)),
cut AS (
  SELECT id, n, list_distinct(regexp_extract_all(block, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS held
  FROM (SELECT id, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS n FROM (
    SELECT id, regexp_split_to_array(body, '[.!?;:][\x20\t\n\x0B\f\r]+|\n[\x20\t\r]*\n') AS blocks
    FROM docs))),
met AS (
  SELECT id, n, label, len(list_intersect(own, held)) / len(own) AS containment FROM cut, t
  WHERE len(held) >= {CONTAINMENT} * len(own)
    AND len(list_intersect(own, held)) >= {CONTAINMENT} * len(own)),
best AS (SELECT id, label, containment FROM met
         QUALIFY containment = max(containment) OVER (PARTITION BY id, n)),
found AS (SELECT id, list(DISTINCT label) AS labels, max(containment) AS most FROM best GROUP BY id)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(base.labels, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base.labels, coalesce(found.labels, [])))), ',')
    AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN found USING (id)
"""


@query("op13_license_scan", SQL)
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array_sort(F.array_union("base_labels", "found_labels"))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        "score")
