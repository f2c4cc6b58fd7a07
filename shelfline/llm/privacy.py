"""Personal data: patterns for four kinds, and terms that reveal who is meant.

Base spans are e-mail and IP addresses, card and phone numbers.  Their values are the protected
entities.  How strongly a term reveals an entity is estimated from the corpus: the pointwise mutual
information of "the text holds the term and the entity" over the information of the entity
itself, log(N n(t,e) / (n(t) n(e))) / log(N / n(e)), which is 1 where the term never stands without
the entity.  In texts that hold the entity, every occurrence of a term beyond the threshold is a
further span.  Terms are the words of the whole text outside base spans.  Counts are of all texts,
but texts of the same words are one context of the entity, so that copying does not make a term
revealing.  Small counts are smoothed: n(t,e) / n(e) is taken with PRIOR
more contexts of the entity, in which the term stands as often as anywhere.  And it takes evidence: rare
words stand beside every entity by chance, so a term counts only if fewer than ALPHA terms as rare as it
are expected in as many of the entity's contexts (``chance``).  There is no least number of contexts and
no least length of words; an entity of one context is revealed only where words that rare are so few
that an average text has none.

Everything is DataFrame and SQL functions.  Texts themselves are shuffled only where they hold an
entity that some term reveals, and in ``sanitised`` once.

The patterns are those of the contract with possessive repeats, and begin only where the leftmost
match can: results are the same, and the time is linear in the text.

Defined results: a null text is an empty text, without spans.  Keys may be null or repeated; equal
rows give equal rows.  With one text, or an entity in every text, no term is revealing.  ``sanitised``
keeps all columns, null texts included.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfline.functions.text import let
from shelfline.llm.common import Scratch, table, whole
from shelfline.llm.registry import query

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM_KIND = "term"
# A term is a word of letters and digits.
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+"
# Share of the entity's information that a term must give away; contexts without evidence that smooth
# small counts; how many such terms an entity may be expected to have by chance.
DISCLOSURE, PRIOR, ALPHA = 0.8, 2.0, 0.05
RUN = 512


def running_ends(sizes: Column) -> Column:
    """Running sums of a non-empty array, in runs so that long arrays are not copied per element."""
    runs = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a + v)

    sums = F.transform(runs, lambda r: total(F.slice(sizes, r * RUN + 1, RUN)))
    return F.flatten(F.transform(runs, lambda r: F.slice(F.aggregate(
        F.slice(sizes, r * RUN + 1, RUN), F.array(total(F.slice(sums, 1, r))),
        lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))), 2, RUN)))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Does a string of digits pass the Luhn check."""
    back = F.reverse(x)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), add) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    n = F.length(digits_of(x))
    return {"email": F.lit(True), "ip": x.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
            "card": n.between(16, 19) & F.when(n.between(16, 19), luhn(digits_of(x))),
            "phone": n.between(8, 15)}[kind]


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def with_spans(df: DataFrame, body: str = "body", out: str = "spans") -> DataFrame:
    """``df`` with the base spans of ``body`` by kind as listed, then start; ends are exclusive.

    Each step is a projection of its own, so that no pattern is evaluated twice.
    """
    t = F.col(body)
    found = {k: F.when(F.contains(t, F.lit(NEEDS[k])), F.regexp_extract_all(t, F.lit(p), F.lit(0)))
             if k in NEEDS else F.regexp_extract_all(t, F.lit(p), F.lit(0))
             for k, p in PATTERNS.items()}
    df = df.withColumns({f"_{k}": v for k, v in found.items()})
    # Gaps only where some match passes; positions come from all matches, passing or not.
    some = {k: F.coalesce(F.exists(F.col(f"_{k}"), partial(passes, k)), F.lit(False))
            for k in PATTERNS}
    df = df.withColumns({f"_{k}_gaps": F.when(some[k], F.split(t, p, -1))
                         for k, p in PATTERNS.items()})

    def sizes(k: str) -> Column:
        return F.transform(F.col(f"_{k}"), lambda x, i: F.length(x) + F.length(
            F.get(F.col(f"_{k}_gaps"), i)))

    df = df.withColumns({f"_{k}_sizes": F.when(F.col(f"_{k}_gaps").isNotNull(), sizes(k))
                         for k in PATTERNS})
    df = df.withColumns({f"_{k}_ends": F.when(F.col(f"_{k}_sizes").isNotNull(), running_ends(
        F.col(f"_{k}_sizes"))) for k in PATTERNS})

    def spans_of(k: str) -> Column:
        made = F.transform(F.col(f"_{k}"), lambda x, i: F.struct(
            F.lit(k).alias("kind"),
            (F.get(F.col(f"_{k}_ends"), i) - F.length(x)).cast("int").alias("start"),
            F.get(F.col(f"_{k}_ends"), i).cast("int").alias("end"), x.alias("value")))
        return F.when(F.col(f"_{k}_gaps").isNotNull(), F.filter(
            made, lambda s: passes(k, s["value"]))).otherwise(F.array().cast(f"array<{SPAN}>"))

    made = df.withColumns({f"_{k}_spans": spans_of(k) for k in PATTERNS})
    return made.withColumn(out, F.concat(*[F.col(f"_{k}_spans") for k in PATTERNS])).drop(
        *[f"_{k}{x}" for k in PATTERNS for x in ("", "_gaps", "_sizes", "_ends", "_spans")])


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def entities_of(spans: str) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["value"])))


def running_most(values: Column) -> Column:
    """Running maxima of a non-empty array, in runs as in ``running_ends``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
    tops = F.transform(runs, lambda r: F.array_max(F.slice(values, r * RUN + 1, RUN)))
    return let(tops, lambda most: F.flatten(F.transform(runs, lambda r: F.slice(F.aggregate(
        F.slice(values, r * RUN + 1, RUN), F.array(F.coalesce(F.array_max(F.slice(most, 1, r)), F.lit(0))),
        lambda a, v: F.concat(a, F.array(F.greatest(F.element_at(a, -1), v)))), 2, RUN))))


def replaced(body: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``body`` with ``by(span, code points)`` in place of what each span adds to those before it.

    A span that begins within earlier ones adds what is beyond them.  The text is taken apart into code
    points once, so that the time goes with the text and the spans, not with their product.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def pieces(chars: Column, marks: Column, ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.concat(F.array_join(F.slice(chars, at + 1, F.greatest(s["start"] - at, F.lit(0))), ""),
                            by(s, at))

        last = F.element_at(ends, -1)
        return F.concat(F.array_join(F.transform(marks, piece), ""), F.array_join(
            F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), ""))

    return F.when(F.size(spans) == 0, body).otherwise(let(F.split(body, ""), lambda chars: let(
        ordered, lambda marks: let(running_most(F.transform(marks, lambda m: m["end"])),
                                   lambda ends: pieces(chars, marks, ends)))))


def masked(body: Column, spans: Column) -> Column:
    """``body`` with blanks in place of its spans; all other characters keep their places."""
    return replaced(body, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(
        s["end"] - F.greatest(s["start"], at), F.lit(0))))


def revealing(bodies: DataFrame, rows: DataFrame, disclosure: float, prior: float, scratch: Scratch,
              alpha: float = ALPHA) -> DataFrame:
    """(entity, term, disclosure): terms that give the entity away, estimated from all texts.

    Besides enough disclosure it takes evidence: fewer than ``alpha`` terms like it by ``chance``.

    ``bodies`` has every ``body``, ``rows`` is the written table of spans.  Rows of equal (entity,
    context) count once, for the entity, the term and all texts alike; other copies count as they stand.
    """
    texts = rows.count()
    held = rows.where(F.size("spans") > 0).select(
        F.array_sort(F.array_distinct(words_of(masked(F.col("body"), F.col("spans"))))).alias("terms"),
        entities_of("spans").alias("entities"))
    each = held.withColumn("context", F.xxhash64("terms")).select(
        F.explode("entities").alias("entity"), "context", "terms")
    same = each.groupBy("entity", "context").agg(
        F.count("*").alias("n"), F.first("terms").alias("terms"))
    entity_texts = same.groupBy("entity").agg(
        F.count("*").alias("n_e"), F.sum(F.col("n") - 1).alias("copies_e"),
        F.avg(F.size("terms")).alias("words_e"))
    pairs = same.select("entity", "n", F.explode("terms").alias("term")).groupBy(
        "entity", "term").agg(F.count("*").alias("n_te"), F.sum(F.col("n") - 1).alias("copies_te"))
    term_texts = scratch.keep(bodies.select(F.explode(F.array_distinct(words_of(F.col("body")))).alias(
        "term")).groupBy("term").agg(F.count("*").alias("n_t")))
    scored = pairs.join(entity_texts, "entity").join(term_texts, "term")
    n_e, n_te = F.col("n_e"), F.col("n_te")
    n = F.greatest(texts - F.col("copies_e"), n_e).cast("double")
    # A word that a span cuts is another word in the whole text, so n_t may be the smaller one.
    apart = F.greatest(F.col("n_t") - F.col("copies_te"), n_te)
    own = F.log(n / n_e)
    scored = scored.withColumn("apart", apart).withColumn("share", F.col("apart") / n).withColumn("disclosure", F.when(own > 0, F.log(
        (n_te + prior * F.col("share")) / (n_e + prior) / F.col("share")) / own)).where(
        F.col("disclosure") >= disclosure)
    return scored.where(chance(term_texts, texts) <= alpha).select("entity", "term", "disclosure")


def chance(term_texts: DataFrame, texts: int) -> Column:
    """At most how many terms an entity is expected to have by chance that are as rare and as frequent
    in its contexts as a term is.

    A term of share p stands in n_te of n_e contexts with probability C(n_e, n_te) p^n_te at most.  Summed
    over all terms that are no more frequent, which have ``rare`` occurrences in an average text, that
    is C(n_e, n_te) p^(n_te - 1) rare.  Contexts longer than the average text hold more of everything.
    C is bounded by its entropy.  ``rare`` is summed by powers of two: 64 rows at most.
    """
    def power(count: str) -> Column:
        return F.floor(F.log2(F.col(count))).cast("int")

    held = term_texts.groupBy(power("n_t").alias("power")).agg(F.sum("n_t").alias("n")).collect()
    total = sum(r["n"] for r in held)
    levels = [sum(r["n"] for r in held if r["power"] <= k) / max(texts, 1) for k in range(64)]
    n_e, n_te = F.col("n_e"), F.col("n_te")
    times = F.greatest(F.col("words_e") * max(texts, 1) / max(total, 1), F.lit(1.0))

    def entropy(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    rare = F.get(F.array(*[F.lit(float(x)) for x in levels]), power("apart"))
    return F.exp(entropy(n_e) - entropy(n_te) - entropy(n_e - n_te)
                 + (n_te - 1) * F.log(F.least(times * F.col("share"), F.lit(1.0)))) * times * rare


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, hash, added): spans of revealing terms in the rows that hold the entity they reveal.

    Only those rows' words are laid out; a row's words are one window.
    """
    entities = rows.where(F.size("spans") > 0).select("key", "hash", F.explode(
        entities_of("spans")).alias("entity"))
    wanted = entities.distinct().join(terms, "entity").select("key", "hash", "term").distinct()
    touched = wanted.select(F.col("key").alias("k"), F.col("hash").alias("h")).distinct()
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))
    texts = rows.where(F.size("spans") > 0).select("key", "hash", masked(
        F.col("body"), F.col("spans")).alias("body")).join(touched, same).groupBy(
        "key", "hash").agg(F.first("body").alias("body"))
    laid = texts.select("key", "hash", F.regexp_extract_all("body", F.lit(TERM), F.lit(0)).alias(
        "words"), F.split("body", TERM, -1).alias("gaps")).select(
        "key", "hash", "gaps", F.posexplode("words").alias("i", "word")).select(
        "key", "hash", "i", "word", F.length(F.get("gaps", F.col("i"))).alias("gap"))
    order = Window.partitionBy("key", "hash").orderBy("i")
    placed = laid.withColumn("end", F.sum(F.col("gap") + F.length("word")).over(order))
    own = wanted.select(F.col("key").alias("k"), F.col("hash").alias("h"), "term")
    return placed.join(own, same & (F.lower("word") == F.col("term"))).groupBy("key", "hash").agg(
        F.array_sort(F.collect_list(F.struct(
            (F.col("end") - F.length("word")).cast("int").alias("start"),
            F.col("end").cast("int").alias("end"), F.col("word").alias("value")))).alias("x")).select(
        "key", "hash", F.transform("x", lambda s: F.struct(
            F.lit(TERM_KIND).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["value"].alias("value"))).alias("added"))


def searched(df: DataFrame, key: str, text: str, disclosure: float, prior: float
             ) -> tuple[DataFrame, DataFrame]:
    """((key, hash, spans) of every row, (key, hash, added) of rows with revealing terms).

    The spans are written once, with the text where there are any; a condition on them would
    otherwise be pushed below their making, and evaluate the patterns many times.
    """
    bodies = df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body"))
    scratch = Scratch(df.sparkSession, "privacy")
    rows = scratch.keep(with_spans(bodies).select(
        "key", F.xxhash64("body").alias("hash"), "spans",
        F.when(F.size("spans") > 0, F.col("body")).alias("body")))
    terms = revealing(bodies, rows, disclosure, prior, scratch)
    return rows, term_spans(rows, terms)


NO_SPANS = f"array<{SPAN}>"


def found(df: DataFrame, key: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE,
          prior: float = PRIOR) -> DataFrame:
    """(key, spans, added): base spans and spans of revealing terms of every row."""
    rows, added = searched(df, key, text, disclosure, prior)
    added = added.select(F.col("key").alias("k"), F.col("hash").alias("h"), "added")
    # Only keys, hashes and spans are shuffled here.
    return rows.select("key", "hash", "spans").join(
        added, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left").select(
        F.col("key").alias(key), "spans", F.coalesce("added", F.array().cast(NO_SPANS)).alias(
            "added"))


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def redacted(body: Column, spans: Column) -> Column:
    """``body`` with each span replaced by its kind in brackets; spans that overlap become one."""
    return replaced(body, spans, lambda s, at: F.when(s["start"] >= at, F.concat(
        F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))


def sanitised(df: DataFrame, key: str = "doc_id", text: str = "text",
              disclosure: float = DISCLOSURE, prior: float = PRIOR
              ) -> DataFrame:
    """``df`` with personal data in ``text`` generalised to its kind; all columns are kept."""
    names = df.columns
    rows, added = searched(df, key, text, disclosure, prior)
    base = rows.where(F.size("spans") > 0).groupBy("key", "hash").agg(
        F.first("spans").alias("spans"))
    more = added.select(F.col("key").alias("k"), F.col("hash").alias("h"), "added")
    marks = base.join(more, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")),
                      "left").select(
        F.col("key").alias("_k"), F.col("hash").alias("_h"), F.concat("spans", F.coalesce(
            "added", F.array().cast(NO_SPANS))).alias("_all"))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.col(f"`{key}`").alias("_key"), whole(text).alias("body")).withColumn(
        "_hash", F.xxhash64("body"))
    joined = packed.join(marks, F.col("_key").eqNullSafe(F.col("_k"))
                         & (F.col("_hash") == F.col("_h")), "left")
    new = F.when(F.size("_all") > 0, redacted(F.col("body"), F.col("_all"))).otherwise(
        F.col("row")[text].cast("string"))
    return joined.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


@query("op7_disclosure_privacy")
def op7_disclosure_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(
            f"n_{kind}")

    return found(table(spark, sf_dir, "documents")).select(
        "doc_id", *[counted(k) for k in PATTERNS], F.sha2(said(F.col("spans")), 256).alias(
            "base_sha256"), said(F.concat("spans", "added")).alias("spans"))
