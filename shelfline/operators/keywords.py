"""Search keywords per product: phrase rules, hybrid rules, entity rules.

Each pipeline is a chain of projections over its input rows.  Only the word statistics of whole
corpora (:func:`word_scores`) shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import entities as en
from shelfline.functions import fixed_values as fv
from shelfline.functions import text as tx
from shelfline.functions.text import join_words, let, words_of


# --- phrase scores ------------------------------------------------------------------------------

def phrase_words(df: DataFrame, ids: list[str], text: str, stop=fv.PHRASE_STOP_WORDS) -> DataFrame:
    """One row per word occurrence: ids, phrase number, phrase length, word."""
    phrases = df.select(*ids, F.posexplode(tx.candidate_phrases(F.col(text), stop))
                        .alias("phrase_no", "phrase"))
    words = phrases.withColumn("words", F.split("phrase", " "))
    return words.select(*ids, "phrase_no", F.size("words").alias("n_words"),
                        F.explode("words").alias("word"))


def word_scores(df: DataFrame, ids: list[str], text: str,
                stop=fv.PHRASE_STOP_WORDS) -> DataFrame:
    """Frequency, degree and score of every word within its text.

    Words of long texts are counted by partial aggregation, so a text is never held as one row
    group and a very frequent word collapses before the shuffle.
    """
    counted = phrase_words(df, ids, text, stop).groupBy(*ids, "word").agg(
        F.count("*").alias("freq"), F.sum(F.col("n_words") - 1).alias("degree"))
    return counted.withColumn("score", (F.col("degree") + F.col("freq")) / F.col("freq"))


def _phrase_scores(phrases: Column) -> Column:
    """Score of each phrase of one title.

    While no word repeats, a phrase of n words scores n * n; only titles with repeats look words up.
    """
    def by_length() -> Column:
        return F.transform(phrases, lambda p: let(
            F.size(F.split(p, " ")).cast("double"), lambda n: n * n))

    def by_word() -> Column:
        seen = F.flatten(F.transform(phrases, lambda p: let(F.split(p, " "), lambda ws: F.transform(
            ws, lambda w: F.struct(w.alias("w"), (F.size(ws) - 1).alias("d"))))))
        score = lambda word, every: let(F.filter(every, lambda o: o["w"] == word), lambda same: (
            F.aggregate(same, F.lit(0), lambda acc, o: acc + o["d"]) + F.size(same)
        ).cast("double") / F.size(same))
        return let(seen, lambda every: F.transform(phrases, lambda p: F.aggregate(
            F.transform(F.split(p, " "), lambda w: score(w, every)), F.lit(0.0),
            lambda acc, x: acc + x)))

    words = F.flatten(F.transform(phrases, lambda p: F.split(p, " ")))
    return F.when(let(words, lambda ws: F.size(F.array_distinct(ws)) == F.size(ws)),
                  by_length()).otherwise(by_word())


def top_phrase(phrases: Column) -> Column:
    """The best-scored phrase; the first of equals."""
    ranked = let(_phrase_scores(phrases), lambda scores: F.transform(phrases, lambda p, i: F.struct(
        F.get(scores, i).alias("score"), (-i).alias("place"), p.alias("phrase"))))
    return F.array_max(ranked)["phrase"]


def phrase_keyword(df: DataFrame, title: str = "title", brand: str = "brand",
                   into: str = "keyword", max_words: int = fv.PHRASE_MAX_WORDS,
                   removal=tx.PHRASE_NOISE) -> DataFrame:
    """Keyword from the best-scored phrase of the title, led by the brand where it is missing."""
    brand_text = F.coalesce(F.col(brand), F.lit(""))
    staged = df.withColumn("_clean", join_words(F.array_distinct(words_of(
        tx.clean_phrase_title(F.coalesce(F.col(title), F.lit("")))))))
    staged = staged.withColumn("_phrases", tx.candidate_phrases(F.col("_clean")))
    staged = staged.withColumn("_words", F.when(
        F.size("_phrases") > 0, F.split(top_phrase(F.col("_phrases")), " ")))
    staged = staged.withColumn("_kept", tx.without(F.col("_words"), removal))
    picked = (F.when(F.col("_words").isNull(), words_of(F.col("_clean")))
              .when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_words")))
    staged = staged.withColumn("_picked", F.slice(picked, 1, max_words))

    lead = F.slice(words_of(brand_text), 1, 2)
    room = F.slice(F.col("_picked"), F.lit(1), F.greatest(F.lit(max_words) - F.size(lead), F.lit(0)))
    whole = F.when(tx.brand_in_text(brand_text, join_words(F.col("_picked"))), F.col("_picked")
                   ).otherwise(F.concat(lead, room))
    staged = staged.withColumn("_whole", whole)
    finished = tx.cap_words(tx.plain_keyword(tx.title_case(join_words(
        tx.distinct_words(F.col("_whole"))))), max_words)
    blank = tx.strip_space(F.coalesce(F.col(title), F.lit(""))) == ""
    return staged.withColumn("_keyword", F.when(blank, "").otherwise(finished)).select(
        *[c for c in df.columns if c != into], F.col("_keyword").alias(into))


# --- hybrid rule --------------------------------------------------------------------------------

def hybrid_keyword(df: DataFrame, title: str = "title", brand: str = "brand",
                   merchant: str | None = None, into: str = "keyword",
                   max_words: int = fv.PHRASE_MAX_WORDS, noise=tx.HYBRID_NOISE) -> DataFrame:
    """Brand, then distinguishing title words, then the product type."""
    staged = (df.withColumn("_brand", tx.brand_words(F.col(brand)))
              .withColumn("_clean", tx.preprocess_title(
                  F.col(title), F.col(merchant) if merchant else None, noise)))
    staged = staged.withColumn("_type", tx.first_type_word(F.col("_clean")))
    room = F.lit(max_words) - F.size("_brand")
    # Words already said by the brand or the type; bound once for all words of the title.
    said = F.concat(F.transform("_brand", lambda b: F.lower(b)), F.when(
        F.col("_type").isNotNull() & (room > 0), F.array("_type")).otherwise(
        F.array().cast("array<string>")))
    rest = let(said, lambda taken: F.filter(words_of(F.col("_clean")), lambda w: (
        (F.length(w) >= 3) & ~w.isin(fv.HYBRID_TITLE_STOP_WORDS)
        & ~F.array_contains(taken, w) & ~w.isin(noise))))
    slots = F.greatest(room - F.when(F.col("_type").isNotNull(), 1).otherwise(0), F.lit(0))
    staged = staged.withColumn("_parts", F.concat(
        F.col("_brand"), F.slice(rest, F.lit(1), slots)))
    parts = F.when(F.col("_type").isNotNull() & (F.size("_parts") < max_words),
                   F.concat(F.col("_parts"), F.array("_type"))).otherwise(F.col("_parts"))
    kept = F.slice(tx.distinct_stems(parts), 1, max_words)
    return staged.withColumn("_keyword", tx.title_case(join_words(kept))).select(
        *[c for c in df.columns if c != into], F.col("_keyword").alias(into))


# --- entity rule --------------------------------------------------------------------------------

def scored_candidates(df: DataFrame, ids: list[str], title: str = "title") -> DataFrame:
    """One row per candidate with its score."""
    staged = df.withColumn("_norm", tx.normalize_title(F.col(title))).withColumn(
        "_found", en.candidates())
    return staged.select(*ids, F.explode(en.scored_candidates(
        F.col("_found"), F.col("_norm"))).alias("_c")).select(
        *ids, F.col("_c.candidate").alias("candidate"), (-F.col("_c.rank")).alias("score"))


def entity_keyword(df: DataFrame, title: str = "title", into: str = "keyword",
                   error: str = "keyword_error") -> DataFrame:
    """The best candidate of each row, cleaned; or the reason there is none."""
    shown = F.substring(F.coalesce(F.col(title), F.lit("")), 1, 50)
    staged = df.withColumn("_norm", tx.normalize_title(F.col(title))).withColumn(
        "_found", en.candidates())
    staged = staged.withColumn("_best", F.array_min(
        en.scored_candidates(F.col("_found"), F.col("_norm"))))
    reason = (F.when(~en.has_entities(), F.concat(F.lit(fv.NO_ENTITIES), shown))
              .when(F.size("_found") == 0, F.concat(F.lit(fv.NO_CANDIDATES), shown)))
    word = F.when(reason.isNull(), tx.clean_keyword(F.col("_best.candidate"))).otherwise("")
    return staged.withColumn("_word", word).withColumn("_why", reason).select(
        *[c for c in df.columns if c not in (into, error)],
        F.col("_word").alias(into), F.col("_why").alias(error))
