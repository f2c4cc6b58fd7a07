"""Title text rules as column expressions.

Everything here maps a string (or array) column to a column, so a chain of rules is one projection
inside a scan stage: no shuffle and no Python worker.  Rules that read an intermediate value more
than once bind it with :func:`let`, because composing plain columns would repeat the whole
expression tree under every reference.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv

# Unicode classes and boundaries, "\n" as the only line end.
_U = "(?Ud)"
_UI = "(?iUd)"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def words_of(text: Column) -> Column:
    """Whitespace-separated words, none of them empty."""
    return F.filter(F.split(text, _U + r"\s+"), lambda w: w != "")


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


def squeeze(text: Column) -> Column:
    """Runs of whitespace become one space; none at either end."""
    return F.trim(F.regexp_replace(text, _U + r"\s+", " "))


def strip_space(text: Column) -> Column:
    """Remove any Unicode whitespace at both ends."""
    return F.regexp_replace(text, _U + r"^\s+|\s+\z", "")


def blank_patterns(text: Column, patterns) -> Column:
    """Replace each pattern with a space, in list order."""
    for pattern in patterns:
        text = F.regexp_replace(text, _UI + pattern, " ")
    return text


# --- keys and paths -----------------------------------------------------------------------------

def product_key(title: Column) -> Column:
    """Lower-case letters, digits and single spaces; a null title gives an empty key.

    Accented letters are deleted, not folded.
    """
    kept = F.regexp_replace(F.lower(title), _U + r"[^a-z0-9\s]", "")
    return F.coalesce(squeeze(kept), F.lit(""))


def path_parts(path: Column) -> Column:
    return F.transform(F.split(path, " > "), lambda p: strip_space(p))


def leaf_of(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def level1_of(path: Column) -> Column:
    return F.element_at(F.split(path, " > "), 1)


def level_of(path: Column, level: int, default: str = fv.NO_CATEGORY) -> Column:
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(level)), F.lit(default))


# --- accents ------------------------------------------------------------------------------------

def fold_accents(text: Column) -> Column:
    """Fold the fixed accent list; any other letter stays."""
    return F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), fv.ACCENTED, fv.UNACCENTED)


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str]:
    """Every character whose canonical decomposition leaves one ASCII character, and that one."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = [c for c in unicodedata.normalize("NFD", chr(code)) if ord(c) < 0x80]
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain[0])
    return "".join(source), "".join(target)


def ascii_fold(text: Column) -> Column:
    """Decompose and keep ASCII only, so letters without a decomposition vanish."""
    source, target = _decompositions()
    return F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7F]", "")


# --- pattern rules ------------------------------------------------------------------------------

def simplify_ages(text: Column) -> Column:
    for pattern, short in fv.AGE_PATTERNS:
        text = F.regexp_replace(text, _UI + pattern, short)
    return text


def strip_sizes(text: Column, patterns=fv.HYBRID_SIZE_PATTERNS) -> Column:
    return blank_patterns(text, patterns)


def strip_abv(text: Column, patterns=fv.HYBRID_ABV_PATTERNS) -> Column:
    return blank_patterns(text, patterns)


def strip_years(text: Column) -> Column:
    return F.regexp_replace(text, _U + fv.YEAR_PATTERN, " ")


def drop_quotes(text: Column) -> Column:
    return F.translate(text, "'`", "")


def strip_names(text: Column, merchant: Column | None = None,
                names=fv.HYBRID_RETAILER_NAMES) -> Column:
    """Lower-case and blank the merchant (anywhere) and the listed names (as whole words).

    Overlapping names go longest first, then alphabetically, so the result is defined.
    """
    text = F.lower(text)
    if merchant is not None:
        needle = F.trim(F.lower(merchant))
        text = F.when(F.coalesce(needle, F.lit("")) != "",
                      F.replace(text, needle, F.lit(" "))).otherwise(text)
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return F.regexp_replace(text, _UI + r"\b(?:" + "|".join(ordered) + r")\b", " ")


def clean_phrase_title(title: Column, patterns=fv.PHRASE_REMOVE_PATTERNS) -> Column:
    """Accents, ages, the ordered removals, quotes, whitespace, lower case: in that order."""
    return F.lower(squeeze(drop_quotes(
        blank_patterns(simplify_ages(fold_accents(title)), patterns))))


# --- word rules ---------------------------------------------------------------------------------

def drop_noise(text: Column, noise) -> Column:
    """Lower-cased words whose letters, digits and underscores are neither empty nor listed."""
    listed = literals(noise)
    bare = lambda w: F.regexp_replace(w, _U + r"[^\w]", "")
    return join_words(F.filter(words_of(F.lower(text)), lambda w: let(
        bare(w), lambda b: (b != "") & ~F.array_contains(listed, b))))


def distinct_words(words: Column) -> Column:
    """First occurrence of each word, compared without case.

    Sorting by (folded word, position) makes repeats neighbours, which keeps long texts at
    n log n.
    """
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct(
        F.lower(w).alias("k"), i.alias("i"), w.alias("w"))))
    firsts = let(keyed, lambda s: F.filter(s, lambda x, j: (j == 0) | (
        F.get(s, j - 1)["k"] != x["k"])))
    ordered = F.array_sort(F.transform(firsts, lambda x: F.struct(
        x["i"].alias("i"), x["w"].alias("w"))))
    return F.transform(ordered, lambda x: x["w"])


def deduplicate(text: Column) -> Column:
    return join_words(distinct_words(words_of(text)))


def singular(word: Column) -> Column:
    """Compare-form of a lower-cased word: ies -> y, es cut, s (not ss) cut."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (F.when(F.endswith(word, F.lit("ies")), F.concat(cut(3), F.lit("y")))
            .when(F.endswith(word, F.lit("es")), cut(2))
            .when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), cut(1))
            .otherwise(word))


def distinct_stems(words: Column) -> Column:
    """Drop a word when it or its singular was kept before, as a word or as a singular.

    What a kept word blocks depends on the words kept before it, hence a fold.  Exact repeats can
    never be kept twice, so they leave before the fold and it runs over distinct words only.
    """
    forms = F.transform(distinct_words(words), lambda w: let(F.lower(w), lambda k: F.struct(
        w.alias("w"), k.alias("k"), singular(k).alias("b"))))
    none = F.array().cast("array<string>")
    folded = F.aggregate(
        forms,
        F.struct(none.alias("seen"), none.alias("out")),
        lambda acc, x: F.when(
            F.array_contains(acc["seen"], x["b"]) | F.array_contains(acc["seen"], x["k"]), acc
        ).otherwise(F.struct(
            F.concat(acc["seen"], F.array(x["k"], x["b"])).alias("seen"),
            F.concat(acc["out"], F.array(x["w"])).alias("out"))),
        lambda acc: acc["out"])
    return folded


def deduplicate_stems(text: Column) -> Column:
    return join_words(distinct_stems(words_of(text)))


def first_type_word(text: Column, types=fv.HYBRID_TYPE_WORDS) -> Column:
    """A listed word occurring anywhere in the text: the longest, then the alphabetically first."""
    ordered = sorted(types, key=lambda t: (-len(t), t))
    return let(F.lower(text), lambda low: F.get(
        F.filter(literals(ordered), lambda t: F.contains(low, t)), F.lit(0)))


def brand_words(brand: Column, stop=fv.HYBRID_BRAND_STOP_WORDS, limit: int = 2) -> Column:
    """The first significant words of a brand."""
    plain = F.regexp_replace(drop_quotes(fold_accents(F.coalesce(brand, F.lit("")))),
                             _U + r"[^\w\s]", " ")
    kept = F.filter(words_of(plain), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(stop))
    return F.slice(kept, 1, limit)


def clean_brand(brand: Column) -> Column:
    return join_words(brand_words(brand))


HYBRID_NOISE = list(dict.fromkeys(fv.HYBRID_GIFT_WORDS + fv.HYBRID_MULTIPACK_WORDS
                                  + fv.HYBRID_PROMO_WORDS + fv.HYBRID_DESCRIPTOR_WORDS))
PHRASE_NOISE = list(dict.fromkeys(fv.PHRASE_PROMO_WORDS + fv.PHRASE_GIFT_WORDS
                                  + fv.PHRASE_MULTIPACK_WORDS + fv.PHRASE_RETAILER_WORDS
                                  + fv.PHRASE_DESCRIPTOR_WORDS))


def preprocess_title(title: Column, merchant: Column | None = None, noise=HYBRID_NOISE) -> Column:
    """The full clean-up ahead of the hybrid keyword; the order of the steps matters."""
    text = strip_names(fold_accents(F.coalesce(title, F.lit(""))), merchant)
    text = strip_years(strip_abv(strip_sizes(simplify_ages(text))))
    text = blank_patterns(drop_quotes(text), fv.HYBRID_MISC_PATTERNS)
    return F.lower(squeeze(deduplicate_stems(drop_noise(text, noise))))


def alnum_words(text: Column) -> Column:
    """ASCII letter/digit words; a word holding any other letter is dropped whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(_U + r"\b([a-zA-Z0-9]+)\b"), 1)


def candidate_phrases(text: Column, stop=fv.PHRASE_STOP_WORDS) -> Column:
    """Runs of words between stop words."""
    marked = F.array_join(F.transform(
        alnum_words(text), lambda w: F.when(w.isin(list(dict.fromkeys(stop))), "|").otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def without(words: Column, listed) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(list(listed)))


def brand_in_text(brand: Column, text: Column) -> Column:
    """Is the brand already in the text?  An empty brand always is."""
    plain = lambda c: words_of(F.regexp_replace(
        fold_accents(F.lower(c)), _U + r"[^a-z0-9\s]", ""))
    held = let(plain(text), lambda t: let(plain(brand), lambda b: F.when(
        F.size(b) == 1, F.array_contains(t, b[0])
    ).otherwise(F.arrays_overlap(F.filter(b, lambda w: F.length(w) >= 3), t))))
    return F.when(F.coalesce(brand, F.lit("")) == "", F.lit(True)).otherwise(held)


def title_case(text: Column) -> Column:
    """Capital after anything that is not a letter: ``12yr`` -> ``12Yr``."""
    pieces = F.split(F.lower(text), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def plain_keyword(text: Column) -> Column:
    """``&`` spelled out, then ASCII letters, digits and single spaces only."""
    return squeeze(F.regexp_replace(
        F.replace(text, F.lit("&"), F.lit("And")), r"[^A-Za-z0-9 ]", ""))


def cap_words(text: Column, limit: int) -> Column:
    return join_words(F.slice(words_of(text), 1, limit))


def normalize_title(title: Column, separators=fv.TITLE_SEPARATORS,
                    promo=fv.PROMO_PART_TERMS) -> Column:
    """Lower-case, drop promotional parts around separators, fold to ASCII, drop punctuation."""
    text = F.lower(F.coalesce(title, F.lit("")))
    clean_parts = lambda parts: F.filter(parts, lambda p: ~F.greatest(
        *[F.contains(p, F.lit(t)) for t in promo]))
    for separator in separators:
        text = let(F.split(text, _U + separator), lambda parts: F.when(
            F.size(parts) > 1, F.array_join(clean_parts(parts), " ")).otherwise(parts[0]))
    return squeeze(F.regexp_replace(ascii_fold(text), r"[^\w\s-]", ""))


def clean_keyword(keyword: Column, noise=fv.ENTITY_NOISE_WORDS,
                  limit: int = fv.ENTITY_MAX_WORDS) -> Column:
    """Final form of an entity keyword: bare ages, no noise, no repeats, capped, capitalised."""
    bare = F.regexp_replace(F.coalesce(keyword, F.lit("")), _UI + fv.ENTITY_AGE_PATTERN, "$1")
    kept = F.filter(words_of(F.lower(bare)), lambda w: ~w.isin(list(noise)) & (
        (F.length(w) > 1) | w.rlike(r"^[0-9]$")))
    capped = F.slice(F.array_distinct(kept), 1, limit)
    capital = lambda w: F.when(w.rlike("^[a-z]"), F.concat(
        F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)
    return join_words(F.transform(capped, capital))
