"""Queries: text rules and keyword pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions import entities as en
from shelfline.functions import fixed_values as fv
from shelfline.functions import replies as rp
from shelfline.functions import text as tx
from shelfline.operators import keywords as kw
from shelfline.plans import views
from shelfline.plans.registry import (ENTITIES, PRODUCTS, aged, any_of, blanked, query, quoted,
                                      split_words, squeezed, unaccented)

# One product text rule: name, SQL over column `title`, column expression.
def _rule(name, sql, build, text="title"):
    @query(name, f"with {PRODUCTS} select row_id, {sql} as value from products")
    def _(spark, sf):
        return views.products(spark, sf).select("row_id", build(F.col(text)).alias("value"))


NAMES = sorted(fv.HYBRID_RETAILER_NAMES, key=lambda n: (-len(n), n))


def _noise_free(expr: str) -> str:
    return (f"array_to_string(list_filter({split_words(f'lower({expr})')}, lambda w: "
            rf"regexp_replace(w, '[^\w]', '', 'g') not in ('', {quoted(tx.HYBRID_NOISE)})), ' ')")


def _phrase_clean(expr: str) -> str:
    inner = blanked(aged(unaccented(expr)), fv.PHRASE_REMOVE_PATTERNS)
    return f"lower({squeezed(f'''replace(replace({inner}, chr(39), ''), '`', '')''')})"


def _firsts(words: str) -> str:
    """Order-keeping distinct of an already folded word list column."""
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"


_rule("age_simplify", aged("title"), tx.simplify_ages)
_rule("size_strip", blanked("title", fv.HYBRID_SIZE_PATTERNS), tx.strip_sizes)
_rule("abv_strip", blanked("title", fv.HYBRID_ABV_PATTERNS), tx.strip_abv)
_rule("vintage_strip", blanked("title", [fv.YEAR_PATTERN], "g"), tx.strip_years)
_rule("phrase_clean_title", _phrase_clean("title"), tx.clean_phrase_title)
_rule("noise_strip", _noise_free("title"), lambda c: tx.drop_noise(c, tx.HYBRID_NOISE))
_rule("plain_keyword", squeezed("regexp_replace(replace(title, '&', 'And'), '[^A-Za-z0-9 ]', '', 'g')"),
      tx.plain_keyword)
_rule("prompt_field",
      r"""substr(trim(translate(title || chr(10) || '"\', chr(34) || chr(10) || '\', '''  ')), 1, 100)""",
      lambda c: rp.prompt_field(F.concat(c, F.lit('\n"\\'))))
_rule("reply_keyword",
      "nullif(lower(" + squeezed("regexp_replace(replace(title, '&', 'And'), '[^A-Za-z0-9 ]', '', 'g')")
      + "), '')",
      lambda c: rp.reply_keyword(F.concat(F.lit('\n  \n"'), c, F.lit('"\nsecond line'))))
_rule("reply_fence", "trim(title)",
      lambda c: rp.unfenced(F.concat(F.lit("say:\n```json\n"), c, F.lit("\n```\nend"))))
_rule("reply_braces", "'{' || title || ' {}}'",
      lambda c: rp.braces(F.concat(F.lit("text {"), c, F.lit(" {}} tail"))))


@query("accent_fold", f"select doc_id, {unaccented('text')} as value from documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", tx.fold_accents(F.col("text")).alias("value"))


@query("ascii_fold", r"""select doc_id,
 regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') as value from documents""")
def _(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", tx.ascii_fold(F.col("text")).alias("value"))


@query("merchant_strip", rf"""with {PRODUCTS} select row_id, regexp_replace(
 case when coalesce(trim(lower(brand)), '') <> '' then replace(t, trim(lower(brand)), ' ') else t end,
 '\b(?:{'|'.join(NAMES)})\b', ' ', 'gi') as value
 from (select *, lower('Buy ' || title || ' Wines online ' || coalesce(brand, '')) as t
  from products)""")
def _(spark, sf):
    text = F.concat(F.lit("Buy "), "title", F.lit(" Wines online "), F.coalesce("brand", F.lit("")))
    return views.products(spark, sf).select(
        "row_id", tx.strip_names(text, F.col("brand")).alias("value"))


@query("dedup_words", rf"""with w as (select doc_id, {split_words('text')} as ws from documents),
l as (select *, list_transform(ws, lambda w: lower(w)) as ls from w)
select doc_id, array_to_string(list_filter(ws, lambda w, i: list_position(ls, ls[i]) = i), ' ')
 as value from l""")
def _(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", tx.deduplicate(F.col("text")).alias("value"))


STEM = """case when w like '%ies' then left(w, length(w) - 3) || 'y'
 when w like '%es' then left(w, length(w) - 2)
 when w like '%s' and w not like '%ss' then left(w, length(w) - 1) else w end"""


def _stem_steps(source: str, words: str, id_: str = "row_id") -> str:
    """Recursive CTE ``walk``: one step per word, carrying what is blocked and what is kept."""
    return f"""listed as (select {id_}, {words} as ws from {source}),
walk as (select {id_}, ws, 1 as i, []::varchar[] as seen, []::varchar[] as kept from listed
 union all
 select {id_}, ws, i + 1,
  case when list_contains(seen, lower(ws[i])) or list_contains(seen, b) then seen
   else seen || [lower(ws[i]), b] end,
  case when list_contains(seen, lower(ws[i])) or list_contains(seen, b) then kept
   else kept || [ws[i]] end
 from (select *, {STEM.replace('w', 'lw').replace('lwhen', 'when').replace('lwend', 'wend')} as b
  from (select *, lower(ws[i]) as lw from walk where i <= len(ws)))),
stemmed as (select {id_}, kept from walk where i = len(ws) + 1)"""


@query("dedup_stems", f"""with recursive {PRODUCTS}, {_stem_steps('products', split_words('title || $$ anvils bolts bolt $$ || title'))}
 select row_id, array_to_string(kept, ' ') as value from stemmed""")
def _(spark, sf):
    text = F.concat("title", F.lit(" anvils bolts bolt "), "title")
    return views.products(spark, sf).select(
        "row_id", tx.deduplicate_stems(text).alias("value"))


TYPES = sorted(fv.HYBRID_TYPE_WORDS, key=lambda t: (-len(t), t))


@query("type_word", f"""with {PRODUCTS} select row_id,
 list_filter([{quoted(TYPES)}], lambda k: contains(lower(title), k))[1] as value from products""")
def _(spark, sf):
    return views.products(spark, sf).select(
        "row_id", tx.first_type_word(F.col("title")).alias("value"))


def _brand_words(expr: str) -> str:
    plain = (rf"regexp_replace(replace(replace({unaccented(f'''coalesce({expr}, '')''')}, chr(39), ''), "
             rf"'`', ''), '[^\w\s]', ' ', 'g')")
    return (f"list_filter({split_words(plain)}, lambda w: length(w) > 2 and lower(w) not in "
            f"({quoted(fv.HYBRID_BRAND_STOP_WORDS)}))[1:2]")


@query("clean_brand", f"""with {PRODUCTS} select row_id,
 array_to_string({_brand_words("'The ' || brand || ' of Château'")}, ' ') as value from products""")
def _(spark, sf):
    text = F.concat(F.lit("The "), "brand", F.lit(" of Château"))
    return views.products(spark, sf).select("row_id", tx.clean_brand(text).alias("value"))


def _preprocessed(expr: str) -> str:
    text = rf"regexp_replace(lower({unaccented(expr)}), '\b(?:{'|'.join(NAMES)})\b', ' ', 'gi')"
    text = blanked(blanked(aged(text), fv.HYBRID_SIZE_PATTERNS), fv.HYBRID_ABV_PATTERNS)
    text = blanked(text, [fv.YEAR_PATTERN], "g")
    text = f"replace(replace({text}, chr(39), ''), '`', '')"
    return blanked(text, fv.HYBRID_MISC_PATTERNS)


_PRE = f"""cleaned as (select *, {_preprocessed('title')} as t0 from products),
quiet as (select *, {_noise_free('t0')} as t1 from cleaned)"""


@query("preprocess_title", f"""with recursive {PRODUCTS}, {_PRE},
 {_stem_steps('quiet', split_words('t1'))}
 select row_id, lower(array_to_string(kept, ' ')) as value from stemmed""")
def _(spark, sf):
    return views.products(spark, sf).select(
        "row_id", tx.preprocess_title(F.col("title")).alias("value"))


def _tokens(expr: str) -> str:
    return rf"regexp_extract_all(lower({expr}), '\b([a-zA-Z0-9]+)\b', 1)"


def _phrases(expr: str) -> str:
    marked = (f"array_to_string(list_transform({_tokens(expr)}, lambda t: case when t in "
              f"({quoted(fv.PHRASE_STOP_WORDS)}) then '|' else t end), ' ')")
    return (f"list_filter(list_transform(string_split({marked}, '|'), lambda p: trim(p)), "
            "lambda p: p <> '')")


# The comparison engine's word boundary is ASCII, so these read the ASCII form of the texts.
@query("candidate_phrases", rf"""with folded as (select doc_id,
  regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') as t from documents)
 select doc_id, phrase, count(*) as times from (
  select doc_id, unnest({_phrases('t')}) as phrase from folded) group by all""")
def _(spark, sf):
    phrases = tx.candidate_phrases(tx.ascii_fold(F.col("text")))
    return (views.table(spark, sf, "documents").select("doc_id", F.explode(phrases).alias("phrase"))
            .groupBy("doc_id", "phrase").agg(F.count("*").alias("times")))


@query("rake_word_scores", rf"""with folded as (select doc_id,
  regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') as t from documents),
 ph as (select doc_id, unnest({_phrases('t')}) as phrase from folded),
 wd as (select doc_id, len(string_split(phrase, ' ')) as n, unnest(string_split(phrase, ' ')) as word
  from ph)
 select doc_id, word, count(*) as freq, cast(sum(n - 1) as bigint) as degree,
  (sum(n - 1) + count(*)) / cast(count(*) as double) as score from wd group by all""")
def _(spark, sf):
    texts = views.table(spark, sf, "documents").select(
        "doc_id", tx.ascii_fold(F.col("text")).alias("text"))
    return kw.word_scores(texts, ["doc_id"], "text")


@query("removal_filter", f"""with {PRODUCTS} select row_id, array_to_string(list_filter(
 {split_words('title')}, lambda w: lower(w) not in ({quoted(tx.PHRASE_NOISE)})), ' ') as value
 from products""")
def _(spark, sf):
    kept = tx.without(tx.words_of(F.col("title")), tx.PHRASE_NOISE)
    return views.products(spark, sf).select("row_id", tx.join_words(kept).alias("value"))


def _plain_words(expr: str) -> str:
    folded = unaccented(f"lower({expr})")
    return split_words(rf"regexp_replace({folded}, '[^a-z0-9\s]', '', 'g')")


def _brand_held(brand: str, text: str) -> str:
    b, t = _plain_words(brand), _plain_words(text)
    return f"""case when coalesce({brand}, '') = '' then true
 when len({b}) = 1 then list_contains({t}, ({b})[1])
 else list_has_any(list_filter({b}, lambda w: length(w) >= 3), {t}) end"""


@query("brand_in_text", f"""with {PRODUCTS} select row_id, {_brand_held('brand', 'title')} as value
 from products""")
def _(spark, sf):
    return views.products(spark, sf).select(
        "row_id", tx.brand_in_text(F.col("brand"), F.col("title")).alias("value"))


def _titled(expr: str) -> str:
    """Capital on every run of ASCII letters."""
    return (f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '[a-z]+|[^a-z]+'), "
            "lambda p: upper(left(p, 1)) || substr(p, 2)), '')")


@query("title_case", f"""with {PRODUCTS} select row_id,
 {_titled(unaccented("title || ' 12yr O''Neil ab-cd'"))} as value from products""")
def _(spark, sf):
    text = tx.fold_accents(F.concat("title", F.lit(" 12yr O'Neil ab-cd")))
    return views.products(spark, sf).select("row_id", tx.title_case(text).alias("value"))


# --- pipelines ----------------------------------------------------------------------------------

_RAKE = rf"""cleaned as (select row_id, coalesce(brand, '') as brand,
  {split_words(_phrase_clean('title'))} as ws from products),
deduped as (select *, array_to_string({_firsts('ws')}, ' ') as clean from cleaned),
phrased as (select *, {_phrases('clean')} as phrases from deduped),
ph as (select row_id, unnest(phrases) as phrase, unnest(range(1, len(phrases) + 1)) as place
  from phrased),
wd as (select row_id, place, len(string_split(phrase, ' ')) as n,
  unnest(string_split(phrase, ' ')) as word from ph),
stat as (select row_id, word, (sum(n - 1) + count(*)) / cast(count(*) as double) as score
  from wd group by all),
scored as (select wd.row_id, place, round(sum(score), 9) as score from wd join stat
  on wd.row_id = stat.row_id and wd.word = stat.word group by all),
top as (select row_id, place from (select *, row_number() over (
  partition by row_id order by score desc, place) as k from scored) where k = 1),
picked as (select p.row_id, p.brand, case when t.place is null then {split_words('clean')}
   else string_split(p.phrases[t.place], ' ') end as words, t.place is null as bare
  from phrased p left join top t on p.row_id = t.row_id),
kept as (select *, list_filter(words, lambda w: w not in ({quoted(tx.PHRASE_NOISE)})) as good
  from picked),
capped as (select *, (case when bare or len(good) = 0 then words else good end)[1:4] as four
  from kept),
led as (select *, case when {_brand_held('brand', "array_to_string(four, ' ')")} then four
   else {split_words('brand')}[1:2] || four[1:greatest(4 - len({split_words('brand')}[1:2]), 0)] end
   as whole from capped),
once as (select *, list_transform(whole, lambda w: lower(w)) as low from led),
single as (select row_id, array_to_string(list_filter(whole, lambda w, i:
   list_position(low, low[i]) = i), ' ') as k from once)"""


@query("rake_keyword", f"""with {PRODUCTS}, {_RAKE} select row_id, array_to_string({split_words(
    squeezed(f"regexp_replace(replace({_titled('k')}, '&', 'And'), '[^A-Za-z0-9 ]', '', 'g')"))}[1:4],
 ' ') as keyword from single""")
def rake_keyword(spark, sf):
    return kw.phrase_keyword(views.products(spark, sf)).select("row_id", "keyword")


_HYBRID = f"""{_PRE}, {_stem_steps('quiet', split_words('t1'))},
texts as (select q.row_id, {_brand_words('brand')} as bw, lower(array_to_string(s.kept, ' ')) as t
  from quiet q join stemmed s on q.row_id = s.row_id),
typed as (select *, list_filter([{quoted(TYPES)}], lambda k: contains(t, k))[1] as kind from texts),
rest as (select *, list_filter({split_words('t')}, lambda w: length(w) >= 3
   and w not in ({quoted(fv.HYBRID_TITLE_STOP_WORDS)}, {quoted(tx.HYBRID_NOISE)})
   and not list_contains(list_transform(bw, lambda b: lower(b)), w)
   and not coalesce(w = kind, false)) as others from typed),
built as (select row_id, bw || others[1:greatest(4 - len(bw) - case when kind is null then 0 else 1
   end, 0)] as parts, kind from rest),
ended as (select row_id, case when kind is not null and len(parts) < 4 then parts || [kind]
   else parts end as parts from built)"""


@query("hybrid_keyword", f"""with recursive {PRODUCTS}, {_HYBRID},
 {_stem_steps('ended', 'parts').replace('listed', 'listed2').replace('walk', 'walk2')
  .replace('stemmed', 'stemmed2')}
 select row_id, {_titled("array_to_string(kept[1:4], ' ')")} as keyword from stemmed2""")
def hybrid_keyword(spark, sf):
    return kw.hybrid_keyword(views.products(spark, sf)).select("row_id", "keyword")


# --- entity keywords ----------------------------------------------------------------------------

def _ascii(expr: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({expr})), '[^\x00-\x7F]', '', 'g'))"


def _normal_steps(source: str, column: str = "title") -> str:
    """CTEs n0..n4: one separator each; ``normal`` has the finished text."""
    steps = [f"n0 as (select *, lower(coalesce({column}, '')) as x from {source})"]
    for i, sep in enumerate(fv.TITLE_SEPARATORS):
        keep = (f"list_filter(string_split_regex(x, '{sep}'), lambda p: "
                f"not {any_of('p', fv.PROMO_PART_TERMS)})")
        steps.append(f"n{i + 1} as (select * exclude (x), case when len(string_split_regex(x, '{sep}')) "
                     f"> 1 then array_to_string({keep}, ' ') else x end as x from n{i})")
    text = r"regexp_replace(regexp_replace(strip_accents(x), '[^\x00-\x7F]', '', 'g'), '[^\w\s-]', '', 'g')"
    steps.append(f"normal as (select * exclude (x), {squeezed(text)} as norm "
                 f"from n{len(fv.TITLE_SEPARATORS)})")
    return ",\n".join(steps)


@query("normalize_title", f"""with {PRODUCTS}, {_normal_steps('products')}
 select row_id, norm as value from normal""")
def _(spark, sf):
    return views.products(spark, sf).select(
        "row_id", tx.normalize_title(F.col("title")).alias("value"))


def _cleaned_keyword(expr: str) -> str:
    bare = rf"lower(regexp_replace({expr}, '{fv.ENTITY_AGE_PATTERN}', '\1', 'gi'))"
    return f"""list_filter({split_words(bare)}, lambda w: w not in ({quoted(fv.ENTITY_NOISE_WORDS)})
 and (length(w) > 1 or regexp_matches(w, '^[0-9]$')))"""


def _capital(words: str) -> str:
    return (f"array_to_string(list_transform({words}, lambda w: case when regexp_matches(w, '^[a-z]') "
            "then upper(left(w, 1)) || substr(w, 2) else w end), ' ')")


@query("clean_keyword", f"""with {PRODUCTS}, w as (select row_id, {_cleaned_keyword('title')} as ws
 from products) select row_id, {_capital(_firsts('ws') + '[1:5]')} as value from w""")
def _(spark, sf):
    return views.products(spark, sf).select(
        "row_id", tx.clean_keyword(F.col("title")).alias("value"))


_TEMPLATES = [  # needed fields, fields that must be blank, parts
    ("p", "", "p"), ("pv", "", "pv"), ("bp", "", "bp"), ("bpv", "", "bpv"), ("bpk", "", "bpk"),
    ("p", "", ["p", "wine"]), ("ba", "", "ba"), ("bak", "", "bak"), ("bk", "a", "bk"),
    ("gv", "", "gv"), ("gvc", "", "cgv"), ("g", "", ["g", "majestic"]),
    ("rv", "", ["r", "v", "wine"]), ("rvc", "", "crv"), ("xbp", "", ["b", "p", "case"]),
    ("xp", "", ["p", "mixed case"]), ("xp", "", ["p", "6 bottle case"]),
    ("xp", "", ["p", "wine case"]), ("xbp", "", ["b", "p", "wine"])]
_LETTERS = dict(zip(["b", "p", "v", "a", "k", "r", "g", "x", "c"], fv.ENTITY_FIELDS))


def _template_sql() -> str:
    out = []
    for needed, blank, parts in _TEMPLATES:
        test = " and ".join([f"{n} <> ''" for n in needed] + [f"{n} = ''" for n in blank])
        text = " || ' ' || ".join(p if p in _LETTERS else f"'{p}'" for p in parts)
        out.append(f"select row_id, {_ascii(text)} as candidate from ef where {test}")
    return " union ".join(out)


_CANDIDATES = f"""ef as (select *, {', '.join(f"trim(coalesce({c}, '')) as {n}" for n, c in _LETTERS.items())}
  from entities),
templated as ({_template_sql()}),
cand as (select row_id, candidate from templated union select row_id, {_ascii('b')} from ef
  where b <> '' and row_id not in (select row_id from templated))"""

_SCORES = rf"""{_CANDIDATES}, {_normal_steps('entities')},
fold as (select row_id, norm, {', '.join(f"{_ascii(f'''coalesce({c}, '')''')} as {n}" for n, c in _LETTERS.items())}
  from normal),
pts as (select c.row_id, c.candidate,
  b in ({quoted(fv.ENTITY_RETAILER_BRANDS)}) as retail, f.* exclude (row_id)
  from cand c join fold f on c.row_id = f.row_id),
scored as (select row_id, candidate, cast(
  case when p <> '' and contains(candidate, p) then 5 else 0 end
  + case when v <> '' and contains(candidate, v) then 4 else 0 end
  + case when b <> '' and contains(candidate, b) then case when retail then -2 else 4 end else 0 end
  + case when b <> '' and a <> '' and candidate = b || ' ' || a then 8 else 0 end
  + case when b <> '' and k <> '' and a = '' and candidate = b || ' ' || k then 6 else 0 end
  + case when b <> '' and p <> '' and k <> '' and candidate = b || ' ' || p || ' ' || k then 6
     else 0 end
  + case when (contains(norm, 'case') or contains(x, 'case')) and contains(candidate, 'case') then 3
     else 0 end
  - 6 * len(list_filter(regexp_extract_all(b, '\d+') || case when a <> '' then [a] else [] end,
     lambda t: not contains(candidate, t)))
  - case when contains(candidate, 'year old') or contains(candidate, 'years old') then 5 else 0 end
  - case when b <> '' and not contains(candidate, b) and not retail
     and (c = '' or not contains(candidate, c)) then 5 else 0 end as bigint) as score from pts)"""


@query("keyword_candidates", f"with {ENTITIES}, {_CANDIDATES} select * from cand")
def _(spark, sf):
    return views.entities(spark, sf).select(
        "row_id", F.explode(en.candidates()).alias("candidate"))


@query("candidate_scores", f"with {ENTITIES}, {_SCORES} select * from scored")
def _(spark, sf):
    return kw.scored_candidates(views.entities(spark, sf), ["row_id"]).withColumn(
        "score", F.col("score").cast("bigint"))


@query("entity_keyword", f"""with {ENTITIES}, {_SCORES},
best as (select row_id, candidate from (select *, row_number() over (partition by row_id
  order by score desc, length(candidate), candidate) as k from scored) where k = 1),
words as (select e.row_id, e.title, b.candidate, {' || '.join(f"coalesce({c}, '')" for c in fv.ENTITY_FIELDS)}
   as every, {_cleaned_keyword("coalesce(b.candidate, '')")} as ws
  from entities e left join best b on e.row_id = b.row_id)
select row_id, {_capital(_firsts('ws') + '[1:5]')} as keyword,
 case when every = '' then '{fv.NO_ENTITIES}' || left(title, 50)
  when candidate is null then '{fv.NO_CANDIDATES}' || left(title, 50) end as keyword_error
 from words""")
def entity_keyword(spark, sf):
    return kw.entity_keyword(views.entities(spark, sf)).select(
        "row_id", "keyword", "keyword_error")
