"""Classifiers, archives, personal data and the pipeline."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm import all_queries, language, privacy, quality, toxicity, warc
from shelfline.llm.common import Scratch, remainder, table

EXTRA = "doc_id long, text string, lang string, key string, body string, hash string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, *["x"] * 4) for i, t, g in rows], EXTRA)


HARD = [(1001, None, None), (1002, "", "en"), (1003, "\n \t", None), (None, "no key", "en"),
        (1005, "7 8 9 !!", "en"), (1006, "w" * 50000, "en"), (1006, "w" * 50000, "en"),
        (1007, "word " * 20000, "de")]


def held_out(i, parts=4):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts == 2


@pytest.mark.parametrize("name,label,threshold,least", [
    ("op2_nbsvm_quality", "quality", 0.7, 0.93), ("op5_boosted_toxicity", "toxic", 0.3, 0.90)])
def test_held_out_accuracy(spark, name, label, threshold, least):
    sf_dir = "/root/testdata/sf0.01"
    got = all_queries.QUERIES[name](spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    truth = {r.doc_id: r[label] for r in table(spark, sf_dir, "labels").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
               and r.held_out == held_out(r.doc_id) for r in got)
    judged = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in judged]) >= least


def test_language_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = all_queries.QUERIES["op10_centroid_language"](spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) >= 0.97


def labelled(spark):
    r = random.Random(1)
    good = ["the quick brown fox jumps over a lazy dog near the river".split()[r.randrange(12)]
            for _ in range(4000)]
    rows, marks = [], []
    for i in range(120):
        bad = i % 3 == 0
        own = " ".join(good[i * 20:i * 20 + 20])
        rows.append((i, " ".join(w + "###" for w in own.split()) + (" idiot" if bad else "")
                     if bad else own, "en"))
        marks += [(i, 1 - bad, int(bad))] * (2 if i % 10 == 0 else 1)
    marks += [(None, 1, 0), (5, None, None), (99999, 1, 1)]
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifiers_on_hard_rows(spark):
    rows, marks = labelled(spark)
    docs = frame(spark, rows + HARD)
    train = remainder("doc_id", 4) != 2
    good = quality.fit(docs, marks, train)
    got = quality.scores(docs, good).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows + HARD)
    by = {r.doc_id: r.score for r in got}
    assert all((by[i] >= 0.5) == (i % 3 != 0) for i in range(120))
    assert by[1001] == by[1002] and 0 <= by[1001] <= 1
    kept = quality.accepted(docs, good, threshold=0.5)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        r.doc_id for r in got if r.score >= 0.5)
    bad = toxicity.fit(docs, marks, train)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, bad).collect()}
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(120))
    assert got[1001] == got[1002] and 0 <= got[1001] <= 1
    # Nothing to learn from, or one class only.
    none = marks.where("doc_id < 0")
    assert quality.scores(docs, quality.fit(docs, none, train)).first().score == 0.5
    assert toxicity.scores(docs, toxicity.fit(docs, none, train)).first().score == 0.0
    ones = marks.where("quality = 1 and toxic = 0")
    assert quality.scores(docs, quality.fit(docs, ones, train)).first().score == 1.0
    assert toxicity.scores(docs, toxicity.fit(docs, ones, train)).first().score == 0.0
    empty = docs.limit(0)
    assert quality.scores(empty, good).count() == 0 == toxicity.scores(empty, bad).count()
    assert quality.accepted(empty, good).count() == 0


def test_dual_descent_solves_the_dual():
    r = np.random.default_rng(2)
    rows = [np.flatnonzero(r.random(30) < 0.4).astype(np.int32) for _ in range(60)]
    labels = np.array([int(0 in x or (1 in x and 2 in x)) for x in rows])
    model = quality.Model(rows, labels, {0: 10, 1: 10})
    margins = np.array([model.margin(x) for x in rows])
    assert np.mean((margins > 0) == (labels == 1)) > 0.9


def test_isotonic_pools_violators():
    knots, shares = toxicity.isotonic(np.array([1., 2., 3., 4., 4.]), np.array([0., 1., 0., 1., 0.]),
                                      np.ones(5))
    assert (np.diff(shares) >= 0).all() and shares[0] == 0
    assert np.interp(2.5, knots, shares) == 0.5


def test_languages_on_hard_rows(spark):
    r = random.Random(3)
    pools = {"en": "the and of thing would there", "de": "der und ein nicht schön über"}
    rows = [(i, " ".join(r.choices(pools[g].split(), k=12)), g)
            for i, g in enumerate(["en", "de"] * 40)]
    docs = frame(spark, rows + HARD)
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    got = language.predictions(docs, model).collect()
    assert len(got) == len(rows) + len(HARD)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == g for i, _, g in rows)
    for i in (1001, 1002, 1003, 1005):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(x.lang_pred in ("en", "de", "und") and 0 <= x.score <= 1 for x in got)
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {x.lang_pred for x in language.predictions(docs, nothing).collect()} == {"und"}


# --- archives -------------------------------------------------------------------------------------

def test_archives_round_trip(spark):
    big = "é<p>" * 90000
    rows = [(1, "http://a/ü x", big), (2, None, big), (3, "u", ""), (4, "u", None), (5, "\r\nWARC/1.1", "q"),
            (None, "u", "only"), (None, "u", "q"), (7, "u", "same"), (7, "u", "same"), (6, "u", "same")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                  "page_id long, url string, html string, key string, sha string")
    manifest = warc.archive(pages, Scratch(spark, "warc-test").root, roll=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    chunks = warc.read_chunks(manifest, chunk=10000).collect()
    smallest = {}
    for i, _, h in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        first = smallest.get(h or "")
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
             "response" if first is None or first == i else "revisit",
             None if first is None or first == i else first] += 1
    got = Counter((None if c.key is None else int(c.key), c.bytes, c.digest, c.record_type,
                   None if c.refers_to is None else int(c.refers_to)) for c in chunks if c.last)
    assert got == want
    parts = sorted((c.chunk, bytes(c.data)) for c in chunks if c.key == "1")
    assert b"".join(p for _, p in parts) == big.encode() and max(len(p) for _, p in parts) == 10000
    running = hashlib.sha1()
    for n, p in parts:
        running.update(p)
        c = next(x for x in chunks if x.key == "1" and x.chunk == n)
        assert c.digest == base64.b32encode(running.digest()).decode()
    empty = warc.archive(pages.limit(0), Scratch(spark, "warc-test").root)
    assert warc.read_chunks(empty).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 9),
                                   (4, "u", "b" * 9)], "page_id long, url string, html string")
    rows = warc.read_chunks(warc.archive(pages, Scratch(spark, "warc-test").root, least=5)).collect()
    assert sorted((r.key, r.record_type) for r in rows) == [
        ("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_cut_off_archive_is_an_error(spark, tmp_path):
    writer = warc.Writer(tmp_path.as_uri(), "x", warc.ROLL)
    writer.record(1, "u", memoryview(b"abc" * 1000), 3000, hashlib.sha1(b"abc" * 1000).hexdigest(), 1)
    writer.close()
    data = (tmp_path / "x-0000.warc.gz").read_bytes()
    import io
    assert len(list(warc.chunks_of(io.BytesIO(data), 500, True))) == 6
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(data[:-30]), 500, True))


# --- personal data --------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items()
            for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_base_spans_are_those_of_the_patterns(spark):
    r = random.Random(5)
    pool = list("a1_.@-+ ()é😀%") + ["1.2.3.4", "4539148803436467", "+1 (23) 4567 89", "a@b.c",
                                     "256.1.1.1", "00001.2.3.04", " 4111 1111-1111 1111", "\n"]
    rows = [(2000 + i, "".join(r.choices(pool, k=r.randint(0, 30))), None) for i in range(1500)]
    rows += HARD + [(9001, "1" * 30000, None), (9002, "1.2.3.4 " * 3000, None),
                    (9003, "a" * 60000 + "@", None), (9005, "+1" + "(" * 20000, None)]
    got = privacy.found(frame(spark, rows)).collect()
    assert Counter((x.doc_id, tuple((s.kind, s.start, s.end) for s in x.spans)) for x in got
                   ) == Counter((i, tuple(plain_spans(t))) for i, t, _ in rows)
    texts = {i: t for i, t, _ in rows}
    assert all(texts[x.doc_id][s.start:s.end] == s.value for x in got for s in x.spans)


def test_revealing_terms(spark):
    filler = "lorem ipsum dolor amet sed tempor magna aliqua enim minim".split()
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(filler, k=6)) + " Zorbatron wrote to jane@corp.example about "
             + " ".join(r.choices(filler, k=6)), None) for i in range(8)]
    rows += [(100 + i, " ".join(r.choices(filler, k=15)) + " wrote to us about that", None)
             for i in range(80)]
    # A copied text makes none of its words revealing.
    rows += [(300 + i, "uniquely strange words stand beside bob@corp.example here", None)
             for i in range(9)]
    got = {x.doc_id: x for x in privacy.found(frame(spark, rows)).collect()}
    for i, text, _ in rows:
        want = [text.index("Zorbatron")] if i < 8 else []
        assert [s.start for s in got[i].added] == want
        assert all(s.kind == "term" for s in got[i].added)
    clean = privacy.sanitised(frame(spark, rows + [(900, None, None)]))
    assert clean.columns == [c.split()[0] for c in EXTRA.split(", ")]
    by = {x.doc_id: x.text for x in clean.collect()}
    assert "[TERM] wrote to [EMAIL] about" in by[0] and by[300].endswith("beside [EMAIL] here")
    assert by[900] is None and by[100] == dict((i, t) for i, t, _ in rows)[100]


def test_rare_entities_have_revealing_terms(spark):
    r = random.Random(9)
    filler = [f"common{chr(97 + i)}" for i in range(20)]

    def text(middle):
        return f"{' '.join(r.choices(filler, k=9))} {middle} {' '.join(r.choices(filler, k=9))}"

    rows = [(1, text("Zorbatron wrote ann@corp.example"), None),
            (2, text("Quellibar wrote bea@corp.example"), None),
            (3, text("Quellibar asked bea@corp.example"), None)]
    # Words that stand in many texts without the entity reveal nothing, in one context as in two.
    rows += [(10 + i, text("wrote asked"), None) for i in range(400)]
    # Copies count once: what a text gives away does not change with them.
    copied = [(500 + i, rows[0][1], None) for i in range(30)]
    for extra in ([], copied):
        got = {x.doc_id: x for x in privacy.found(frame(spark, rows + extra)).collect()}
        assert {i: [s.value for s in x.added] for i, x in got.items() if x.added} == {
            1: ["Zorbatron"], 2: ["Quellibar"], 3: ["Quellibar"],
            **{i: ["Zorbatron"] for i, _, _ in extra}}


def test_terms_are_words_of_the_whole_text(spark):
    r = random.Random(10)
    filler = [f"common{chr(97 + i)}" for i in range(20)]

    def some(n):
        return " ".join(r.choices(filler, k=n))

    # The first and the last word, far from the entity, short, after a sign, joined to the entity.
    rows = [(i, f"Johnson {some(40)} j@x.org,{some(40)} -Kim Signature", None) for i in range(4)]
    rows += [(10 + i, f"Zoltan j2@x.org {some(5)} kx19 j2@x.org end:Ybor", None) for i in range(4)]
    rows += [(100 + i, f"{some(20)} j x org", None) for i in range(300)]
    rows += [(900, "Lone 1.2.3.4 +12.3.4.5678 1.2.3.4", None)]
    got = {x.doc_id: x for x in privacy.found(frame(spark, rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    for i, x in got.items():
        want = (["Johnson", "Kim", "Signature"] if i < 4 else ["Zoltan", "kx19", "end", "Ybor"]
                if i < 100 else ["Lone"] if i == 900 else [])
        assert [s.value for s in x.added] == want
        assert all(texts[i][s.start:s.end] == s.value for s in x.added)


def test_overlapping_spans_become_one(spark):
    text = "to a@1.2.3.4 or 1.2.3.4, or +1 (23) 4567 89."
    assert len(plain_spans(text)) == 4
    row = privacy.sanitised(frame(spark, [(1, text, None)])).first()
    assert row.text == "to [EMAIL] or [IP], or [PHONE]."
    assert privacy.sanitised(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = privacy.found(frame(spark, HARD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- pipeline -------------------------------------------------------------------------------------

def plain_firsts(texts, least=0.8):
    """The smallest key that each is linked to by pairs of five-word Jaccard of ``least`` or more."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
            for i, w in words.items()}
    first = {}
    for i in sorted(sets):
        if i in first:
            continue
        first[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in sets:
                if y not in first and len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y]):
                    first[y] = i
                    todo.append(y)
    return first


def test_pipeline_stages(spark, tables):
    docs = table(spark, tables, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup"
    scratch = Scratch(spark, "pipeline-test")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(scratch.keep(stage(spark, seen[-1], tables)))
    assert all(s.columns == docs.columns for s in seen[:-1])
    raw, good, single, fresh, clean, coded = ({r.doc_id: r for r in s.collect()} for s in seen)
    model = quality.fit(docs, table(spark, tables, "labels"), remainder("doc_id", 4) != 2)
    assert set(good) == {r.doc_id for r in quality.scores(docs, model).collect()
                         if r.score >= quality.THRESHOLD}
    first = plain_firsts({i: r.text for i, r in good.items()})
    assert set(single) == set(first.values())
    items = [re.findall(r"\w+", r.text.casefold()) for r in table(spark, tables, "benchmark").collect()]
    held = {i for i, r in single.items() for w in items
            if " ".join(w) in " ".join(re.findall(r"\w+", r.text.casefold()))}
    assert held and not held & set(fresh)
    assert len(single) - len(fresh) <= len(held) + 2
    for i, r in fresh.items():
        assert clean[i].n_chars == len(clean[i].text)
        assert bool(plain_spans(r.text)) == (clean[i].text != r.text)
        assert not plain_spans(clean[i].text)
    assert set(coded) == set(clean) and all(r.n_tokens == len(r.ids) and r.round_trip for r in coded.values())
    whole = corpus_pipeline.run(spark, tables)
    assert sorted(whole.columns) == sorted(seen[-1].columns) and whole.count() == len(coded)


def test_pipeline_of_no_documents(spark, tables):
    docs = table(spark, tables, "documents").limit(0)
    scratch = Scratch(spark, "pipeline-test")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, tables))
    assert docs.count() == 0
