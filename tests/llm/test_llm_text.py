"""Fingerprints, language model, near-duplicates, tiling and byte-level BPE against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm import bpe, merkle, ngram_lm, overlap, simhash, tiling
from shelfline.llm.common import remainder

# Columns that the operators use inside, as extra columns of the input.
CLASHING = ("doc_id long, text string, key string, body string, hash string, spans string, "
            "fp string, row string, ids string, bucket string")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], CLASHING)


def words(n, seed, pool=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "É ß ǅ İ 😀 \x1c\x85x"),
        (7, "long " * 30000), (7, "long " * 30000), (None, "no key here at all"), (9, "a" * 20000),
        (10, words(300, 1)), (11, words(300, 1)), (12, words(300, 2)), (2**60, "far. away! Or?\n\nx")]


# --- fingerprints ---------------------------------------------------------------------------------

def test_fingerprints_of_hard_rows(spark):
    got = merkle.compare_with_next(docs(spark, HARD)).collect()
    order = sorted(HARD, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    want = Counter()
    for (i, _), t, u in zip(order, texts, texts[1:] + texts[:1]):
        n = len(t) // 3
        e = t[:len(t) - n] + u[:n]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.n_chars)
        assert 0.0 <= r.near_edited <= 1.0 and 0.0 <= r.near_next <= 1.0
    assert len(by) == len(set(texts))


def test_fingerprint_order_over_many_ranges(spark):
    rows = [(i * 7, words(20, i)) for i in range(400)]
    got = {r.doc_id: r for r in merkle.compare_with_next(docs(spark, rows), buckets=37).collect()}
    texts = dict(rows)
    ids = sorted(texts, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        e = merkle.edited(texts[i], texts[j])
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].near_next == merkle.likeness(merkle.Tree(texts[i]).weights(),
                                                   merkle.Tree(texts[j]).weights())


def test_keys_of_any_type_and_one_key_of_all_rows(spark):
    rows = [(f"key {i % 5:03d}" if i % 3 else None, words(12, i)) for i in range(60)] + [("key 001", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter((r.doc_id, r.edited_sha256) for r in merkle.compare_with_next(df, buckets=9).collect())
    hashed = spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).distinct()
    place = {t: h for t, h in hashed.collect()}
    order = sorted(sorted(((i, t or "") for i, t in rows), key=lambda r: place[r[1]]),
                   key=lambda r: (r[0] is not None, r[0] or ""), reverse=True)
    order = [x for k in dict.fromkeys(i for i, _ in order) for x in sorted(
        (r for r in order if r[0] == k), key=lambda r: place[r[1]])]
    want = Counter((i, hashlib.sha256(merkle.edited(t, u).encode()).hexdigest())
                   for (i, t), (_, u) in zip(order, order[1:] + order[:1]))
    assert got == want
    same = spark.createDataFrame([(1, f"text number {i}") for i in range(50)], "doc_id long, text string")
    assert merkle.compare_with_next(same, buckets=8).count() == 50
    (alone,) = merkle.compare_with_next(same.limit(1)).collect()
    assert alone.near_next == 1.0
    assert merkle.compare_with_next(same.limit(0)).count() == 0


def test_descending_gives_the_likeness_of_all_leaves():
    r = random.Random(4)
    for _ in range(120):
        a, b = ("".join(r.choice(["one. two! ", "three four five. ", "six\n", "\n", "one. two! \n\n", "é"])
                        for _ in range(r.randrange(40))) for _ in "ab")
        if r.random() < 0.6:
            b = a[:len(a) // 2] + b + a[len(a) // 2:]
        x, y = merkle.Tree(a), merkle.Tree(b)
        assert merkle.near(x, y) == pytest.approx(merkle.likeness(x.weights(), y.weights()))


def test_likeness_and_differing_branches():
    base = "".join(f"Paragraph number {i} says this. And that too.\n" for i in range(60))
    changed = base.replace("number 30 says", "number 30 shouts")
    a, b = merkle.Tree(base), merkle.Tree(changed)
    (section, start, end), = merkle.differing(a, b)
    assert "shouts" in changed[start:end] and end - start < 80
    assert merkle.likeness(a.weights(), b.weights()) > 0.9
    assert merkle.differing(a, merkle.Tree(base)) == []
    assert merkle.likeness(Counter(), Counter()) == 1.0
    assert merkle.likeness(a.weights(), Counter()) == 0.0


def test_tree_nodes_cover_the_text(spark):
    nodes = merkle.tree_nodes(docs(spark, [(1, "a. b\n\nc\nd" * 9), (2, None)])).collect()
    leaves = sorted((r.start, r.end) for r in nodes if r.level == "paragraph")
    assert leaves[0][0] == 0 and all(x[1] == y[0] for x, y in zip(leaves, leaves[1:]))
    assert leaves[-1][1] == len("a. b\n\nc\nd" * 9)
    assert [r.level for r in nodes if r.doc_id == 2] == ["root"]


# --- language model -------------------------------------------------------------------------------

def brute_model(rows, train, prior):
    counts = [Counter(), Counter()]
    for i, t in rows:
        if train(i):
            w = ["<s>", *(t or "").encode().lower().split(), "</s>"]
            counts[0].update(w)
            counts[1].update(zip(w, w[1:]))
    n, v = sum(c for w, c in counts[0].items() if w != "<s>"), len(counts[0].keys() - {"<s>"})
    out = []
    for i, t in rows:
        w = ["<s>", *(t or "").encode().lower().split(), "</s>"]
        base = score = 0.0
        for h, x in zip(w, w[1:]):
            p = (counts[0][x] + 1) / (n + v + 1)
            base += math.log10(p)
            score += math.log10((counts[1][h, x] + prior * p) / (counts[0][h] + prior))
        out.append((i, len(w) - 1, sum(counts[0][x] > 0 for x in w[1:]), n, base, score))
    return out


def test_scores_are_those_of_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BATCH_TEXT", 3000)  # several batches
    rows = HARD + [(20 + i, words(60, i)) for i in range(60)]

    def train(i):
        return zlib.crc32(str("" if i is None else i).encode()) % 7 != 2

    got = ngram_lm.scores(docs(spark, rows), remainder("doc_id", 7) != 2, prior=50.0).collect()
    want = brute_model(rows, train, 50.0)
    assert len(got) == len(want)

    def order(x):
        return (x[0] is None, x[0] or 0, x[4])

    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score,
                             r.held_out) for r in got), key=order), sorted(want, key=order)):
        assert g[:4] == w[:4]
        assert g[4:6] == pytest.approx(w[4:6], rel=1e-9)
        assert g[6] == (not train(g[0]))


def test_longer_histories_sum_to_one(spark):
    rows = [(i, words(30, i, 3)) for i in range(30)]
    corpus = rows + [(100 + k, f"w0 w1 {x}") for k, x in enumerate(["w0", "w1", "w2", ""])]
    train = F.col("doc_id") < 100
    got = {r.doc_id: r.score for r in ngram_lm.scores(
        docs(spark, corpus + [(200, "w0 w1 unseen"), (201, "w0 w1 w0")]), train, order=3,
        prior=5.0).collect()}
    assert got[100] == got[201]
    assert got[200] < got[101]
    empty = ngram_lm.scores(docs(spark, []), train)
    assert empty.count() == 0
    nothing = ngram_lm.scores(docs(spark, [(1, "a b")]), F.lit(False)).first()
    assert (nothing.train_tokens, nothing.n_known, nothing.n_tokens) == (0, 0, 3)


def test_third_order_is_that_of_plain_counts(spark, monkeypatch):
    """Histories of two words; unseen words and pairs take two failure arcs in a row."""
    monkeypatch.setattr(ngram_lm, "BATCH_TEXT", 900)
    rows = [(i, words(40, i, 9)) for i in range(40)] + [(90, "w1 zz w1 w2 zz zz"), (91, "w3"), (92, None)]
    counts = [Counter(), Counter(), Counter()]
    for i, t in rows:
        if i < 40:
            w = ["<s>", *(t or "").encode().lower().split(), "</s>"]
            for k in range(3):
                counts[k].update(zip(*(w[j:] for j in range(k + 1))))
    n = sum(c for (x,), c in counts[0].items() if x != "<s>")
    v, arcs = len(counts[0]) - 1, Counter()

    def weight(history, x, prior=5.0):
        if not history:
            return (counts[0][(x,)] + 1) / (n + v + 1)
        seen = counts[len(history)][(*history, x)]
        arcs[len(history), seen > 0] += 1
        return (seen + prior * weight(history[1:], x)) / (counts[len(history) - 1][history] + prior)

    got = {r.doc_id: r.score for r in ngram_lm.scores(
        docs(spark, rows), F.col("doc_id") < 40, order=3, prior=5.0).collect()}
    for i, t in rows:
        w = ["<s>", *(t or "").encode().lower().split(), "</s>"]
        want = sum(math.log10(weight(tuple(w[max(0, k - 2):k]), w[k])) for k in range(1, len(w)))
        assert got[i] == pytest.approx(want, rel=1e-9)
    assert arcs[2, False] and arcs[1, False] and arcs[2, True]


def test_texts_of_batches_spread_over_ranges():
    """The first batches of many tasks, and the many batches of one."""
    for batches in ([p << 32 for p in range(96)], [(5 << 32) + n for n in range(96)]):
        load = Counter(ngram_lm.text_part(b, 8) for b in batches)
        assert len(load) > 60 and max(load.values()) <= 4 and max(load) < 256


def test_arcs_and_failure_arc_sum_to_one(spark):
    texts = ["a b a c", "a b", "b c c a"]
    vocabulary = ["a", "b", "c"]
    probe = [(10 + k, f"a {x}") for k, x in enumerate([*vocabulary, "zzz"])]
    rows = list(enumerate(texts)) + probe + [(50, "a")]
    got = {r.doc_id: r for r in ngram_lm.scores(
        docs(spark, rows), F.col("doc_id") < 10, prior=3.0).collect()}
    brute = {r[0]: r[5] for r in brute_model(rows, lambda i: i < 10, 3.0)}
    assert all(got[i].score == pytest.approx(brute[i]) for i in brute)


# --- near-duplicates ------------------------------------------------------------------------------

def plain_simhash(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(fps, distance=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_near_duplicates_of_hard_rows(spark):
    rows = HARD + [(100 + i, words(200, 5) + f" tail{i}") for i in range(12)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [plain_simhash(t) for _, t in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter(
        (i, f) for (i, _), f in zip(rows, fps))
    parts = plain_components(fps)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[parts[f]] = min(i, first.get(parts[f], i))
    for r in got:
        assert r.component_id == first.get(parts[r.fp % (1 << 64)])


def test_links_of_dense_and_chained_fingerprints(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre}
    for _ in range(600):  # one dense group, several chunks of it
        f = centre
        for b in r.sample(range(64), r.randint(1, 4)):
            f ^= 1 << b
        fps.add(f)
    chain = r.getrandbits(64)
    for k in range(0, 60, 3):  # each three bits from the last
        chain ^= 7 << k
        fps.add(chain)
    fps |= {r.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 7}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    scratch = simhash.Scratch(spark, "test")
    links = scratch.keep(simhash.near_links(spark.createDataFrame(signed, "fp long"), scratch,
                                            chunk=64))
    from shelfline.llm.components import components
    got = {x.node: x.root for x in components(links, scratch).collect()}
    parts = plain_components(list(fps))
    groups, mine = {}, {}
    for (s,) in signed:
        groups.setdefault(parts[s % (1 << 64)], set()).add(s)
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert all(k == min(v) for k, v in mine.items())


def test_one_of_each_group_stays(spark):
    text = words(200, 8)
    rows = [(3, text), (1, text), (1, text), (5, "quite another"), (None, text), (6, None), (4, "")]
    kept = simhash.deduplicated(docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in CLASHING.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, text), (4, ""), (5, "quite another")], key=str) or got == sorted(
        [(1, text), (4, ""), (5, "quite another")], key=str)
    assert simhash.deduplicated(docs(spark, [])).count() == 0


def plain_copies(rows, words=5, least=0.8):
    """{row number: smallest row number linked by Jaccard similarity} by trying every pair."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("chunk", [512, 8])
def test_near_copies_are_those_of_every_pair(spark, chunk):
    rows, r = list(HARD), random.Random(12)
    for k in range(40):  # light to heavy edits, so that similarity is on both sides of 0.8
        text = words(r.randint(5, 260), 1000 + k, 5000).split()
        rows.append((1000 + 10 * k, " ".join(text)))
        for j in range(1, 5):
            edited = list(text)
            for _ in range(max(1, len(text) * j // 100)):
                edited[r.randrange(len(edited))] = f"new{r.random()}"
            rows.append((1000 + 10 * k + j, " ".join(edited)))
    hot = words(300, 77, 5000)
    rows += [(5000 + i, f"{hot} tail{i}") for i in range(60)]  # one bucket, many chunks of 8
    rows += [(6000, "four words stand here"), (6001, "Four  words stand here"), (6002, "four words stand")]
    got = overlap.near_copies(docs(spark, rows), chunk=chunk).collect()
    parts, first = plain_copies(rows), {}
    for (i, _), p in zip(rows, parts):
        if i is not None:
            first[p] = min(i, first.get(p, i))
    assert Counter((x.doc_id, x.component_id) for x in got) == Counter(
        (i, first.get(p)) for (i, _), p in zip(rows, parts))
    assert len(set(parts)) > 60 and len(rows) - len(set(parts)) > 100


def test_near_dedup_stage_drops_copies_beyond_three_bits(spark):
    text = words(100, 31, 900).split()
    light = " ".join(text[:50] + ["changed"] + text[51:])
    heavy = " ".join(x if i % 9 else "changed" for i, x in enumerate(text))
    rows = [(1, " ".join(text)), (2, light), (3, heavy), (4, None)]
    a, b = (plain_simhash(t) for _, t in rows[:2])
    assert (a ^ b).bit_count() > 3 and plain_copies(rows) == [0, 0, 2, 3]
    kept = corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), "")
    assert kept.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert corpus_pipeline.near_dedup_stage(spark, docs(spark, []), "").count() == 0


def test_near_dedup_stage_links_fingerprints_within_three_bits(spark):
    """Texts of one repeated line share few of their shingles, but nearly all bits."""
    line = words(12, 10, 900)
    one, other = (" ".join([line] * 60 + [words(6, k, 900)]) for k in (6, 7))
    rows = [(1, one), (2, other), (3, words(40, 8, 900)), (4, one.upper())]
    a, b = plain_simhash(one), plain_simhash(other)
    assert a != b and (a ^ b).bit_count() <= 3 and plain_copies(rows) == [0, 1, 2, 0]
    kept = corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    # A fingerprint that two texts share, one of them linked by shingles only.
    text = words(200, 9, 5000).split()
    light = " ".join(text[:100] + ["changed"] * 3 + text[103:])
    rows += [(11, " ".join(text)), (12, light)]
    got = overlap.near_copies(docs(spark, rows), distance=3).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1, 11: 11, 12: 11}


# --- tiling ---------------------------------------------------------------------------------------

def plain_tiles(text, item, window):
    """Greedy string tiling by trying every pair of places."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while (i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k]
                       and free_t[i + k] and free_i[j + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < window:
            return sorted(out)
        out.append((i, j, k))
        for d in range(k):
            free_t[i + d] = free_i[j + d] = False


def test_tiles_are_greedy():
    r = random.Random(11)
    for _ in range(150):
        item = [r.choice("abcd") for _ in range(r.randint(3, 14))]
        text = [r.choice("abcd") for _ in range(r.randint(0, 30))]
        window = r.randint(2, 4)
        seeds = [(i, j) for i in range(len(text) - window + 1) for j in range(
            len(item) - window + 1) if text[i:i + window] == item[j:j + window]]
        assert tiling.tiles(seeds, window) == plain_tiles(text, item, window)


def test_matches_are_the_runs_of_all_pairs(monkeypatch):
    """Few kinds of words, so that windows repeat; some pairs at a time; nothing short of coverage."""
    r = random.Random(13)
    for pairs in (3, 1 << 20):
        monkeypatch.setattr(tiling, "PAIRS", pairs)
        for _ in range(40):
            texts = [" ".join(r.choices("abc", k=r.randint(0, 25))) for _ in range(4)]
            own = [" ".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(3)]
            items = tiling.Items([0, 1, 2], own, 3)
            got = {(d, n): (w, m) for d, n, w, m in items.matches(texts, 0.0)}
            for d, t in enumerate(texts):
                for n, u in enumerate(own):
                    a, b = t.split(), u.split()
                    w = min(3, len(b))
                    want = []
                    for i in range(len(a)):
                        for j in range(len(b)):
                            if not (i and j and a[i - 1] == b[j - 1]):
                                k = 0
                                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                                    k += 1
                                if k >= w > 0:
                                    want.append((i, j, k))
                    assert got.get((d, n), (w, []))[1] == want
                    assert tiling.tiles_of(want, w or 1) == (plain_tiles(a, b, w) if w else [])
            bound = {(d, n): sum(x[2] for x in m) for (d, n), (_, m) in got.items()}
            assert {(d, n) for d, n, _, _ in items.matches(texts, 0.9)} == {
                k for k, v in bound.items() if v >= 0.9 * len(own[k[1]].split())}


def test_repeated_words_take_bounded_work():
    items = tiling.Items([0, 1], ["go " * 400, "stop " * 3], 5)
    (found,) = items.matches(["go " * 20_000], 0.8)
    assert len(found[3]) <= 20_400 and tiling.tiles_of(found[3], 5) == [(0, 0, 400)]


def test_overlaps(spark):
    item = words(40, 21, 900)
    w = item.split()
    moved = " ".join(w[25:] + ["and", "then"] + w[:25])
    rows = [(1, f"before {item.upper()}, after"), (2, moved), (3, " ".join(w[:20])), (4, None),
            (5, words(500, 4, 900)), (1, f"x {item}"), (None, item), (8, "tiny item")]
    bench = spark.createDataFrame([(10, item, "k"), (11, None, "k"), (12, "?!", "k"),
                                   (13, "Tiny item!", "k"), (10, item, "k")],
                                  "item_id int, text string, key string")
    for block in (1 << 20, 100):  # one block and several
        got = Counter((r.doc_id, r.item_id, r.coverage) for r in tiling.overlaps(
            docs(spark, rows), bench, block=block).collect())
        assert got == Counter({(1, 10, 1.0): 4, (2, 10, 1.0): 2, (None, 10, 1.0): 2,
                               (8, 13, 1.0): 1})
        kept = tiling.uncontaminated(docs(spark, rows), bench, block=block)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert tiling.overlaps(docs(spark, rows), bench.limit(0)).count() == 0
    assert tiling.overlaps(docs(spark, []), bench).count() == 0


# --- byte-level BPE -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def oracle():
    import public_tokenizers

    with open(bpe.vocabulary_path(), "rb") as file:
        tool = bpe.Codec(file.read())
    return tool, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                   mergeable_ranks=tool.ranks, special_tokens={})


def test_ids_are_the_librarys(oracle):
    tool, library = oracle
    r = random.Random(4)
    pool = list("ab'sтre velmd'' \n\t 　!?.1²Ⅷé漢😀́\x1c\x85\0") + ["'s", "'re", "'ll", "  ", " '",
                                                                "\r\n", "<|endoftext|>"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 50))) for _ in range(4000)]
    texts += ["", "a" * 3000, "ab" * 900, "don't" * 200, " " * 700, "'" * 333, "x" * 101]
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        got = tool.encode(part)
        data, places = tool.decode(got.ids)
        for i, t in enumerate(part):
            ids = got.ids[got.bounds[i]:got.bounds[i + 1]].tolist()
            assert ids == library.encode_ordinary(t)
            assert bytes(data[places[got.bounds[i]]:places[got.bounds[i + 1]]]) == t.encode()


def test_scan_agrees_with_a_state_machine_run_one_by_one():
    r = np.random.default_rng(5)
    kinds = r.integers(0, 9, 5000).astype(np.uint8)
    state, want = bpe.START, []
    for k in kinds:
        want.append(bool(bpe.CUT[k, state]))
        state = bpe.TO[k, state]
    assert bpe.scan(kinds).tolist() == want


def test_encode_and_decode_tables(spark, oracle):
    frame = docs(spark, HARD)
    coded = bpe.encode(frame, bpe.vocabulary_path())
    assert [c for c in frame.columns if c != "ids"] + ["ids", "piece_offsets",
                                                       "n_tokens"] == coded.columns
    for r in coded.collect():
        assert r.ids == oracle[1].encode_ordinary(r.text or "")
        assert r.n_tokens == len(r.ids)
        assert r.piece_offsets == sorted(set(r.piece_offsets))
    back = bpe.decode(coded, bpe.vocabulary_path()).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.digests(docs(spark, []), bpe.vocabulary_path()).count() == 0
    sums = bpe.digests(frame, bpe.vocabulary_path()).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in sums) == Counter(
        (i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in HARD)
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, oracle[1].encode_ordinary(
        dict(HARD)[r.doc_id] or ""))).encode()).hexdigest() for r in sums)


def test_tokens_stage_decodes_its_ids(spark, oracle, monkeypatch):
    rows = corpus_pipeline.tokens_stage(spark, docs(spark, HARD), "").collect()
    assert len(rows) == len(HARD) and all(r.round_trip is True for r in rows)
    assert all(r.piece_offsets is not None and r.ids == oracle[1].encode_ordinary(r.text or "")
               for r in rows)
    # Ids that say something else are found out.
    decode = bpe.Codec.decode
    monkeypatch.setattr(bpe.Codec, "decode", lambda self, ids: decode(self, (ids + 1) % 1000))
    rows = corpus_pipeline.tokens_stage(spark, docs(spark, HARD), "").collect()
    assert all(r.round_trip is (not r.text) for r in rows)
