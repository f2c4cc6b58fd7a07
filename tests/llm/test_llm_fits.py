"""Fitted models and disclosure against plain computations; models in workers without the repository."""

import math
import os
import random
import re
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import language, privacy, quality, toxicity
from shelfline.llm.common import Scratch

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# --- quality --------------------------------------------------------------------------------------

def test_dual_descent_reaches_the_optimum():
    """Against projected gradient ascent on the dual of the same small problem."""
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 30, r.integers(2, 9))) for _ in range(40)]
    signs = np.where([(4 in x) != (r.random() < 0.2) for x in rows], 1.0, -1.0)
    model = quality.Model.__new__(quality.Model)
    model.ratios = quality.Model.log_ratios(rows, signs)
    weights, bias = model.descend(rows, signs)
    x = np.zeros((len(rows), 31))
    for own, row in zip(x, rows):
        v = model.ratios[row]
        own[row], own[30] = v / (np.sqrt(v @ v) or 1.0), 1.0
    most = quality.COST * 0.5 / np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())

    def primal(w):
        return 0.5 * w @ w + (most * np.maximum(0, 1 - signs * (x @ w))).sum()

    kernel = (signs[:, None] * x) @ (signs[:, None] * x).T
    alpha, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - kernel @ alpha), 0, most)
    best = alpha.sum() - 0.5 * alpha @ kernel @ alpha
    own = np.append(weights[:30], bias)
    assert not weights[30:].any() and best - 1e-6 <= primal(own) <= best * 1.01 + 1e-3


def test_log_ratios_are_those_of_counts():
    rows = [np.array([1, 5]), np.array([1]), np.array([5, 9])]
    got = quality.Model.log_ratios(rows, np.array([1.0, -1.0, -1.0]))
    n, a = quality.PLACES, quality.SMOOTHING
    for place, pos, neg in ((1, 1, 1), (5, 1, 1), (9, 0, 1), (2, 0, 0)):
        assert got[place] == pytest.approx(math.log((pos + a) / (2 + n * a)) - math.log((neg + a) / (3 + n * a)))


# --- toxicity -------------------------------------------------------------------------------------

def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(5)
    x = r.integers(0, 12, (200, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (r.random(200) < 0.1)).astype(float)
    weights = r.uniform(0.5, 2, 200)
    trees = toxicity.Trees(x, y, weights)
    share = np.average(y, weights=weights)
    g, h = weights * (y - share), weights * share * (1 - share)

    def gain(left):
        parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
        if min(p[1] for p in parts) < trees.LEAST * 0.05:
            return 0.0
        return sum(a * a / (b + trees.RIDGE) for a, b in parts) - g.sum() ** 2 / (h.sum() + trees.RIDGE)

    best = max(gain(x[:, f] <= e) for f in range(4) for e in trees.edges[f])
    feature, cut, _ = trees.trees[0][0]
    assert feature == 2 and gain(x[:, 2] <= trees.edges[2][cut]) == pytest.approx(best)
    assert ((trees.raw(x) > 0) == (y > 0.5)).mean() > 0.85


def test_values_follow_the_nodes():
    r = np.random.default_rng(6)
    x = r.random((80, 3))
    trees = toxicity.Trees(x, (x[:, 0] > x[:, 1]).astype(float), np.ones(80))

    def walk(tree, bins):
        at = 0
        while tree[at][0] >= 0:
            at = 2 * at + 1 + (bins[tree[at][0]] > tree[at][1])
        return tree[at][2]

    bins = [[int((e < v).sum()) for e, v in zip(trees.edges, row)] for row in x]
    want = [trees.base + sum(walk(t, b) for t in trees.trees) for b in bins]
    assert trees.raw(x) == pytest.approx(want)


def test_isotonic_map_is_the_least_squares_one():
    r = np.random.default_rng(7)
    raw = r.permutation(60).astype(float)
    y, w = (r.random(60) < raw / 60).astype(float), r.uniform(0.5, 2, 60)
    knots, shares = toxicity.isotonic(raw, y, w)
    order = np.argsort(raw)
    ys, ws = y[order], w[order]
    mean = lambda a, b: np.average(ys[a:b + 1], weights=ws[a:b + 1])
    want = [max(min(mean(a, b) for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.interp(raw[order], knots, shares) == pytest.approx(want)


def test_lexicon_is_that_of_plain_counts(spark):
    r = random.Random(8)
    rows = []
    for i in range(300):
        y = int(i % 3 == 0)
        words = r.choices([f"w{k}" for k in range(12)], k=6) + (["slur"] if y and r.random() < 0.8 else [])
        rows.append((i, y, " ".join(words), i % 2))
    found = spark.createDataFrame(rows, "key long, y int, body string, half int")
    counts = Scratch(spark, "lexicon-test").keep(toxicity.unit_counts(found))
    got = toxicity.learn_lexicon(counts, Counter((y, h) for _, y, _, h in rows), (0, 1))
    texts = [sum(y == k for _, y, _, _ in rows) for k in (0, 1)]
    held = {k: Counter(u for _, y, t, _ in rows if y == k for u in {
        u for w in set(t.split()) for u in toxicity.units(w)}) for k in (0, 1)}
    want = {}
    for unit in held[1]:
        a, b = held[1][unit], held[0][unit]
        table = [(a, texts[1], a + b), (b, texts[0], a + b), (texts[1] - a, texts[1], 300 - a - b),
                 (texts[0] - b, texts[0], 300 - a - b)]
        told = 2 * sum(n * math.log(n * 300 / (row * col)) for n, row, col in table if n)
        odds = math.log((a + 0.5) / (texts[1] + 0.5 - a)) - math.log((b + 0.5) / (texts[0] + 0.5 - b))
        if a >= toxicity.LEAST_SUPPORT and told >= toxicity.LEAST_EVIDENCE and odds > 0:
            want[unit] = odds
    assert got == pytest.approx(want) and "=slur" in got or any("slur" in u for u in got)
    assert set(got) == set(want)


# --- language -------------------------------------------------------------------------------------

def test_centroids_and_rejection_are_those_of_plain_vectors():
    r = random.Random(9)
    letters = {"xx": "abcdef", "yy": "uvwxyz", "zz": "mnopqr"}
    texts = [(name, " ".join("".join(r.choices(own, k=4)) for _ in range(30)))
             for name, own in letters.items() for _ in range(12)]

    def grams(text):
        data = b" %b " % text.lower().encode().translate(language.KEPT)
        out = Counter()
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                x = 0
                for byte in data[i:i + n]:
                    x = (x * 257 + byte) % (1 << 32)
                out[(x * 2654435761) % (1 << 32) >> 19] += 1
        return out

    for _, t in texts:
        own = language.counts(t)
        assert {int(i): int(own[i]) for i in np.flatnonzero(own)} == dict(grams(t))
    found = [language.counts(t) for _, t in texts]
    places = [np.flatnonzero(x) for x in found]
    model = language.Model(((p, x[p]) for p, x in zip(places, found)), [n for n, _ in texts])
    idf = {}
    for p in range(language.PLACES):
        held = sum(p in g for g in map(set, places)) if any(model.idf[p] != model.idf[0] for _ in [0]) else 0
        if held:
            idf[p] = math.log((1 + len(texts)) / (1 + held)) + 1
    assert all(model.idf[p] == pytest.approx(v, rel=1e-5) for p, v in idf.items()) and len(idf) > 100
    assert len(model.languages) <= 9 and set(model.languages) == set(letters)

    def vector(text):
        own = {p: (1 + math.log(c)) * float(model.idf[p]) for p, c in grams(text).items()}
        length = math.sqrt(sum(v * v for v in own.values()))
        return {p: v / length for p, v in own.items()}

    members = {}
    for name, t in texts:
        own = vector(t)
        near = [sum(v * float(c[p]) for p, v in own.items()) for c in model.centroids]
        mine = [n if model.languages[i] == name else -1.0 for i, n in enumerate(near)]
        members.setdefault(int(np.argmax(mine)), []).append((own, max(mine)))
        got = model.predict(t)
        assert got[0] == model.languages[int(np.argmax(near))] and got[1] == pytest.approx(max(near), abs=1e-4)
        assert got[2] == (max(near) < model.floors[int(np.argmax(near))]) or max(near) == pytest.approx(
            model.floors[int(np.argmax(near))], abs=1e-5)
    for i, own in members.items():  # a centroid is the direction of its members' sum
        total = Counter()
        for v, _ in own:
            total.update(v)
        length = math.sqrt(sum(x * x for x in total.values()))
        assert all(float(model.centroids[i][p]) == pytest.approx(x / length, abs=1e-4) for p, x in total.items())
        assert model.floors[i] == pytest.approx(np.quantile([n for _, n in own], language.REJECTED_SHARE), abs=1e-4)
    assert model.predict("12 34")[::2] == ("und", True)


# --- workers --------------------------------------------------------------------------------------

PROBE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from shelfline.session import build_session
from shelfline.llm import language, quality, toxicity
spark = build_session(master="local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
probe = spark.range(1).mapInArrow(lambda b: (x for x in b if __import__("importlib").util.find_spec("shelfline") is None), "id long")
print("absent", probe.count())
rows = [(i, ("good fine words here " if i % 2 else "BAD!!! you bad bad ") * 9, "en" if i % 2 else "de") for i in range(40)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
print(quality.scores(docs, quality.fit(docs, labels, F.lit(True))).count(),
      quality.accepted(docs, quality.fit(docs, labels, F.lit(True))).count(),
      toxicity.scores(docs, toxicity.fit(docs, labels, F.lit(True))).count(),
      language.predictions(docs, language.fit(docs, F.lit(True))).count())
"""


def test_models_reach_workers_without_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE.format(root=ROOT)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split("\n")[0] == "absent 1" and done.stdout.split("\n")[1].split()[::2] == ["40", "40"]


# --- disclosure -----------------------------------------------------------------------------------

def plain_revealing(texts, disclosure, prior, alpha):
    """{(entity, term)} from plain counts over all texts."""
    word, mail = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+@[a-z]+\.org")
    n, total, n_t = len(texts), 0, Counter()
    contexts = {}
    for t in texts:
        own = set(word.findall(t))
        n_t.update(own)
        rest = mail.sub(lambda m: " " * len(m.group()), t)
        for e in set(mail.findall(t)):
            contexts.setdefault(e, Counter())[frozenset(word.findall(rest))] += 1
    total, out = sum(n_t.values()), set()
    for e, seen in contexts.items():
        n_e, copies_e = len(seen), sum(seen.values()) - len(seen)
        words_e = sum(map(len, seen)) / n_e
        for term in set().union(*seen):
            n_te = sum(term in c for c in seen)
            copies = sum(k - 1 for c, k in seen.items() if term in c)
            texts_of = float(max(n - copies_e, n_e))
            apart = max(n_t[term] - copies, n_te)
            share, own = apart / texts_of, math.log(texts_of / n_e)
            if own <= 0 or math.log((n_te + prior * share) / (n_e + prior) / share) / own < disclosure:
                continue
            rare = sum(c for c in n_t.values() if int(math.log2(c)) <= int(math.log2(apart))) / n
            times = max(1.0, words_e * n / total)
            entropy = lambda x: x * math.log(x) if x else 0.0
            chance = math.exp(entropy(n_e) - entropy(n_te) - entropy(n_e - n_te)
                              + (n_te - 1) * math.log(min(1.0, times * share))) * times * rare
            if chance <= alpha:
                out.add((f"email:{e}", term))
    return out


def test_revealing_terms_are_those_of_plain_counts(spark):
    r = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(r.choices(common, k=12)) for _ in range(300)]
    for e in range(25):  # of one to five contexts, with a name in most of them, copies, rare words by chance
        for k in range(1 + e % 5):
            name = f"name{e}" if r.random() < 0.9 else "nobody"
            text = f"{' '.join(r.choices(common, k=8))} {name} of{e % 7} e{e}@x.org" + (
                f" odd{r.randrange(40)}" if r.random() < 0.5 else "")
            texts += [text] * r.choice([1, 1, 3])
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bodies = df.select(F.col("doc_id").alias("key"), F.col("text").alias("body"))
    scratch = Scratch(spark, "privacy-test")
    rows = scratch.keep(privacy.with_spans(bodies).select("key", F.xxhash64("body").alias("hash"), "spans", "body"))
    for disclosure, alpha in ((0.8, 0.05), (0.5, 0.5), (0.8, 1e-4)):
        got = {(x.entity, x.term) for x in privacy.revealing(
            bodies, rows, disclosure, 2.0, scratch, alpha).collect()}
        assert got == plain_revealing(texts, disclosure, 2.0, alpha)
        if alpha == 0.05:
            assert sum(t.startswith("name") for _, t in got) >= 15
            assert not any(t.startswith(("c", "of")) for _, t in got)


def test_many_spans_in_one_text_take_linear_time(spark):
    text = " ".join(f"u{i}@host{i}.example é𝄞 10.0.{i % 256}.7" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.time()
    (row,) = privacy.sanitised(df).collect()
    assert row.text == " ".join(["[EMAIL] é𝄞 [IP]"] * 20_000)
    assert time.time() - begun < 60
