"""Collocations, the conversation trie and license scans against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfline.llm import collocations, license_scan, prefix_trie

DOCS = "doc_id long, text string, lang string, grp string, name string, words string, body string, key string"


def documents(spark, rows, parts=3):
    made = [(i, t, g, *["x"] * 5) for i, t, g in rows]
    return spark.createDataFrame(made, DOCS).repartition(parts) if made else spark.createDataFrame(made, DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- collocations -----------------------------------------------------------------------------------

def counted(rows):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    return counts, totals


def plain_collocations(rows, least, top):
    counts, totals = counted(rows)
    out = []
    for lang, c in counts.items():
        own = {g: n for g, n in c.items() if n >= least and len(g) > 1}
        scored = []
        for g, a in own.items():
            if any(len(x) > len(g) and 100 * n >= 80 * a and any(
                    x[i:i + len(g)] == g for i in range(len(x))) for x, n in own.items()):
                continue
            score, _, left, right = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]])
                                        for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found_collocations(df, least, top, **more):
    got = collocations.best(collocations.mined(df, least=least, **more), top, salts=3)
    return sorted(tuple(r) for r in got.select("grp", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard_text", [40, 700, 1 << 20])
def test_collocations_against_brute_force(spark, shard_text):
    r = random.Random(4)
    words = ["a", "B", "the", "é", "É", "x1", "ß", " ", "\x1c", "new", "york", "日本"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"])
                        for _ in range(r.randrange(60))), r.choice(["en", "de", None, "und", ""]))
            for i in range(60)]
    rows += [(100 + i, "the quick brown fox", "en") for i in range(9)]
    rows += [(200, "go " * 500, "en"), (201, "go. " * 90, "en"), (202, None, "en"), (203, "", None),
             (204, " \t .,;\n", "en"), (None, "the quick brown", "en"), (205, "w" * 5000, "fr")]
    got = found_collocations(documents(spark, rows), 4, 7, shard_text=shard_text)
    assert got == plain_collocations(rows, 4, 7)
    assert {g[0] for g in got} >= {"en", "de", "und"}


def test_collocations_of_nothing(spark):
    assert found_collocations(documents(spark, []), 1, 5) == []
    assert found_collocations(documents(spark, [(1, None, None), (2, "...", "en"), (3, "one", "en")]), 1, 5) == []


def test_suffix_order_and_intervals():
    r = np.random.default_rng(2)
    for size, kinds in ((300, 3), (900, 40), (50, 1)):
        s = np.append(r.integers(0, kinds + 1, size), 0)
        s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
        s = s[1:] if s[0] == 0 else s
        closing = {int(p): i for i, p in enumerate(np.flatnonzero(s == 0))}

        def key(p, s=s, closing=closing):
            out = []
            while p not in closing:
                out.append(int(s[p]) + len(s))
                p += 1
            return [*out, closing[p]]

        order = sorted(range(len(s)), key=key)
        assert collocations.suffixes(s).tolist() == order
        shard = collocations.Shard(collocations.Shard.transform(s), kinds)
        rows = shard.named_words(np.arange(1, kinds + 1, dtype=np.uint64))
        assert rows.tolist() == s[order].tolist()
        first, end, a, b = shard.longer(rows)
        want = Counter((int(x), int(y)) for x, y in zip(s, s[1:]) if x and y)
        assert Counter(dict(zip(zip(a.tolist(), b.tolist()), (end - first).tolist()))) == want


# --- conversation trie ----------------------------------------------------------------------------

CONVS = "conv_id long, turn long, role string, text string, conv string, pos long, n long, node string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], CONVS)


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), kids[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))
                                  .encode()).hexdigest()) for n, m in nodes.items())


def found_trie(df, **more):
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.trie(df, **more).collect())


def some_conversations():
    r = random.Random(7)
    texts = ["", None, "hi", "é" * 5, "𝄞𝄞", "the same text again", "no"]
    rows = []
    for c in [*range(0, 14), *range(95, 112), 300, 333, 900]:
        kept = c not in (100,)
        for t in range(r.randrange(1, 9) if kept else 0):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += [(400, t, "user", f"turn {t % 3}") for t in range(150)]
    rows += [(401, t, "user", f"turn {t % 3}") for t in range(150)]
    rows += [(500 + i, t, "user", "copy") for i in range(40) for t in range(3)]
    rows += [(700, None, "user", "null turn"), (700, None, "user", "null turn"), (700, 3, None, None),
             (700, 3, None, "tie"), (None, 1, "user", "nobody"), (801, 5, "user", "only")]
    return rows


def test_trie_against_brute_force(spark):
    rows = some_conversations()
    assert found_trie(conversations(spark, rows)) == plain_trie(rows)


def test_trie_of_colliding_hashes(spark):
    """Two hash values for all turns, and multipliers of 1 first: both have to be caught."""
    rows = [x for x in some_conversations() if x[0] is None or x[0] < 450]
    made = found_trie(conversations(spark, rows), mask=1,
                      multipliers=[(1, 1), *prefix_trie.MULTIPLIERS])
    assert made == plain_trie(rows)
    swapped = [(0, 0, "a", "x"), (0, 1, "a", "y"), (1, 0, "a", "y"), (1, 1, "a", "x")]
    with pytest.raises(ValueError):
        found_trie(conversations(spark, swapped), multipliers=[(1, 1)],
                   head=lambda c: c * 0)


def test_trie_of_nothing(spark):
    assert found_trie(conversations(spark, [])) == []
    assert found_trie(conversations(spark, [(None, 1, "a", "b")])) == []


def test_trie_composes_over_ranges(spark):
    """One conversation over many ranges, with a batch of few rows."""
    rows = [(9, t, "user", f"text {t}") for t in range(600)] + [(10, 0, "user", "x")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found_trie(conversations(spark, rows)) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# --- license scans --------------------------------------------------------------------------------

def plain_scan(text, containment=0.9):
    text = lower(text)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = word.findall(text)
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    found, most = set(), 0.0
    for block in re.split(r"[.!?;:][ \t\n\x0b\f\r]+|\n[ \t\r]*\n", text):
        held = set(word.findall(block))
        met = [(len(t & held) / len(t), label) for label, ss in license_scan.TEMPLATES.items()
               for t in (set(s.split()) for s in ss)]
        met = [m for m in met if m[0] >= containment]
        if met:
            best = max(met)[0]
            most = max(most, best)
            found |= {label for c, label in met if c == best}
    return (len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels),
            sorted(found), 1.0 if at else most)


def test_license_scan_against_brute_force(spark):
    r = random.Random(3)
    notices = [s for ss in license_scan.TEMPLATES.values() for s in ss]
    texts = [None, "", " \n", "no license here", "Under the MIT License under the mit license",
             "UNDER THE MIT LICENSE." * 3, "cc by nc cc by nc", "cc-by-nc-sa", "Apache License, Version 2.0.",
             "é under thé mit license", "under the mit licenseé", "w " * 30000, "K under the mit license"]
    for _ in range(150):
        words = r.choice(notices).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(["xyz", "the", "license", "é"])
        if r.random() < 0.5:
            r.shuffle(words)
        words = [w.upper() if r.random() < 0.3 else w for w in words]
        texts.append("Some words. " * r.randrange(3) + r.choice([" ", "\n", ", "]).join(words)
                     + r.choice([".", "\n\n more", "; and more"]) + " the end of it" * r.randrange(9))
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[4], None), (None, texts[4], None),
                                                          (4, texts[5], None), (4, texts[4], "x")]
    got = sorted((tuple(x or "" if isinstance(x, str) else x for x in r_) for r_ in license_scan.scan(
        documents(spark, rows)).collect()), key=str)
    want = sorted(((i, *plain_scan(t)) for i, t, _ in rows), key=str)
    assert got == want
    assert sum(1 for g in got if g[6]) > 60


def test_license_index_misses_nothing(spark):
    """Small sets over few words: the join finds what comparing every block with every template finds."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(14)]
    templates = {f"t{i}": [" ".join(r.sample(words, r.randrange(2, 9)))] for i in range(12)}
    texts = [" ".join(r.choices(words, k=r.randrange(1, 14))) for _ in range(120)]
    df = documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    for containment in (0.5, 0.8, 1.0):
        got = license_scan.scan(df, templates=templates, containment=containment)
        for row in got.collect():
            held = set(texts[row.doc_id].split())
            share = {k: len(held & set(v[0].split())) / len(v[0].split()) for k, v in templates.items()}
            met = {k: c for k, c in share.items() if c >= containment - 1e-12}
            best = max(met.values(), default=0.0)
            assert row.score == best and row.found_labels == sorted(k for k, c in met.items() if c == best)


def test_license_scan_is_native(spark, tables, capsys):
    assert license_scan.scan(documents(spark, [])).collect() == []
    df = license_scan.op13_license_scan(spark, tables)
    df.explain("formatted")
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", capsys.readouterr().out)


