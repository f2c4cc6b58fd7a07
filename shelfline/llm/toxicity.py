"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Words are looked up in two lexicons: a short fixed one, and one learned from the training labels,
of words and word beginnings that toxic texts hold and others do not.  The features are densities of
hits, how near hits are to second-person words, capitals, punctuation, digits, stretched and
obfuscated words.  Trees are fitted to the log loss; scores of rows that their fold's trees have not
seen give the isotonic map, weighted to the classes' shares among all labelled rows.

Fitted on at most ``labelled.FIT_ROWS`` labelled rows.  The learned lexicon has at most
``LEXICON`` entries, and so has a fixed size like the trees; both go to the tasks, which read every
text whole.

Defined results: null and empty texts have features of zero and get the score of those.  With no
labelled rows, or of one class only, the score is that class's share (0 for none).  Repeated rows
each get their row.  Columns other than the key and the text are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, Sent, bounded_batches, remainder, table, text_slices, whole
from shelfline.llm.labelled import FIT_ROWS, gathered, sample
from shelfline.llm.registry import query

# Insults and second-person words of the four languages.
INSULTS = """asshole bastard bitch clown coward creep crap damn disgusting dumb fool freak fuck
garbage idiot imbecile jerk kill liar loser moron pathetic pig rat scum shit shut stupid trash ugly
useless vermin worthless arschloch dumm depp idioten mist schwein abschaum connard conne salaud
merde imbécile ordure débile imbécil estúpido idiota basura mierda cabrón asqueroso""".split()
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton
ta tes vous votre vos usted ustedes ti tú vosotros""".split()
# Letters that signs stand for.
SIGNS = str.maketrans("013457@$!|€", "oieastasile")
LEXICON, LEAST_SUPPORT, LEAST_EVIDENCE = 400, 4, 15.0
BEGINNINGS = (3, 4, 5, 6, 7, 8)
NEAR = 5
THRESHOLD = 0.3
FEATURES = 18
STRETCHED = re.compile(r"(.)\1\1")
# Words remembered by a worker; this changes the time, never the result.
CACHED = 1 << 18


def plain(word: str) -> str:
    """The word without marks around it, case folded."""
    return word.strip(".,;:!?\"'()[]{}<>*#$%&|~_-…«»“”").casefold()


def revealed(word: str) -> str:
    """The word with signs read as letters and marks inside it dropped."""
    return "".join(c for c in word.casefold().translate(SIGNS) if c.isalpha())


def units(word: str) -> list[str]:
    """What the learned lexicon may hold of a word: the whole and its beginnings."""
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


class Words:
    """Per-word attributes against both lexicons."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.fixed, self.second = lexicon, set(INSULTS), set(SECOND_PERSON)
        self.cache: dict[str, tuple] = {}

    def attributes(self, word: str) -> tuple:
        """(letters, capitals, marks, digits, is upper, weight, fixed, second, hidden, odd, stretched)."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            known = self._attributes(word)
            if len(word) <= 64:
                self.cache[word] = known
        return known

    def _attributes(self, word: str) -> tuple:
        letters = sum(c.isalpha() for c in word)
        digits = sum(c.isdigit() for c in word)
        own = plain(word)
        weight = max((self.lexicon.get(u, 0.0) for u in units(own)), default=0.0)
        fixed = own in self.fixed
        odd = letters > 0 and not own.isalpha() and any(not c.isalpha() for c in own)
        hidden = False
        if odd and not fixed and not weight:
            shown = revealed(own)
            hidden = shown in self.fixed or self.lexicon.get("=" + shown, 0.0) > 0
        return (letters, sum(c.isupper() for c in word), len(word) - letters - digits, digits,
                letters > 1 and word == word.upper(), weight, fixed, own in self.second, hidden,
                odd, bool(STRETCHED.search(own)))

    def features(self, texts: list[str]) -> Iterator[np.ndarray]:
        words: list[str] = []
        sizes = []
        for t in texts:
            own = t.split()
            words += own
            sizes.append(len(own))
        coded = pa.array(words, pa.string()).dictionary_encode()
        by_word = np.array([self.attributes(w) for w in coded.dictionary.to_pylist()], np.float64)
        place = coded.indices.to_numpy(zero_copy_only=False)
        at = 0
        for n in sizes:
            yield self.dense(by_word[place[at:at + n]]) if n else np.zeros(FEATURES)
            at += n

    @staticmethod
    def dense(x: np.ndarray) -> np.ndarray:
        n = len(x)
        total = x.sum(axis=0)
        chars = max(1.0, total[:4].sum() - total[1])
        hits = (x[:, 5] > 0) | (x[:, 6] > 0) | (x[:, 8] > 0)
        places = np.flatnonzero(hits)
        second = np.flatnonzero(x[:, 7])
        near = 0
        if len(places) and len(second):
            after = np.searchsorted(second, places)
            left = places - second[np.maximum(after - 1, 0)]
            right = second[np.minimum(after, len(second) - 1)] - places
            near = int(((np.abs(left) <= NEAR) | (np.abs(right) <= NEAR)).sum())
        count = len(places)
        return np.array([
            np.log1p(n), 100 * count / n, np.log1p(count), 100 * total[5] / n, x[:, 5].max(),
            np.log1p(len(np.unique(x[places, 5]))), 100 * total[6] / n, np.log1p(total[6]),
            near / max(1, count), 100 * near / n, 100 * total[7] / n, total[1] / max(1.0, total[0]),
            total[4] / n, total[2] / chars, total[3] / chars, 100 * total[8] / n, total[9] / n,
            total[10] / n])


def unit_counts(found: DataFrame) -> DataFrame:
    """(unit, y, half, texts): how many of a sample's texts hold each unit.

    Texts are counted, not occurrences; the counts are made in tasks and summed by Spark.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], Counter] = {}
            for y, text, half in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = {plain(w) for w in text.split()}
                seen.setdefault((y, half), Counter()).update(
                    {u for w in own if w for u in units(w)})
            for (y, half), counts in seen.items():
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(counts.keys(), pa.string()), pa.array([y] * n, pa.int32()),
                     pa.array([half] * n, pa.int32()), pa.array(counts.values(), pa.int64())],
                    names=["unit", "y", "half", "texts"])

    return found.mapInArrow(run, "unit string, y int, half int, texts long").groupBy(
        "unit", "y", "half").agg(F.sum("texts").alias("texts"))


def learn_lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...],
                  size: int = LEXICON) -> dict[str, float]:
    """The units that tell most about toxicity, of those that speak for it, with their log odds.

    What a unit tells is the likelihood ratio of its two-by-two table of texts.
    """
    texts = [sum(sizes.get((y, h), 0) for h in halves) for y in (0, 1)]
    if not all(texts):
        return {}
    by = counts.where(F.col("half").isin(*halves)).groupBy("unit").agg(
        *[F.sum(F.when(F.col("y") == y, F.col("texts")).otherwise(0)).alias(name)
          for y, name in ((1, "toxic"), (0, "other"))])
    toxic, other = F.col("toxic") + 0.5, F.col("other") + 0.5
    odds = F.log(toxic / (texts[1] + 1 - toxic)) - F.log(other / (texts[0] + 1 - other))
    total = float(sum(texts))
    held = F.col("toxic") + F.col("other")

    def share(seen: Column, row: int, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    evidence = 2 * (share(F.col("toxic"), texts[1], held) + share(F.col("other"), texts[0], held)
                    + share(texts[1] - F.col("toxic"), texts[1], total - held)
                    + share(texts[0] - F.col("other"), texts[0], total - held))
    best = by.where(F.col("toxic") >= LEAST_SUPPORT).withColumn("odds", odds).withColumn(
        "evidence", evidence).where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("odds") > 0)
                                    ).orderBy(F.desc("evidence"), "unit").limit(size)
    return {r["unit"]: r["odds"] for r in best.collect()}


class Trees:
    """Gradient-boosted regression trees of a fixed depth for the log loss, split at quantiles."""

    ROUNDS, DEPTH, RATE, LEAST, RIDGE, BINS = 60, 3, 0.15, 5.0, 1.0, 48

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1]))
                      for c in x.T]
        bins = self._bins(x)
        share = np.clip(np.average(y, weights=weights), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[list[tuple[int, int, float]]] = []
        raw = np.full(len(y), self.base)
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(bins, weights * (y - p), weights * p * (1 - p))
            self.trees.append(tree)
            raw += self._values(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, bins, slopes, curves):
        """Nodes in heap order: (feature or -1, last bin to the left, value)."""
        nodes = [(-1, 0, 0.0)] * (2 ** (self.DEPTH + 1) - 1)
        rows_of = {0: np.arange(len(slopes))}
        for node in range(len(nodes)):
            rows = rows_of.pop(node, None)
            if rows is None:
                continue
            g, h = slopes[rows].sum(), curves[rows].sum()
            nodes[node] = (-1, 0, self.RATE * g / (h + self.RIDGE))
            if 2 * node + 2 >= len(nodes):
                continue
            best = (1e-6, None, None)
            for f in range(bins.shape[1]):
                k = len(self.edges[f]) + 1
                if k < 2:
                    continue
                gs = np.cumsum(np.bincount(bins[rows, f], slopes[rows], k))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, f], curves[rows], k))[:-1]
                gain = (gs ** 2 / (hs + self.RIDGE) + (g - gs) ** 2 / (h - hs + self.RIDGE)
                        - g ** 2 / (h + self.RIDGE))
                gain[(hs < self.LEAST * 0.05) | (h - hs < self.LEAST * 0.05)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
            if best[1] is not None:
                left = bins[rows, best[1]] <= best[2]
                nodes[node] = (best[1], best[2], 0.0)
                rows_of[2 * node + 1], rows_of[2 * node + 2] = rows[left], rows[~left]
        return nodes

    @staticmethod
    def _values(tree, bins) -> np.ndarray:
        features = np.array([n[0] for n in tree])
        cuts = np.array([n[1] for n in tree])
        values = np.array([n[2] for n in tree])
        at = np.zeros(len(bins), np.int64)
        for _ in range(Trees.DEPTH):
            f = features[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cuts[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return values[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.base + sum(self._values(t, bins) for t in self.trees)


def isotonic(raw: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing map of least weighted squares, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # weight, mean, first, last
    for v, t, w in zip(raw[order], y[order], weights[order]):
        pools.append([w, t, v, v])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][3] == pools[-1][2]):
            w2, m2, _, last = pools.pop()
            w1, m1, first, _ = pools.pop()
            pools.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), first, last])
    knots = [(p[2], p[1]) for p in pools] + [(p[3], p[1]) for p in pools]
    knots.sort()
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    FOLDS = 4

    def __init__(self, lexicon: dict[str, float], rows: list[np.ndarray], labels: np.ndarray,
                 totals: dict[int, int]):
        self.words = Words(lexicon)
        self.share = float(np.mean(labels)) if len(labels) else 0.0
        self.fitted = 0 < labels.sum() < len(labels)
        if not self.fitted:
            return
        x, y = np.stack(rows), labels.astype(np.float64)
        weights = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
        weights /= weights.mean()
        self.trees = Trees(x, y, weights)
        unseen = self.trees.raw(x)
        fold = np.arange(len(y)) % self.FOLDS
        for k in range(self.FOLDS):
            rest = fold != k
            if 0 < y[rest].sum() < rest.sum():
                unseen[~rest] = Trees(x[rest], y[rest], weights[rest]).raw(x[~rest])
        self.knots, self.shares = isotonic(unseen, y, weights)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.share)
        x = np.stack(list(self.words.features(texts)))
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.shares), 0.0, 1.0)


def fit(df: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
        label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    bounded_batches(df.sparkSession)
    found, totals = sample(df, labels, label, train, key, text, rows)
    found = found.withColumn("half", F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)).cast("int"))
    scratch = Scratch(df.sparkSession, "toxicity")
    counts = scratch.keep(unit_counts(found))
    sizes = {(r["y"], r["half"]): r["count"] for r in found.groupBy("y", "half").count().collect()}
    # The trees see each half of the sample through the lexicon of the other, as texts that the
    # lexicon was not made from; later texts are seen through that of both.
    rows, labels_of = [], []
    for half in (0, 1):
        other = Words(learn_lexicon(counts, sizes, (1 - half,)))
        x, y = gathered(found.where(F.col("half") == half), other.features, "float64")
        rows += x
        labels_of.append(y)
    return Model(learn_lexicon(counts, sizes, (0, 1)), rows, np.concatenate(labels_of), totals)


def scores(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row of ``df``."""
    spark = df.sparkSession
    bounded_batches(spark)
    sent = Sent(spark, model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.model()
        for batch in batches:
            body = batch.column(1)
            made = [own.scores(body.slice(a, b - a).to_pylist()) for a, b in text_slices(body)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(made) if made else np.zeros(0))],
                names=["key", "score"])

    return df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).mapInArrow(
        run, f"key {kind}, score double").withColumnRenamed("key", key)


@query("op5_boosted_toxicity")
def op5_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return scores(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
