"""Quality scores by a support vector machine on naive Bayes features.

Features are indicators of n-grams: character trigrams of the text, and one, two and three in a row
of word shapes (case, digits, symbols, repeats the word before it), hashed to 2^16 places.  Each
indicator is scaled by the log ratio of its smoothed counts in the two classes, texts are brought to
unit length, and a linear hinge-loss model is fitted by dual coordinate descent.  Margins of rows
that the model has not seen give a sigmoid for the score.

The model is fitted on at most ``labelled.FIT_ROWS`` labelled rows; its weights have a fixed size and
go to the tasks, which read every text whole.

Defined results: null and empty texts have no features and get the score of the model's bias.  With
no labelled rows, or of one class only, the score is that class's share (0.5 for none).  Repeated
rows each get their row.  Columns other than the key and the text are left out by ``scores``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Sent, bounded_batches, remainder, table, text_slices, whole
from shelfline.llm.labelled import FIT_ROWS, gathered, sample
from shelfline.llm.registry import query

PLACES = 1 << 16
# Loss weight, smoothing of the counts, passes of the coordinate descent.
COST, SMOOTHING, PASSES = 1.0, 1.0, 30
THRESHOLD = 0.7
SYMBOLS = re.compile(r"[^\w\s]+")


def shape(word: str) -> int:
    """One of 60 shapes: case, digits, symbols at the end or inside."""
    letters = [c for c in word if c.isalpha()]
    if not letters:
        case = 0
    elif word == word.lower():
        case = 1
    elif len(letters) > 1 and word == word.upper():
        case = 2
    elif word[1:] == word[1:].lower():
        case = 3
    else:
        case = 4
    marks = SYMBOLS.findall(word)
    if not marks:
        mark = 0
    elif len(marks) == 1 and len(marks[0]) == 1 and word[-1] in ".,;:":
        mark = 1
    else:
        mark = 2
    return (case * 3 + mark) * 2 + any(c.isdigit() for c in word)


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """The places of each text's indicators, in order and without repeats."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    words: list[bytes] = []
    sizes = []
    for d in data:
        own = d.split()
        words += own
        sizes.append(len(own))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    shapes = np.array([shape(w.decode("utf-8", "replace")) for w in coded.dictionary.to_pylist()],
                      np.uint32)
    mark = np.zeros(PLACES, bool)
    at = 0
    for d, n in zip(data, sizes):
        raw = np.frombuffer(d, np.uint8).astype(np.uint32)
        if len(raw) > 2:
            grams = (raw[:-2] * 65599 + raw[1:-1]) * 65599 + raw[2:]
            mark[(grams * np.uint32(2654435761)) >> np.uint32(16)] = True
        if n:
            own = place[at:at + n]
            seen = shapes[own] * 2 + 1
            seen[1:] += own[1:] == own[:-1]
            two, three = seen[:-1] * 64 + seen[1:], seen[:-2] * 4096 + seen[1:-1] * 64 + seen[2:]
            for level, grams in ((1, seen), (2, two), (3, three)):
                mark[((grams + np.uint32(level << 20)) * np.uint32(2246822519)) >> np.uint32(16)
                     ] = True
        at += n
        found = np.flatnonzero(mark)
        mark[found] = False
        yield found.astype(np.int32)


class Model:
    """Scaled weights by place, bias, and the sigmoid of the margins."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, totals: dict[int, int]):
        self.share = float(np.mean(labels)) if len(labels) else 0.5
        self.fitted = 0 < labels.sum() < len(labels)
        if not self.fitted:
            return
        signs = np.where(labels == 1, 1.0, -1.0)
        # One row in five is kept aside for the sigmoid where both classes are left in the rest.
        aside = np.arange(len(rows)) % 5 == 4
        if len(set(signs[~aside])) < 2 or len(set(signs[aside])) < 2:
            aside = np.zeros(len(rows), bool)
        fit = np.flatnonzero(~aside)
        self.ratios = self.log_ratios([rows[i] for i in fit], signs[fit])
        self.weights, self.bias = self.descend([rows[i] for i in fit], signs[fit])
        calibrate = np.flatnonzero(aside) if aside.any() else fit
        margins = np.array([self.margin(rows[i]) for i in calibrate])
        self.slope, self.shift = sigmoid_fit(margins, signs[calibrate])
        # The sample has the classes in other shares than the labelled rows as a whole.
        self.shift += float(np.log(totals[1] / (labels == 1).sum())
                            - np.log(totals[0] / (labels == 0).sum()))
        self.scaled = (self.weights * self.ratios).astype(np.float64)
        self.squares = self.ratios ** 2

    @staticmethod
    def log_ratios(rows: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
        counts = np.full((2, PLACES), SMOOTHING)
        for row, sign in zip(rows, signs):
            counts[int(sign > 0), row] += 1
        return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def descend(self, rows: list[np.ndarray], signs: np.ndarray) -> tuple[np.ndarray, float]:
        """Dual coordinate descent for the hinge loss; the bias is a constant feature of one."""
        weights, bias = np.zeros(PLACES), 0.0
        values = []
        for row in rows:
            x = self.ratios[row]
            values.append(x / (np.sqrt(x @ x) or 1.0))
        norms = np.array([x @ x + 1.0 for x in values])
        share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
        most = COST * 0.5 / share  # classes weigh alike
        alpha = np.zeros(len(rows))
        random = np.random.default_rng(7)
        for _ in range(PASSES):
            moved = 0.0
            for i in random.permutation(len(rows)):
                row, x, y = rows[i], values[i], signs[i]
                slope = y * (weights[row] @ x + bias) - 1.0
                new = min(max(alpha[i] - slope / norms[i], 0.0), most[i])
                step = (new - alpha[i]) * y
                if step:
                    weights[row] += step * x
                    bias += step
                    alpha[i] = new
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        return weights, bias

    def margin(self, row: np.ndarray) -> float:
        x = self.ratios[row]
        return float(self.weights[row] @ x / (np.sqrt(x @ x) or 1.0) + self.bias)

    def score(self, row: np.ndarray) -> float:
        if not self.fitted:
            return self.share
        length = np.sqrt(self.squares[row].sum()) or 1.0
        return float(squash(self.slope * (self.scaled[row].sum() / length + self.bias)
                            + self.shift))


def squash(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def sigmoid_fit(margins: np.ndarray, signs: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid of least log loss, with smoothed targets; by Newton steps."""
    good, bad = (signs > 0).sum(), (signs < 0).sum()
    targets = np.where(signs > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(100):
        p = squash(slope * margins + shift)
        gradient = x @ (p - targets) + np.array([1e-6 * slope, 0.0])
        curve = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        size = np.abs(step).max()
        if size > 5:
            step *= 5 / size
        slope, shift = slope - step[0], shift - step[1]
        if size < 1e-8:
            break
    return float(max(slope, 0.0)), float(shift)


def fit(df: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
        label: str = "quality", rows: int = FIT_ROWS) -> Model:
    found, totals = sample(df, labels, label, train, key, text, rows)
    return Model(*gathered(found, features, "int32"), totals)


def scores(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row of ``df``."""
    spark = df.sparkSession
    bounded_batches(spark)
    sent = Sent(spark, model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.model()
        for batch in batches:
            body, made = batch.column(1), []
            for a, b in text_slices(body):
                made += [own.score(x) for x in features(body.slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())],
                                             names=["key", "score"])

    return df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).mapInArrow(
        run, f"key {kind}, score double").withColumnRenamed("key", key)


def accepted(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD
             ) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``, with all their columns."""
    spark = df.sparkSession
    bounded_batches(spark)
    sent = Sent(spark, model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.model()
        for batch in batches:
            body, keep = pa.compute.fill_null(batch.column(at), ""), []
            for a, b in text_slices(body):
                keep += [own.score(x) >= threshold
                         for x in features(body.slice(a, b - a).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


@query("op2_nbsvm_quality")
def op2_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept_out = remainder("doc_id", 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels"), ~kept_out)
    return scores(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
