"""Language identification by the nearest of several centroids per language.

A text is lower-cased, ASCII characters that are no letters become spaces, and its byte n-grams of
two, three and four are counted in 2^13 hashed places.  Vectors are (1 + log count) times inverse
document frequency, brought to unit length.  Each language's training vectors are clustered by
spherical k-means; a text goes to the language of the centroid of largest cosine, which is its
score.  A text farther from its centroid than nearly all that centroid's own is marked rejected.

Fitted on at most ``FIT_ROWS`` rows: of each language a share of its rows, chosen by key hash, that
is ``FIT_ROWS`` over the number of languages in expectation.  The centroids' number and size are
fixed by the parameters, so they go to the tasks, which read every text whole.

Defined results: null texts and texts without a letter get ``und`` and score 0; so does every text
if nothing could be learned.  Equal cosines go to the alphabetically first language.  Repeated rows
each get their row.  Columns other than key, text and language are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Sent, bounded_batches, remainder, table, text_slices, whole
from shelfline.llm.registry import query

PLACES = 1 << 13
CENTROIDS = 3
FIT_ROWS = 3000
# A centroid rejects what is farther than all but this share of its training texts.
REJECTED_SHARE = 0.01
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
KEPT = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Counts of the byte n-grams, by hashed place."""
    data = b" %b " % text.lower().encode("utf-8", "surrogatepass").translate(KEPT)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(PLACES, np.int64)
    grams = raw[:-1] * 257 + raw[1:]
    for n in (2, 3, 4):
        out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(19), minlength=PLACES)
        if n < 4:
            grams = grams[:-1] * 257 + raw[n:]
            if not len(grams):
                break
    return out


class Model:
    def __init__(self, rows: Iterator[tuple[np.ndarray, np.ndarray]], languages: list[str]):
        """``rows`` has (places, counts) of each training text."""
        self.languages: list[str] = []
        if not languages:
            return
        unit = np.zeros((len(languages), PLACES), np.float32)
        for own, (places, count) in zip(unit, rows):
            own[places] = count
        self.idf = np.log((1 + len(unit)) / (1 + (unit > 0).sum(axis=0))).astype(np.float32) + 1
        for own in unit:
            own[:] = self.vector(own)
        names, centroids, floors = np.array(languages), [], []
        for name in sorted(set(languages)):
            own = unit[names == name]
            for centroid, members in clusters(own, CENTROIDS):
                self.languages.append(name)
                centroids.append(centroid)
                floors.append(np.quantile(members @ centroid, REJECTED_SHARE))
        self.centroids, self.floors = np.stack(centroids), np.array(floors)

    def vector(self, row: np.ndarray) -> np.ndarray:
        x = np.zeros(PLACES, np.float32)
        hit = np.flatnonzero(row)
        x[hit] = (1 + np.log(row[hit])) * self.idf[hit]
        return x / (np.linalg.norm(x) or 1.0)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        if not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(counts(text))
        best = int(near.argmax())
        return (self.languages[best], float(min(max(near[best], 0.0), 1.0)),
                bool(near[best] < self.floors[best]))


def clusters(unit: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centroid, members) by spherical k-means, begun at rows far from each other."""
    picked = [int((unit @ unit.mean(axis=0)).argmax())]
    while len(picked) < min(k, len(unit)):
        picked.append(int((unit @ unit[picked].T).max(axis=1).argmin()))
    centres = unit[picked]
    own = None
    for _ in range(25):
        new = (unit @ centres.T).argmax(axis=1)
        if own is not None and (new == own).all():
            break
        own = new
        sums = np.stack([unit[own == i].sum(axis=0) for i in range(len(centres))])
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-12), centres)
    return [(c, unit[own == i]) for i, c in enumerate(centres) if (own == i).any()]


def fit(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        rows: int = FIT_ROWS) -> Model:
    spark = df.sparkSession
    bounded_batches(spark)
    known = df.where(train).where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("name"),
        whole(text).alias("body")).where("name is not null")
    # One row per language.
    sizes = {r[0]: r[1] for r in known.groupBy("name").count().collect()}
    if not sizes:
        return Model(iter(()), [])
    shares = spark.createDataFrame([(n, float(max(1, rows // len(sizes)) / c))
                                    for n, c in sizes.items()], "name string, share double")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(shares), "name").where(place < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(2)
            for a, b in text_slices(body, 1 << 19):
                dense = [counts(t) for t in body.slice(a, b - a).to_pylist()]
                places = [np.flatnonzero(x).astype(np.int32) for x in dense]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(places, pa.list_(pa.int32())),
                     pa.array([x[p].astype(np.int32) for x, p in zip(dense, places)],
                              pa.list_(pa.int32()))], names=["key", "name", "places", "counts"])

    kind = df.schema[key].dataType.simpleString()
    got = chosen.select("key", "name", "body").mapInArrow(
        run, f"key {kind}, name string, places array<int>, counts array<int>").toArrow()
    got = got.sort_by([("key", "ascending"), ("name", "ascending")])
    rows_of = zip(got.column("places"), got.column("counts"))
    return Model(((p.values.to_numpy(), c.values.to_numpy()) for p, c in rows_of),
                 got.column("name").to_pylist())


def predictions(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) for every row of ``df``."""
    spark = df.sparkSession
    bounded_batches(spark)
    sent = Sent(spark, model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.model()
        for batch in batches:
            made = [own.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64()),
                 pa.array([m[2] for m in made], pa.bool_())],
                names=["key", "lang_pred", "score", "rejected"])

    return df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).mapInArrow(
        run, f"key {kind}, lang_pred string, score double, rejected boolean"
    ).withColumnRenamed("key", key)


@query("op10_centroid_language")
def op10_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 4) != 2)
    return predictions(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
