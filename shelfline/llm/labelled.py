"""Bounded, reproducible samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import text_slices, whole

# Labelled rows that a classifier is fitted on, at most; half of each class where both have enough.
FIT_ROWS = 8000


def sample(df: DataFrame, labels: DataFrame, label: str, train: Column, key: str = "doc_id",
           text: str = "text", rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(key, y, body) of at most ``rows`` labelled training rows, and how many there are by label.

    Of each class, the ``rows``/2 keys of smallest hash.  A key labelled more than once counts with
    the larger label; null keys, null labels and labels without a document are left out.  A key with
    several texts counts with the first of them in order.
    """
    half = rows // 2
    marks = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias(
        "y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    present = marks.join(df.where(train).select(F.col(f"`{key}`").alias("key")).distinct(), "key",
                         "left_semi")
    totals = {r["y"]: r["count"] for r in present.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        own = present.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(half)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most ``rows`` keys, so broadcasting them is bounded.
    found = df.where(train).select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).join(
        F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min("body").alias("body"))
    return found, totals


def gathered(found: DataFrame, vectors: Callable[[list[str]], Iterator[np.ndarray]], kind: str
             ) -> tuple[list[np.ndarray], np.ndarray]:
    """(vector, label) of every row of a sample, in the order of the keys.

    The vectors are made in tasks, so what reaches the driver is bounded by their length, not by
    that of the texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(2)
            for a, b in text_slices(body):
                made = list(vectors(body.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(made, pa.list_(pa.type_for_alias(kind)))], names=["key", "y", "x"])

    spark_kind = {"int32": "int", "float32": "float", "float64": "double"}[kind]
    rows = found.mapInArrow(run, f"key {found.schema['key'].dataType.simpleString()}, y int, "
                            f"x array<{spark_kind}>").toArrow().sort_by("key")
    vectors_out = [x.values.to_numpy() for x in rows.column("x")]
    return vectors_out, rows.column("y").to_numpy()
