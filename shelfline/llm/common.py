"""What the corpus operators share: tables, null texts, splits, scratch tables, Arrow batches."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import shared_folder

# Rows and bytes that one Arrow batch holds, so that long texts cannot fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key's decimal text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % parts


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; a session that has set smaller bounds keeps them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(spark.conf.get(key))
        except (TypeError, ValueError):
            now = 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Sent:
    """A fitted model broadcast with its code, so that workers need no install to read it."""

    def __init__(self, spark: SparkSession, model):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def model(self):
        """In a task: the model, built once a call."""
        return pickle.loads(self.held.value)


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def text_slices(column: pa.ChunkedArray | pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each; one longer text is a range of its own."""
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield start, len(lengths)
