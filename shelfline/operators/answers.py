"""A log of a model's answers that outlives the job that asked.

Every task asks its requests in pieces and writes each piece's answers to the log before it asks the next,
as one file under a name made of the piece's requests.  What was paid for is there whatever happens to
the task, the executor, the job or the driver; a task that runs again finds its pieces and does not ask
them again, and a later call asks only requests the log has no reply to.

The log only grows, until ``compact`` writes what it holds as one table and drops the files it has read.
A request counts once: with its reply, or, where all calls failed, with the error.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.sources import files

PIECE = 50
_ANSWER = pa.schema([("key", pa.int64()), ("request", pa.string()), ("reply", pa.string()),
                     ("error", pa.string())])
_DDL = "key long, request string, reply string, error string"


def _listed(spark: SparkSession, folder: str, part: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return [s.getPath().toString() for s in system.listStatus(path)]


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """``key, request, reply, error``: one row for every request of the log.

    A reply goes before errors of other runs; of several replies the smallest text.
    """
    # A table counts once it is whole; pieces are whole as soon as they have their name.
    tables = [t for t in _listed(spark, folder, "tables") if _listed(spark, t, "_SUCCESS")]
    kept = [*tables, *[p for p in _listed(spark, folder, "pieces") if p.endswith(".parquet")]]
    if not kept:
        return spark.createDataFrame([], _DDL)
    read = spark.read.schema(_DDL).parquet(*tables) if tables else None
    if len(kept) > len(tables):
        pieces = spark.read.schema(_DDL).parquet(f"{folder}/pieces")
        read = pieces if read is None else read.unionByName(pieces)
    single = read.groupBy("key", "request").agg(F.min("reply").alias("reply"), F.max("error").alias("error"))
    return single.withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))


def ask(requests: DataFrame, folder: str, ask_one: Callable[[str], tuple[str | None, str | None]],
        tasks: int | None = None, piece: int = PIECE) -> int:
    """Ask what the log has no reply to, and return how many requests that were.

    ``requests`` has a column ``request``; repeated requests are asked once.  ``tasks`` is how many are
    asked at once.  An exception of ``ask_one`` ends the job; the pieces before it stay.
    """
    spark = requests.sparkSession
    known = answers(spark, folder).where("reply is not null").select("key", "request")
    todo = requests.select(F.xxhash64("request").alias("key"), "request").where(
        "request is not null").distinct().join(known, ["key", "request"], "left_anti")
    todo = todo.repartition(tasks, "key") if tasks else todo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        asked = 0

        def commit() -> None:
            # Requests that failed are asked again by a later call, so what is known is part of the name.
            name = sha256("\n".join(r for _, r in held).encode("utf-8", "surrogatepass")).hexdigest()
            path = f"{folder}/pieces/{name}.parquet"
            if files.exists(path) and not files.holds_null(path, "reply"):
                return
            said = [ask_one(r) for _, r in held]
            out = io.BytesIO()
            pq.write_table(pa.Table.from_arrays(
                [pa.array([k for k, _ in held], pa.int64()), pa.array([r for _, r in held], pa.string()),
                 pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.string())],
                schema=_ANSWER), out)
            files.commit_file(path, out.getvalue())

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == piece:
                    commit()
                    asked, held = asked + len(held), []
        if held:
            commit()
            asked += len(held)
        yield pa.RecordBatch.from_arrays([pa.array([asked])], names=["asked"])

    return todo.sortWithinPartitions("key", "request").mapInArrow(run, "asked long").agg(
        F.coalesce(F.sum("asked"), F.lit(0))).first()[0]


def compact(spark: SparkSession, folder: str) -> int:
    """Write the log as one table and drop the files it was read from; return how many went.

    The table counts once it is written; files are dropped after that, so a broken compaction loses
    nothing, and files that came in meanwhile stay.
    """
    before = _listed(spark, folder, "tables") + _listed(spark, folder, "pieces")
    if not before:
        return 0
    answers(spark, folder).write.parquet(f"{folder}/tables/{uuid.uuid4().hex}")
    hadoop = spark._jsc.hadoopConfiguration()
    for name in before:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
    return len(before)
