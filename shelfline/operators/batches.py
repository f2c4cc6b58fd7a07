"""Rows to model batches and answers back to rows.

The model itself is the caller's ``Callable[[list[str]], list[str]]``: requests in, replies out.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import fixed_values as fv
from shelfline.operators import answers as answer_log

_SPAN_BITS = 12


def with_ordinal(df: DataFrame, row_id: str = "row_id", into: str = "ordinal") -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``row_id`` order (unique, not negative).

    A null or negative id is an error when the plan runs.

    Ids fall into spans of 4096.  A row's number is its place in its span plus the rows of all
    earlier spans, and the counts of spans are summed the same way one level up, so no window ever
    holds more than 4096 rows, whether the ids are dense or hashed.  There are as many levels as the
    largest id needs, one for ids below 2**24, so that id is asked for first.  The rows are shuffled
    once, by span; no sort of the whole, no sampling.  The sums of the last level leave one task, so
    they go to the rows by merge: sent to them, the rows would all follow in that task.
    """
    most = df.agg(F.max(row_id)).first()[0] or 0
    levels = max(1, -(-most.bit_length() // _SPAN_BITS) - 1)
    span = lambda level: F.shiftright(F.col(row_id), _SPAN_BITS * level)
    bad = F.col(row_id).isNull() | (F.col(row_id) < 0)
    keyed = df.withColumn(row_id, F.when(bad, F.raise_error(F.lit(
        f"{row_id} must be neither null nor negative"))).otherwise(F.col(row_id))).withColumn(
        "_s1", span(1))
    counts = keyed.groupBy("_s1").agg(F.count("*").alias("_n"))

    def before(counted: DataFrame, level: int) -> DataFrame:
        """``_s{level}`` with the number of rows in all earlier spans of that level."""
        me, up = f"_s{level}", f"_s{level + 1}"
        if level == levels:
            earlier = W.partitionBy(F.lit(0)).orderBy(me).rowsBetween(W.unboundedPreceding, -1)
            return counted.select(me, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"))
        lifted = counted.withColumn(up, F.shiftright(F.col(me), _SPAN_BITS))
        above = before(lifted.groupBy(up).agg(F.sum("_n").alias("_n")), level + 1)
        earlier = W.partitionBy(up).orderBy(me).rowsBetween(W.unboundedPreceding, -1)
        inside = lifted.select(me, up, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_i"))
        return (inside.join(above.withColumnRenamed("_b", "_a").hint("merge"), up)
                .select(me, (F.col("_i") + F.col("_a")).alias("_b")))

    place = F.row_number().over(W.partitionBy("_s1").orderBy(row_id)) - 1
    return (keyed.withColumn("_p", place).join(before(counts, 1).hint("merge"), "_s1")
            .select(*df.columns, (F.col("_p") + F.col("_b")).cast("bigint").alias(into)))


def assemble(df: DataFrame, item: Column, size: int, row_id: str = "row_id",
             limit: int | None = None) -> DataFrame:
    """Batches of ``size`` rows, contiguous in id order: ``batch_no, items``.

    ``items`` holds (row_id, item) in order.  ``limit`` keeps only the first rows, as a caller's
    trial run asks for.
    """
    if limit is not None and limit > 0:
        df = df.orderBy(row_id).limit(limit)
    numbered = with_ordinal(df.select(F.col(row_id).alias("row_id"), item.alias("item")))
    return (numbered.groupBy(F.floor(F.col("ordinal") / size).cast("bigint").alias("batch_no"))
            .agg(F.array_sort(F.collect_list(F.struct("ordinal", "row_id", "item")))
                 .alias("_rows"))
            .select("batch_no", F.transform("_rows", lambda r: F.struct(
                r["row_id"].alias("row_id"), r["item"].alias("item"))).alias("items")))


def quota_error(error: Exception) -> bool:
    text = str(error).lower()
    return "429" in text or "quota" in text or "resource" in text


def holds_object(reply: str) -> bool:
    """Does a reply hold a JSON object between its first and last brace."""
    try:
        return isinstance(json.loads(reply[reply.index("{"):reply.rindex("}") + 1]), dict)
    except ValueError:
        return False


def holds_pairs(reply: str) -> bool:
    """Does a reply hold at least one pair of an id and a text, whole object or not."""
    return holds_object(reply) or re.search(r'"\d+"\s*:\s*"', reply) is not None


def call_model(batches: DataFrame, model: Callable[[list[str]], list[str]],
               request: str = "request", reply: str = "reply", error: str = "call_error",
               attempts: int = fv.MAX_ATTEMPTS, pause: float = 1.0,
               parallelism: int | None = None, readable: Callable[[str], bool] | None = None,
               store: str | None = None) -> DataFrame:
    """Add the model's reply to each row, or the error of its last attempt.

    Rows go out one request at a time per task, so ``parallelism`` tasks are the number of calls
    under way at once.  Quota and resource errors, empty replies and, where ``readable`` is given,
    replies it refuses are tried again, after a growing pause; the last unreadable reply stands.

    The answers are a plan: each action asks again.  With ``store``, a folder that all executors
    reach, the requests it has no reply to are asked once and written there piece by piece (see
    ``answers``), and the result reads what is written; a later call with the same folder asks only what
    is missing, also after a call that broke off.
    """
    ask = _asker(model, attempts, pause, readable)
    if store:
        return _stored(batches, store, request, reply, error, ask, parallelism)
    if parallelism:
        batches = batches.repartition(parallelism)
    schema = T.StructType(batches.schema.fields + [
        T.StructField(reply, T.StringType()), T.StructField(error, T.StringType())])

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            answers = [ask(text) for text in piece.column(request).to_pylist()]
            # The other columns go through as they are.
            said = [pa.array([a[i] for a in answers], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*piece.columns, *said], names=[*piece.schema.names, reply, error])

    return batches.mapInArrow(run, schema)


def _asker(model: Callable[[list[str]], list[str]], attempts: int, pause: float,
           readable: Callable[[str], bool] | None) -> Callable[[str], tuple[str | None, str | None]]:
    """One request to (reply, error), with retries."""
    def ask(text: str) -> tuple[str | None, str | None]:
        problem, last = "empty reply", None
        for attempt in range(attempts):
            try:
                answer = model([text])[0]
                if answer:
                    last = answer
                    if readable is None or readable(answer):
                        return answer, None
                problem = "empty reply"
            except Exception as failure:
                problem = str(failure)[:150]
                if not quota_error(failure):
                    break
            if attempt + 1 < attempts:
                time.sleep(pause * (attempt + 1))
        return (last, None) if last else (None, problem)

    return ask


def _stored(batches: DataFrame, store: str, request: str, reply: str, error: str, ask,
            parallelism: int | None) -> DataFrame:
    """Replies by request from a log, after asking for those it lacks."""
    answer_log.ask(batches.select(F.col(f"`{request}`").alias("request")), store, ask, parallelism)
    known = answer_log.answers(batches.sparkSession, store).select(
        F.col("key").alias("_key"), F.col("request").alias("_request"), F.col("reply").alias("_reply"),
        F.col("error").alias("_error"))
    asked = F.col(f"`{request}`")
    return batches.join(known, (F.xxhash64(asked) == F.col("_key")) & (asked == F.col("_request")),
                        "left").select(*[F.col(f"`{c}`") for c in batches.columns],
                                       F.col("_reply").alias(reply), F.col("_error").alias(error))


def apply_answers(df: DataFrame, answers: DataFrame, column: str, row_id: str = "row_id"
                  ) -> DataFrame:
    """Overwrite ``column`` where there is an answer (``row_id, answer``); keep it elsewhere.

    One answer per row id: a reply repeating an id is settled by its smallest text.
    """
    single = answers.groupBy(F.col("row_id").alias("_id")).agg(F.min("answer").alias("_answer"))
    joined = df.join(single, F.col(row_id) == F.col("_id"), "left")
    return joined.select(*[F.coalesce("_answer", column).alias(column) if c == column else F.col(
        f"`{c}`") for c in df.columns])
