"""Session settings and the two helpers that look at the cluster: shared folder, broadcast bound."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table this library broadcasts; anything above joins by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def build_session(name: str = "shelfline", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; pass ``master`` only for local runs and tests."""
    builder = (SparkSession.builder.appName(name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
                "spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if folder:
        return folder
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="shelfline-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, where a plan needs it more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Share of the rows beyond which a join key is joined apart; there are at most 1 / HEAVY such keys.
HEAVY = 0.001


def join_past_heavy(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str],
                    condition: Column | None = None) -> DataFrame:
    """Inner join where some keys of ``left`` may hold a large share of its rows.

    A sketch of bounded size finds the keys beyond HEAVY of the rows (and maybe some others).  Their rows
    of ``right`` are broadcast, so their rows of ``left`` stay where they are; all other rows are
    shuffled.  ``left`` is read twice.  Rows with a null key join nothing.
    """
    mine, theirs = F.xxhash64(*left_on), F.xxhash64(*right_on)
    heavy = left.select(mine.alias("key")).stat.freqItems(["key"], HEAVY).first()
    keys = heavy["key_freqItems"] if heavy else []
    same = None
    for a, b in zip(left_on, right_on):
        equal = F.col(a) == F.col(b)
        same = equal if same is None else same & equal
    same = same if condition is None else same & condition
    apart = left.where(mine.isin(keys)).join(broadcast_within(right.where(theirs.isin(keys))), same)
    return apart.unionByName(left.where(~mine.isin(keys)).join(right.where(~theirs.isin(keys)), same))


def broadcast_within(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it stays within ``rows``.

    The count stops at the bound.  A larger table is returned as it is, and its join then shuffles.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df
