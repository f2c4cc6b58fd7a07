"""SimHash near-duplicates: 64-bit fingerprints, joined on blocks, verified by Hamming distance.

Two fingerprints that differ in at most three of 64 bits agree on at least two of five blocks, so
every such pair meets under one of ten keys made of two blocks each (25 or 26 bits).  Equal
fingerprints are collapsed before that.  Rows that meet are compared exactly and give a spanning
forest, never all their pairs; a key with many fingerprints is dealt out to pairs of chunks, each of
which is a group of bounded size.  Components are found by contraction.

Defined results: a null text is an empty text; a text without words has fingerprint 0 and is linked
like any other.  Repeated rows each get their row.  Null keys get a fingerprint and a component, but
do not name one.  Columns other than the key and the text are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shelfline.llm.common import Scratch, bounded_batches, shuffle_width, table, whole
from shelfline.llm.components import components
from shelfline.llm.registry import query

SEED = 42
BITS = 64
# Shingles hashed at a time, and fingerprints compared at a time in a hot block group.
PIECE, CHUNK = 1 << 15, 4096


def simhash(text: str, words: int = 3) -> int:
    """The majority bits of the shingles' hashes; 0 without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(
            first[at:at + PIECE], last[at:at + PIECE])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): one row per row of ``df``, fp as a signed long."""
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((simhash(x.as_py(), words) for x in batch.column(1)), np.uint64,
                               batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))],
                                             names=["key", "fp"])

    return df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).mapInArrow(
        run, f"key {kind}, fp long")


def block_masks(distance: int) -> list[int]:
    """Masks such that fingerprints within ``distance`` bits agree under at least one of them."""
    blocks = distance + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its component) by search; each is compared once as a frontier."""
    rest, out = np.sort(fps), []
    while len(rest) > 1:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            batch, frontier = frontier[:256], frontier[256:]
            near = (np.bitwise_count(batch[:, None] ^ rest[None, :]) <= distance).any(axis=0)
            if near.any():
                hit = rest[near]
                out.extend((int(x), int(root)) for x in hit)
                frontier, rest = np.concatenate([frontier, hit]), rest[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Forests of the groups in rows sorted by group; only one group is held at a time."""
    held = [np.zeros(0, np.int64)] * 4

    def groups(cols: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        return _links_of(cols, distance)

    def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()),
                                           pa.array([e[1] for e in edges], pa.int64())],
                                          names=["u", "v"])

    for batch in batches:
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)])
                for h, c in zip(held, batch.columns)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0
        done, held = [c[:cut] for c in cols], [c[cut:] for c in cols]
        if cut and (edges := list(groups(done))):
            yield batch_of(edges)
    if len(held[0]) and (edges := list(groups(held))):
        yield batch_of(edges)


def _links_of(cols: list[np.ndarray], distance: int) -> Iterator[tuple[int, int]]:
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
    bounds = np.concatenate([[0], new, [len(cols[0])]])
    sizes, fps = np.diff(bounds), cols[3].view(np.uint64)
    twos = bounds[:-1][sizes == 2]
    if len(twos):
        a, b = fps[twos], fps[twos + 1]
        near = np.bitwise_count(a ^ b) <= distance
        yield from zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist())
    for at, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        for u, root in forest(fps[at:at + n], distance):
            yield _signed(u), _signed(root)


def near_links(distinct: DataFrame, scratch: Scratch, distance: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links that connect exactly what pairs within ``distance`` bits connect.

    ``distinct`` has the distinct fingerprints in ``fp``.
    """
    spark = distinct.sparkSession
    masks = [_signed(m) for m in block_masks(distance)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "block"))
    # Keys of one fingerprint link nothing; counts are combined before they are shuffled.
    shared = scratch.keep(keyed.groupBy("t", "block").agg(F.count("*").alias("n")).where("n > 1"))
    many = keyed.join(shared, ["t", "block"]).withColumn(
        "chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn(
        "own", F.pmod(F.hash("fp", "t"), F.col("chunks")))
    # Every pair of chunks of a hot key is a group of its own.
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))))
    dealt = many.withColumn("other", other).select(
        "t", "block", (F.least("own", "other").cast("long") * (1 << 31)
                       + F.greatest("own", "other")).alias("pair"), "fp")
    return dealt.repartition(shuffle_width(spark), "t", "block", "pair").sortWithinPartitions(
        "t", "block", "pair", "fp").mapInArrow(lambda b: _links(b, distance), "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3,
                    distance: int = 3) -> DataFrame:
    """(key, fp, component_id) for every row: its fingerprint and the smallest key it is linked to."""
    scratch = Scratch(df.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(df, key, text, words))
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("key").alias("rep")))
    return component_ids(fps, reps, near_links(reps, scratch, distance), scratch, key)


def component_ids(fps: DataFrame, reps: DataFrame, links: DataFrame, scratch: Scratch, key: str
                  ) -> DataFrame:
    """(key, fp, component_id) of the rows ``fps`` (key, fp); ``reps`` has the smallest key by fp."""
    roots = components(links, scratch).withColumnRenamed("node", "fp")
    linked = scratch.keep(roots.join(reps, "fp"))
    firsts = scratch.keep(linked.groupBy("root").agg(F.min("rep").alias("first")))
    firsts = linked.join(firsts, "root").select("fp", "first")
    named = scratch.keep(reps.join(firsts, "fp", "left").select(
        "fp", F.coalesce("first", "rep").alias("component_id")))
    return fps.join(named, "fp", "left").select(F.col("key").alias(key), "fp", "component_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3,
                 distance: int = 3) -> DataFrame:
    """The rows of ``df`` of which one stays for each component; see ``one_of_each``."""
    return one_of_each(df, key, text, partial(near_duplicates, words=words, distance=distance))


def one_of_each(df: DataFrame, key: str, text: str, near: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``df`` of which one stays for each component that ``near`` finds, all columns.

    The row of smallest key stays, of equal keys that of smallest text hash, of equal rows one.
    """
    names = df.columns
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(
        F.col(f"`{key}`").alias("key"), F.xxhash64(whole(text)).alias("hash")).alias("mark"),
        whole(text).alias("body"))
    kept = near(marked, "mark", "body").select(
        F.col("component_id.key").alias("k"), F.col("component_id.hash").alias("h")).distinct()
    return marked.select("row", F.col("mark.key").alias("key"), F.col("mark.hash").alias("hash")).join(
        kept, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left_semi"
    ).groupBy("key", "hash").agg(F.first("row").alias("row")).select(
        *[F.col("row")[c].alias(c) for c in names])


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
