"""Near copies by shared word shingles, and by SimHash where a distance is given.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or
more: min-hash bands name candidates, an exact check decides.  With a ``distance``, they also are if their
SimHash fingerprints lie within so many bits, found and linked as ``simhash`` does; both kinds of links
make one set of components.  Words are split and lower-cased as ``simhash`` does.  Texts of equal words
are collapsed first.
A pair of similarity s meets in some band with probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8;
bands of equal members are one bucket.  In a bucket shingle sets are compared exactly, and give a
spanning forest; a bucket of many texts is dealt out to pairs of chunks, as ``simhash`` deals hot keys.

Defined results: a null text is an empty text.  A text of fewer than five words is one shingle, so it
is linked by shingles to texts of the same words only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shelfline.llm.common import Scratch, bounded_batches, shuffle_width, whole
from shelfline.llm.simhash import SEED, component_ids, near_links, one_of_each, simhash

WORDS, LEAST = 5, 0.8
# Words of a fingerprint's shingles, as of ``op4_simhash``.
PRINT_WORDS = 3
BANDS, ROWS = 24, 5
# Texts of a bucket compared in one group are twice as many at most; shingles min-hashed at a time.
CHUNK, PIECE = 512, 2048
KNOWN = 1 << 18

_random = np.random.default_rng(SEED)
MIX, FACTORS, FOLD = (_random.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                      for n in (64, BANDS * ROWS, ROWS))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], words: int, known: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of all runs of ``words`` words, sorted; ``known`` caches word hashes."""
    if len(known) > KNOWN:
        known.clear()
    for w in tokens:
        if w not in known:
            known[w] = xxh64_intdigest(w, SEED)
    each = np.fromiter((known[w] for w in tokens), np.uint64, len(tokens))
    n = len(tokens) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += each[k:k + n] * MIX[k]
    return np.unique(mixed(total))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value for each band of min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PIECE):
        np.minimum(least, (hashes[at:at + PIECE, None] * FACTORS).min(axis=0), out=least)
    return mixed((mixed(least).reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketches(df: DataFrame, key: str, text: str, words: int, printed: bool) -> DataFrame:
    """(key, hash, fp, sim, bands) of every row: hash of the text and of its words, fingerprint, band values.

    The fingerprint is 0 unless ``printed``.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            prints, values = np.zeros(batch.num_rows, np.uint64), []
            sims = np.zeros(batch.num_rows, np.uint64)
            for i, x in enumerate(batch.column(2)):
                body = x.as_py()
                tokens = tokens_of(body)
                if printed:
                    sims[i] = simhash(body, PRINT_WORDS)
                prints[i] = xxh64_intdigest(b" ".join(tokens), SEED)
                values.append(bands(shingles(tokens, words, known)) if len(tokens) >= words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64)),
                 pa.array(sims.view(np.int64)), pa.array(values, pa.list_(pa.int64()))],
                names=["key", "hash", "fp", "sim", "bands"])

    return df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(whole(text)).alias("hash"),
                     whole(text).alias("body")).mapInArrow(
        run, f"key {kind}, hash long, fp long, sim long, bands array<bigint>")


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(place, first place of its component) by search; each set is compared once as a frontier."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return [(1, 0)] if n / (len(sets[0]) + len(sets[1]) - n) >= least else []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    held, free, out = np.zeros(ids.max() + 1, bool), np.ones(len(sets), bool), []
    for root in range(len(sets)):
        frontier = [root] if free[root] else []
        free[root] = False
        while frontier and free.any():
            i = frontier.pop()
            own = ids[starts[i]:starts[i] + sizes[i]]
            held[own] = True
            common = np.add.reduceat(held[ids].astype(np.int64), starts)
            held[own] = False
            near = np.flatnonzero(free & (common / (sizes + sizes[i] - common) >= least)).tolist()
            free[near] = False
            out.extend((j, root) for j in near)
            frontier.extend(near)
    return out


def _links(batches: Iterator[pa.RecordBatch], words: int, least: float) -> Iterator[pa.RecordBatch]:
    """Forests of the groups in rows sorted by group; only one group is held at a time."""
    known: dict[bytes, int] = {}
    group, fps, sets = None, [], []

    def batch_of() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1 and (found := forest(sets, least)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([fps[i] for i, _ in found], pa.int64()),
                 pa.array([fps[j] for _, j in found], pa.int64())], names=["u", "v"])

    for batch in batches:
        for t, block, pair, fp, body in zip(*(c.to_pylist() for c in batch.columns)):
            if (t, block, pair) != group:
                yield from batch_of()
                group, fps, sets = (t, block, pair), [], []
            fps.append(fp)
            sets.append(shingles(tokens_of(body), words, known))
    yield from batch_of()


def overlap_links(df: DataFrame, reps: DataFrame, text: str, scratch: Scratch, words: int, least: float,
                  chunk: int) -> DataFrame:
    """(u, v) links that connect what pairs of enough overlap that share a band connect.

    ``reps`` has the distinct ``fp`` with their ``bands`` and the ``hash`` of one of their texts.
    """
    keyed = reps.where("bands is not null").select("fp", "hash", F.posexplode("bands").alias(
        "t", "block"))
    shared = keyed.groupBy("t", "block").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("members")).where("n > 1")
    # Of bands with equal members, one.
    shared = scratch.keep(shared.groupBy("n", "members").agg(
        F.min(F.struct("t", "block")).alias("at")).select("at.t", "at.block", "n"))
    many = keyed.join(shared, ["t", "block"]).withColumn(
        "chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn(
        "own", F.pmod(F.hash("fp", "t"), F.col("chunks")))
    # Every pair of chunks of a hot bucket is a group of its own.
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))))
    dealt = scratch.keep(many.withColumn("other", other).select(
        "t", "block", (F.least("own", "other").cast("long") * (1 << 31)
                       + F.greatest("own", "other")).alias("pair"), "fp", "hash"))
    bodies = df.select(F.xxhash64(whole(text)).alias("hash"), whole(text).alias("body")).join(
        dealt.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(
        F.first("body").alias("body"))
    return dealt.join(bodies, "hash").select("t", "block", "pair", "fp", "body").repartition(
        shuffle_width(df.sparkSession), "t", "block", "pair").sortWithinPartitions(
        "t", "block", "pair", "fp").mapInArrow(
        lambda b: _links(b, words, least), "u long, v long")


def print_links(reps: DataFrame, scratch: Scratch, distance: int) -> DataFrame:
    """(u, v) links of ``fp`` that connect what fingerprints ``sim`` within ``distance`` bits connect."""
    # One text stands for each fingerprint; the others of the same fingerprint are linked to it.
    firsts = scratch.keep(reps.groupBy("sim").agg(F.min("fp").alias("first"), F.count("*").alias("n")))
    near = scratch.keep(near_links(firsts.select(F.col("sim").alias("fp")), scratch, distance))
    end = lambda c, name: firsts.select(F.col("sim").alias(c), F.col("first").alias(name))
    equal = reps.join(firsts.where("n > 1"), "sim").where("fp <> first").select(
        F.col("fp").alias("u"), F.col("first").alias("v"))
    return near.join(end("u", "_u"), "u").join(end("v", "_v"), "v").select(
        F.col("_u").alias("u"), F.col("_v").alias("v")).unionByName(equal)


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                least: float = LEAST, chunk: int = CHUNK, distance: int | None = None) -> DataFrame:
    """(key, fp, component_id) for every row: hash of its words, the smallest key it is linked to."""
    scratch = Scratch(df.sparkSession, "overlap")
    prints = scratch.keep(sketches(df, key, text, words, distance is not None))
    reps = scratch.keep(prints.groupBy("fp").agg(
        F.min("key").alias("rep"), F.min("hash").alias("hash"), F.first("sim").alias("sim"),
        F.first("bands").alias("bands")))
    links = overlap_links(df, reps, text, scratch, words, least, chunk)
    if distance is not None:
        links = print_links(reps, scratch, distance).unionByName(links)
    return component_ids(prints.select("key", "fp"), reps.select("fp", "rep"), links, scratch, key)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                 least: float = LEAST, distance: int | None = None) -> DataFrame:
    """The rows of ``df`` of which one stays for each component of near copies; see ``one_of_each``."""
    return one_of_each(df, key, text, partial(near_copies, words=words, least=least, distance=distance))
