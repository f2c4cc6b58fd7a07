"""Fuzzy classification of titles against a text taxonomy.

A node scores by its keywords found in the title plus half the partial ratio of its leaf.  The taxonomy
is a query set: it goes in blocks of bounded size to all distinct titles, no pair ever becomes a row,
and a worker builds its index of a block once.

The index filters and verifies.  Characters that a leaf and a title share, counted, bound their common
subsequence and so the ratio from above; nodes are taken in the order of keyword score plus bound, and
the ratio is worked out only for those whose bound reaches the best total so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.operators.classify import mapped_type
from shelfline.operators.taxonomy import taxonomy_keywords
from shelfline.session import BROADCAST_BYTES, written


def _common(needle_bits: dict[str, int], width: int, window: str) -> int:
    """Length of the longest common subsequence, one machine word of state per window."""
    state = full = (1 << width) - 1
    for char in window:
        hit = state & needle_bits.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
    return width - state.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """Best match of the shorter text with any stretch of the longer, 0 to 100.

    Stretches are as long as the shorter text; at either end of the longer text they may be
    shorter.  A stretch scores twice the common subsequence over both lengths.  Texts of one length
    are tried both ways.
    """
    if len(a) == len(b):
        return max(_directed_ratio(a, b), _directed_ratio(b, a))
    return _directed_ratio(a, b) if len(a) < len(b) else _directed_ratio(b, a)


def _directed_ratio(short: str, long: str) -> float:
    width = len(short)
    if not width:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    bits: dict[str, int] = {}
    for i, char in enumerate(short):
        bits[char] = bits.get(char, 0) | (1 << i)
    best = 0.0
    for start in range(1 - width, len(long)):
        end = start + width
        # A stretch ending in a foreign character is no better than the one ending before it,
        # unless it is cut off by the end of the text.
        if end <= len(long) and long[end - 1] not in bits:
            continue
        window = long[max(start, 0):end]
        # Nor is one worth comparing that could not pass the best by matching whole.
        if 2 * len(window) / (width + len(window)) > best:
            best = max(best, 2 * _common(bits, width, window) / (width + len(window)))
    return 100.0 * best


_CHUNK = 16
_CODES = 256
_MAX_WIDTH = 63


class LeafMasks:
    """Character masks of leaves as table rows, so that leaves of one length are compared at once."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.rows: dict[str, np.ndarray | None] = {}

    def row(self, leaf: str) -> np.ndarray | None:
        """``mask[code]`` of a leaf; None for a leaf the tables cannot hold."""
        if leaf not in self.rows:
            table = np.zeros(_CODES, dtype=np.uint64)
            fits = 0 < len(leaf) <= _MAX_WIDTH
            for i, char in enumerate(leaf if fits else ""):
                code = self.codes.setdefault(char, len(self.codes) + 1)
                if code >= _CODES:
                    fits = False
                    break
                table[code] |= np.uint64(1 << i)
            self.rows[leaf] = table if fits else None
        return self.rows[leaf]

    def ratios(self, leaves: list[str], text: str) -> list[float]:
        """:func:`partial_ratio` of every leaf with the text."""
        out = [0.0] * len(leaves)
        by_width: dict[int, list[int]] = {}
        for i, leaf in enumerate(leaves):
            if len(leaf) >= len(text) or leaf in text or self.row(leaf) is None:
                out[i] = partial_ratio(leaf, text)
            else:
                by_width.setdefault(len(leaf), []).append(i)
        # Code 0 has no bit in any mask: it stands for foreign characters and beyond either end.
        coded = np.array([self.codes.get(c, 0) for c in text], dtype=np.intp)
        for width, members in by_width.items():
            pad = np.zeros(width - 1, dtype=np.intp)
            windows = np.lib.stride_tricks.sliding_window_view(
                np.concatenate([pad, coded, pad]), width)
            starts = np.arange(1 - width, len(text))
            lengths = np.minimum(starts + width, len(text)) - np.maximum(starts, 0)
            masks = np.stack([self.rows[leaves[i]] for i in members])
            full = np.uint64((1 << width) - 1)
            state = np.full((len(members), len(starts)), full)
            for step in range(width):
                hit = state & masks[:, windows[:, step]]
                state = ((state + hit) | (state - hit)) & full
            common = width - np.bitwise_count(state).astype(np.int64)
            best = (2 * common / (width + lengths)).max(axis=1)
            for i, value in zip(members, best):
                out[i] = 100.0 * float(value)
        return out


class KindIndex:
    """The nodes of a type in one block: keywords to nodes, character counts and masks of leaves."""

    def __init__(self, nodes: list[tuple[int, str, list[str], str]]):
        self.pos = np.array([n[0] for n in nodes])
        self.leaves, self.names = [n[1] for n in nodes], [n[3] for n in nodes]
        place: dict[str, int] = {}
        pairs = [(i, place.setdefault(k, len(place))) for i, n in enumerate(nodes) for k in n[2] if k]
        self.words = [(i, w, len(w), re.compile(rf"\b{re.escape(w)}\b")) for w, i in place.items()]
        self.node, self.word = (np.array([p[j] for p in pairs], np.intp) for j in (0, 1))
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(self.leaves))))}
        self.widths = np.array(list(map(len, self.leaves)))
        self.counts = np.zeros((len(nodes), len(self.letters)), np.int32)
        for i, leaf in enumerate(self.leaves):
            for c in leaf:
                self.counts[i, self.letters[c]] += 1
        self.masks = LeafMasks()

    def scores(self, text: str) -> np.ndarray:
        """Points of the keywords of every node: twice a length, on word boundaries three times."""
        points = np.zeros(len(self.words))
        for i, word, size, pattern in self.words:
            if word in text:
                points[i] = size * (3 if pattern.search(text) else 2)
        return np.bincount(self.node, points[self.word], len(self.leaves))

    def bounds(self, text: str) -> np.ndarray:
        """At least the partial ratio of every leaf: no stretch shares more than the characters do."""
        own = np.zeros(len(self.letters), np.int32)
        for c in text:
            if (i := self.letters.get(c)) is not None:
                own[i] += 1
        shared = np.minimum(self.counts, own).sum(axis=1)
        short = np.minimum(self.widths, len(text))
        return np.where(short > 0, 200.0 * shared / np.maximum(short + shared, 1), 100.0)

    def best(self, text: str) -> tuple[int, float, int, str]:
        """(best keyword score, best total, its place and leaf); of equal totals the smallest place."""
        scores = self.scores(text)
        reach = scores + fv.FUZZY_WEIGHT * self.bounds(text)
        order = np.argsort(-reach, kind="stable")
        best, place, won = -1.0, -1, 0
        for start in range(0, len(order), _CHUNK):
            chunk = [i for i in order[start:start + _CHUNK].tolist() if reach[i] >= best]
            if not chunk:
                break
            for i, ratio in zip(chunk, self.masks.ratios([self.leaves[i] for i in chunk], text)):
                total = float(scores[i]) + fv.FUZZY_WEIGHT * ratio
                if total > best or (total == best and self.pos[i] < place):
                    best, place, won = total, int(self.pos[i]), i
        return int(scores.max()), best, place, self.names[won]


_SCORED = "title string, kind string, top int, total double, pos long, leaf string"


def _blocks(paths: DataFrame, size: int) -> Iterator[dict[str, list[tuple]]]:
    """The taxonomy's nodes by type, in blocks of about ``size`` bytes; one at a time is on the driver."""
    leaf = F.element_at(F.split("path", " > "), -1)
    nodes = written(paths.select(
        "product_type", "pos", F.lower(leaf).alias("leaf"), taxonomy_keywords(F.col("path")).alias(
            "keywords"), leaf.alias("name"), F.octet_length("path").alias("bytes")), "nodes")
    total = nodes.agg(F.sum("bytes")).first()[0] or 0
    # A node in a worker is some times as large as its path.
    count = max(1, -(-16 * total // size))
    for n in range(count):
        own = nodes.where(F.pmod(F.xxhash64("product_type", "pos"), F.lit(count)) == n) if count > 1 else nodes
        by: dict[str, list[tuple]] = {}
        for r in own.collect():
            by.setdefault(r["product_type"], []).append(
                (r["pos"], r["leaf"], r["keywords"], r["name"]))
        yield {kind: sorted(v) for kind, v in by.items()}


def _scored(titles: DataFrame, paths: DataFrame, title: str, product_type: str, size: int) -> DataFrame:
    """(title, kind, top, total, pos, leaf) of each distinct title and type the taxonomy has nodes for."""
    spark = titles.sparkSession
    # Scoring costs far more than a title's bytes say, so the tasks are not put together by size.  The
    # hash keeps this exchange: one on the same columns would be taken for the one of ``distinct``.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = titles.select(F.col(f"`{title}`").alias("title"), mapped_type(F.col(product_type)).alias(
        "kind")).distinct().repartition(width, F.xxhash64("title", "kind")).withColumn(
        "text", F.lower(F.coalesce("title", F.lit(""))))
    parts = []
    for nodes in _blocks(paths, size):
        sent = spark.sparkContext.broadcast({"nodes": nodes, "index": {}})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            nodes, index = sent.value["nodes"], sent.value["index"]
            for batch in batches:
                out = []
                for name, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind in nodes:
                        if kind not in index:
                            index[kind] = KindIndex(nodes[kind])
                        out.append((name, kind, *index[kind].best(text)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate(
                        (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.string()))],
                    names=["title", "kind", "top", "total", "pos", "leaf"])

        parts.append(pairs.mapInArrow(run, _SCORED))
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("title", "kind").agg(
        F.max("top").alias("top"), F.max(F.struct("total", (-F.col("pos")).alias("place"), "leaf"))
        .alias("best")).select("title", "kind", "top", "best.total", (-F.col("best.place")).alias("pos"),
                               "best.leaf")


def keyword_scores(titles: DataFrame, paths: DataFrame, title: str = "title",
                   product_type: str = "product_type", size: int = BROADCAST_BYTES) -> DataFrame:
    """``title, product_type, score``: the best keyword score of each distinct title and type."""
    found = _scored(titles, paths, title, product_type, size).select(
        F.col("title").alias("_t"), F.col("kind").alias("_k"), "top")
    pairs = titles.select(F.col(f"`{title}`").alias(title), mapped_type(F.col(product_type)).alias(
        product_type)).distinct()
    return pairs.join(found, F.col(title).eqNullSafe(F.col("_t")) & (F.col(product_type) == F.col("_k")),
                      "left").select(title, product_type, F.coalesce("top", F.lit(0)).alias("score"))


def fuzzy_category(titles: DataFrame, paths: DataFrame, title: str = "title",
                   product_type: str = "product_type", size: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``category`` (a leaf or "Other") and ``confidence`` (0 to 1).

    Each distinct (title, type) is scored once: repeated titles are common in feeds and scoring is
    the costly part.  A type outside the taxonomy gives "Other" and 0.
    """
    won = _scored(titles, paths, title, product_type, size).where(
        F.col("total") > fv.FUZZY_THRESHOLD).select(
        F.col("title").alias("_title"), F.col("kind").alias("_type"), "total", F.col("leaf").alias("_leaf"))
    # A null title joins like any other value.
    back = (titles.withColumn("_kind", mapped_type(F.col(product_type))).alias("t")
            .join(won.alias("b"), F.col(f"t.{title}").eqNullSafe(F.col("b._title"))
                  & (F.col("t._kind") == F.col("b._type")), "left"))
    return back.select(
        *[F.col(f"t.`{c}`").alias(c) for c in titles.columns],
        F.coalesce("_leaf", F.lit(fv.NO_CATEGORY)).alias("category"),
        F.when(F.col("total").isNull(), F.lit(0.0)).otherwise(F.least(F.col("total") / 100, F.lit(
            1.0))).alias("confidence"))
