"""Benchmark decontamination by greedy string tiling.

Words are runs of word characters, case folded.  Seeds are windows of five words (an item of fewer
words is one window) found by a rolling hash and joined with the benchmark's.  For each document and
item that share a seed, matches are grown along their diagonals from where they begin, and the longest match whose words
are all unmarked is marked as a tile again and again until none of five words is left.  Coverage is
the share of the item's words under tiles, so a passage whose parts were moved about is still found.

The benchmark is a query set: it is cut into blocks of bounded size, each broadcast against all
documents, and no pair of documents meets.

Defined results: null and empty texts match nothing, as do items without words.  Repeated document
rows each give their rows; repeated items each give theirs.  An item of fewer than five words is
matched as a whole.  Columns other than keys and texts are left out.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from shelfline.llm.common import Scratch, bounded_batches, table, text_slices, whole
from shelfline.llm.registry import query

WORD = re.compile(r"\w+")
WINDOW = 5
COVERAGE = 0.8
# Bytes of benchmark text in one broadcast block.
BLOCK_TEXT = 16 << 20
# Pairs of places that share a window, looked at together.
PAIRS = 1 << 20
BASE = np.uint64(0x100000001B3 * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF | 1)


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts end to end, number of words by text)."""
    words: list[str] = []
    sizes = []
    for t in texts:
        own = WORD.findall(t.casefold())
        words += own
        sizes.append(len(own))
    coded = pa.array(words, pa.string()).dictionary_encode()
    keys = np.array([xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    places = coded.indices.to_numpy(zero_copy_only=False)
    return (keys[places] if len(keys) else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def rolling(keys: np.ndarray, window: int) -> np.ndarray:
    """The polynomial hash of every window."""
    n = max(0, len(keys) - window + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            out = out * BASE + keys[k:k + n]
    return out


def tiles(seeds: list[tuple[int, int]], window: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text start, item start, words) from the seeds of one document and one item."""
    matches = []
    seeds = sorted(seeds, key=lambda s: (s[0] - s[1], s[0]))
    at = 0
    while at < len(seeds):
        end = at + 1
        while end < len(seeds) and (seeds[end][0] - seeds[at][0] == seeds[end][1] - seeds[at][1]
                                    == end - at):
            end += 1
        matches.append((*seeds[at], end - at + window - 1))
        at = end
    return tiles_of(matches, window)


def tiles_of(matches: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """Greedy tiles from the maximal matches (text start, item start, words) of one pair.

    Of matches of one length the first in the document, then in the item, goes first.  It ends when the
    item has fewer unmarked words than a tile takes.
    """
    if not matches:
        return []
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    text_free = np.ones(max(i + n for i, _, n in matches), bool)
    item_free = np.zeros(max(j + n for _, j, n in matches), bool)
    for _, j, n in matches:
        item_free[j:j + n] = True
    left, out = int(item_free.sum()), []
    while heap and left >= window:
        size, i, j = heapq.heappop(heap)
        free = text_free[i:i - size] & item_free[j:j - size]
        if free.all():
            out.append((i, j, -size))
            text_free[i:i - size] = item_free[j:j - size] = False
            left += size
            continue
        edges = np.flatnonzero(np.diff(free, prepend=False, append=False))
        for k, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - k >= window:
                heapq.heappush(heap, (k - end, i + k, j + k))
    return sorted(out)


class Items:
    """A block of benchmark items, with the windows of each size in hash order."""

    def __init__(self, ids: list, texts: list[str], window: int):
        self.flat, sizes = word_keys(texts)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.ids, self.sizes = ids, sizes
        by: dict[int, list] = {}
        for number, size in enumerate(sizes.tolist()):
            if size:
                w = min(window, size)
                hashes = rolling(self.flat[self.bounds[number]:self.bounds[number + 1]], w)
                by.setdefault(w, []).append((hashes, np.full(len(hashes), number),
                                             np.arange(len(hashes))))
        self.windows = {}
        for w, parts in by.items():
            hashes, numbers, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.windows[w] = hashes[order], numbers[order], places[order]

    def matches(self, texts: list[str], coverage: float
                ) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(text number, item number, window, maximal matches) of pairs that may be covered enough.

        Of the places that share a window only those are kept whose words before differ: the starts of
        matches along diagonals, of which a pair has no more than it has words, however often a window
        is repeated.  Pairs whose matches together are too short for ``coverage`` are left out at once.
        """
        keys, sizes = word_keys(texts)
        ends = np.cumsum(sizes)
        for w, index in self.windows.items():
            found = [self._grown(keys, ends, ends - sizes, w, at, first, index) for at, first in _shares(
                keys, ends, w, index[0])]
            if not found:
                continue
            doc, number, i, j, n = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((j, i, number, doc))
            doc, number, i, j, n = (x[order] for x in (doc, number, i, j, n))
            new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(number) != 0))[:len(doc)])
            if not len(new):
                continue
            enough = np.add.reduceat(n, new) >= np.maximum(coverage * self.sizes[number[new]], 1)
            stops = np.append(new[1:], len(doc))
            for x, y in zip(new[enough].tolist(), stops[enough].tolist()):
                yield int(doc[x]), int(number[x]), w, list(zip(
                    i[x:y].tolist(), j[x:y].tolist(), n[x:y].tolist()))

    def _grown(self, keys, ends, starts, w, at, first, index):
        """(text, item, places in both, words) of the matches that begin at some shared windows."""
        _, numbers, places = index
        number, place = numbers[first], places[first]
        flat = self.bounds[number] + place
        owner = np.searchsorted(ends, at, "right")
        begins = (at == starts[owner]) | (place == 0)
        begins |= keys[np.maximum(at - 1, 0)] != self.flat[np.maximum(flat - 1, 0)]
        for k in range(w):  # equal hashes are not yet equal words
            begins &= keys[at + k] == self.flat[flat + k]
        at, flat, number, place, owner = (x[begins] for x in (at, flat, number, place, owner))
        most = np.minimum(ends[owner] - at, self.sizes[number] - place)
        size, going = np.full(len(at), w), np.flatnonzero(most > w)
        while len(going):
            same = keys[at[going] + size[going]] == self.flat[flat[going] + size[going]]
            going = going[same]
            size[going] += 1
            going = going[size[going] < most[going]]
        return owner, number, at - starts[owner], place, size


def _shares(keys: np.ndarray, ends: np.ndarray, w: int, hashes: np.ndarray
            ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the texts, place among the items' windows) of equal hashes, some at a time."""
    own = rolling(keys, w)
    first, last = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
    hit = np.flatnonzero(last > first)
    owner = np.searchsorted(ends, hit, "right")
    hit = hit[hit + w <= ends[owner]]
    count = (last - first)[hit]
    total = np.cumsum(count)
    at = 0
    while at < len(hit):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:end]
        base = np.repeat(first[hit[at:end]] - (np.cumsum(n) - n), n)
        yield np.repeat(hit[at:end], n), base + np.arange(int(n.sum()))
        at = end


SCHEMA = ("item_words int, tiled_words int, coverage double, "
          "tiles array<struct<doc_word:int,item_word:int,words:int>>")
TILES = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()),
                            ("words", pa.int32())]))


def blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of about ``size`` bytes; one block at a time is on the driver."""
    rows = benchmark.select(F.col(f"`{item}`").alias("id"), whole(text).alias("body")).where(
        "body <> ''")
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    count = -(-total // size)
    for n in range(count):
        own = rows.where(F.pmod(F.xxhash64("id", "body"), F.lit(count)) == n) if count > 1 else rows
        got = own.orderBy("id", "body").collect()
        yield [r[0] for r in got], [r[1] for r in got]


def overlaps(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
             item: str = "item_id", item_text: str = "text", window: int = WINDOW,
             coverage: float = COVERAGE, block: int = BLOCK_TEXT) -> DataFrame:
    """(key, item, item_words, tiled_words, coverage, tiles) of pairs of at least ``coverage``."""
    spark = df.sparkSession
    bounded_batches(spark)
    key_type, item_type = df.schema[key].dataType, benchmark.schema[item].dataType
    item_arrow = to_arrow_type(item_type)
    schema = f"key {key_type.simpleString()}, item {item_type.simpleString()}, {SCHEMA}"
    rows = df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).where("body <> ''")
    out, scratch = None, Scratch(spark, "tiling")
    items_in_all = benchmark.where(whole(item_text) != "").count()
    for ids, texts in blocks(benchmark, item, item_text, block):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, window)
            for batch in batches:
                body, made = batch.column(1), []
                for a, b in text_slices(body):
                    for doc, number, w, pairs in items.matches(body.slice(a, b - a).to_pylist(), coverage):
                        own, size = tiles_of(pairs, w), int(items.sizes[number])
                        covered = sum(t[2] for t in own)
                        if covered >= coverage * size:
                            made.append((a + doc, number, size, covered, covered / size, own))
                if made:
                    names = ["doc_word", "item_word", "words"]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([m[0] for m in made])),
                         pa.array([items.ids[m[1]] for m in made], item_arrow),
                         pa.array([m[2] for m in made], pa.int32()),
                         pa.array([m[3] for m in made], pa.int32()),
                         pa.array([m[4] for m in made], pa.float64()),
                         pa.array([[dict(zip(names, t)) for t in m[5]] for m in made], TILES)],
                        names=["key", "item", "item_words", "tiled_words", "coverage", "tiles"])

        part = rows.mapInArrow(run, schema)
        if len(texts) < items_in_all:
            # Of several blocks one is held at a time.
            part = scratch.keep(part)
            sent.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"key": key, "item": item})


def uncontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE,
                   block: int = BLOCK_TEXT) -> DataFrame:
    """The rows of ``df`` that cover no item by ``coverage`` or more, with all their columns.

    Rows are dropped where they stand; nothing is shuffled.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    at, scratch = df.columns.index(text), Scratch(spark, "tiling")
    items_in_all = benchmark.where(whole(item_text) != "").count()
    for ids, texts in blocks(benchmark, item, item_text, block):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, window)
            for batch in batches:
                body = pa.compute.fill_null(batch.column(at), "")
                keep = np.ones(batch.num_rows, bool)
                for a, b in text_slices(body):
                    for doc, number, w, pairs in items.matches(body.slice(a, b - a).to_pylist(), coverage):
                        if keep[a + doc]:
                            covered = sum(t[2] for t in tiles_of(pairs, w))
                            keep[a + doc] = covered < coverage * items.sizes[number]
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
        if len(texts) < items_in_all:
            df = scratch.keep(df)
            sent.unpersist()
    return df


@query("op8_string_tiling")
def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
