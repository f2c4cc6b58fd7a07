"""Byte-level BPE: pre-tokens found by a scan over codepoint classes, pairs merged with a cache.

Texts of a batch are laid end to end as code points.  Each code point becomes a symbol (letter,
number, other, white space with what follows it, apostrophe that opens a contraction, text end), and
each symbol is a function on eight states.  Composition of functions is associative: blocks of 64
symbols are composed side by side, the blocks by doubling, and a second pass reads off where
pre-tokens begin.  No regular expression runs.  Equal pre-tokens of a batch are merged once, and a
bounded cache carries over to later batches of a worker; it changes the time, never the result.

Defined results: a null text is an empty text, which has no ids and decodes to no bytes.  Repeated
rows each get their row.  The ids of a text do not depend on its neighbours.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import bounded_batches, table, text_slices, whole
from shelfline.llm.registry import query

# Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
# What may follow an apostrophe to make a pre-token of its own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

LETTER, NUMBER, OTHER, SPACE, GLUED, LONE, SHORT, LONG, END = range(9)
# States: which pre-token the last code point belongs to, or how much of a contraction is open.
START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
BLOCK = 64
# Pre-tokens kept from batch to batch in one worker.
CACHED = 1 << 18


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a pre-token begin here) by symbol and state."""
    to, cut = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    inside = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: IN_SPACE,
              GLUED: AFTER_SPACE, LONE: START, SHORT: ONE_MORE, LONG: TWO_MORE, END: START}
    for symbol, target in inside.items():
        for state in range(8):
            to[symbol, state] = target
            cut[symbol, state] = state != target or symbol in (GLUED, LONE, END)
        if symbol in (SHORT, LONG):
            to[symbol, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
            cut[symbol, IN_OTHER] = False
        if symbol != END:
            to[symbol, TWO_MORE], to[symbol, ONE_MORE] = ONE_MORE, START
            cut[symbol, [ONE_MORE, TWO_MORE]] = False
            cut[symbol, AFTER_SPACE] = symbol in (SPACE, GLUED, LONE)
    return to, cut


TO, CUT = _transitions()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Letter, number, other or space for every code point; made once in a worker."""
    global _classes
    if _classes is None:
        by_category = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((by_category.get(unicodedata.category(chr(c))[0], OTHER)
                                for c in range(0x110000)), np.uint8, 0x110000)
        _classes[WHITE_SPACE] = SPACE
    return _classes


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    kinds = classes()[codes]
    kinds[ends] = END
    solid = np.zeros(len(codes), bool)
    solid[:-1] = (kinds[1:] != SPACE) & (kinds[1:] != END)
    last = (kinds == SPACE) & solid
    kinds[last] = LONE
    kinds[last & (codes == 0x20)] = GLUED
    kinds[ends] = END
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        open_ = kinds[marks] == OTHER
        for word in CONTRACTIONS:
            hit = open_.copy()
            for k, letter in enumerate(word):
                hit &= padded[marks + 1 + k] == ord(letter)
            kinds[marks[hit]] = SHORT if len(word) == 1 else LONG
    return kinds


def scan(kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, by composing transition functions."""
    n = len(kinds)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat_to, flat_cut = TO.ravel(), CUT.ravel()
    whole_block = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    base = grid * np.uint8(8)
    for step in range(BLOCK):
        whole_block = flat_to[base[step][:, None] + whole_block]
    reach = 1
    while reach < rows:  # after each round a row holds the composition of up to 2*reach blocks
        joined = whole_block.copy()
        joined[reach:] = np.take_along_axis(whole_block[reach:], whole_block[:-reach], axis=1)
        whole_block, reach = joined, reach * 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole_block[:-1, START]
    begins = np.empty((BLOCK, rows), bool)
    for step in range(BLOCK):
        at = base[step] + state
        begins[step] = flat_cut[at]
        state = flat_to[at]
    return begins.T.reshape(-1)[:n]


def pre_tokens(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """(slices, number of slices by text, byte offset of each slice in its text)."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kinds = symbols(codes, ends)
    begins = np.flatnonzero(scan(kinds))
    width = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int64)
    place = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(width, out=place[1:])
    offsets = np.append(place[begins], place[-1])
    data = pa.py_buffer(joined.encode("utf-8", "surrogatepass"))
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), data])
    real = kinds[begins] != END
    owner = np.searchsorted(ends, begins[real])
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.concatenate([[0], place[ends[:-1] + 1]]) if len(texts) else np.zeros(0, np.int64)
    return pieces.filter(pa.array(real)), counts, offsets[:-1][real] - starts[owner]


class Encoded:
    """Ids of a batch laid end to end; text i has ids[bounds[i]:bounds[i + 1]].

    ``pieces`` has the index of each pre-token in ``merged``, ``piece_bounds`` the pre-tokens of
    each text and ``offsets`` where in its text each pre-token begins, in bytes.
    """

    def __init__(self, ids, bounds, pieces, piece_bounds, offsets, merged):
        self.ids, self.bounds, self.pieces = ids, bounds, pieces
        self.piece_bounds, self.offsets, self.merged = piece_bounds, offsets, merged

    def joined(self) -> Iterator[bytes]:
        """The decimal ids of each text, joined by commas."""
        said = [b",".join(b"%d" % i for i in ids) for ids in self.merged]
        pieces = self.pieces.tolist()
        for a, b in zip(self.piece_bounds[:-1].tolist(), self.piece_bounds[1:].tolist()):
            yield b",".join([said[i] for i in pieces[a:b]])


class Codec:
    """Merges by rank and looks ids up; one per worker and vocabulary."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        ranks = self.ranks
        self.pairs = {
            ranks[token[:i]] << 24 | ranks[token[i:]]: rank for token, rank in ranks.items()
            for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        known = self.ranks.get(piece)
        if known is not None:
            return (known,)
        parts = [self.bytes[b] for b in piece]
        if len(parts) > 100:
            return self._merge_long(parts)
        get, none = self.pairs.get, 1 << 60
        ranks = [get(a << 24 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [best]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 24 | best, none)
            if i < len(ranks):
                ranks[i] = get(best << 24 | parts[i + 1], none)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same merges with a heap, for pre-tokens of any length."""
        get, n = self.pairs.get, len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := get(parts[i] << 24 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get(parts[x] << 24 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(p for p, ok in zip(parts, live) if ok)

    def encode(self, texts: list[str]) -> Encoded:
        pieces, counts, offsets = pre_tokens(texts)
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        cache, merged = self.cache, []
        for piece in coded.dictionary.to_pylist():
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(piece) <= 64:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[piece] = ids
            merged.append(ids)
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter((i for ids in merged for i in ids), np.int32, int(sizes.sum()))
        firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        each = sizes[index]
        place = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(firsts[index] - place[:-1], each) + np.arange(place[-1])]
        piece_bounds = np.concatenate([[0], np.cumsum(counts)])
        return Encoded(ids, place[piece_bounds], index, piece_bounds, offsets, merged)

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes of all ids end to end, byte offset before each id and after the last)."""
        found = self.tokens.take(pa.array(ids))
        _, offsets, data = found.buffers()
        places = np.frombuffer(offsets, np.int64, len(ids) + 1)
        return memoryview(data) if data is not None else memoryview(b""), places


_codecs: dict[str, Codec] = {}


def codec(name: str, lines) -> Codec:
    """The worker's codec for these ranks; ``lines`` is a broadcast value."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(lines.value)
    return _codecs[name]


def read_ranks(spark: SparkSession, path: str):
    """(digest, broadcast bytes) of a rank file on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as file:
        lines = file.read()
    return sha256(lines).hexdigest(), spark.sparkContext.broadcast(lines)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(df: DataFrame, ranks_path: str, text: str = "text", checked: str | None = None) -> DataFrame:
    """``df`` with ``ids``, ``piece_offsets`` (byte offset of each pre-token) and ``n_tokens``.

    ``checked`` names a further column: do the ids decode to the bytes of the text.  Encoding and
    decoding share a worker and its tables.  Columns of those names are replaced.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    name, lines = read_ranks(spark, ranks_path)
    made = ("ids", "piece_offsets", "n_tokens", *([checked] if checked else []))
    kept = [c for c in df.columns if c.lower() not in [m.lower() for m in made]]
    schema = columns_ddl(df, kept) + "ids array<int>, piece_offsets array<long>, n_tokens long" + (
        f", `{checked}` boolean" if checked else "")

    def same(tool: Codec, got: Encoded, texts: list[str]) -> pa.Array:
        data, places = tool.decode(got.ids)
        at = places[got.bounds].tolist()
        return pa.array([data[x:y].tobytes() == t.encode("utf-8", "surrogatepass")
                         for x, y, t in zip(at, at[1:], texts)], pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(name, lines)
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            for a, b in text_slices(body):
                texts = body.slice(a, b - a).to_pylist()
                got = tool.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:-1]),
                     pa.ListArray.from_arrays(pa.array(got.bounds, pa.int32()), pa.array(got.ids)),
                     pa.ListArray.from_arrays(pa.array(got.piece_bounds, pa.int32()),
                                              pa.array(got.offsets)),
                     pa.array(np.diff(got.bounds)),
                     *([same(tool, got, texts)] if checked else [])],
                    names=[*batch.schema.names[:-1], *made])

    body = "_body"
    while body in kept:
        body += "_"
    return df.select(*[F.col(f"`{c}`") for c in kept], whole(text).alias(body)).mapInArrow(
        run, schema)


def columns_ddl(df: DataFrame, kept: list[str]) -> str:
    """DDL of the kept columns, to be followed by others."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema
                   if f.name in kept)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids in ``out``; null ids decode to no bytes."""
    spark = df.sparkSession
    name, lines = read_ranks(spark, ranks_path)
    kept = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(name, lines)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            data, places = tool.decode(lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([bytes(data[places[a]:places[b]]) for a, b in zip(
                    bounds[:-1], bounds[1:])], pa.binary())],
                names=[*batch.schema.names[:-1], out])

    coded = "_ids"
    while coded in kept:
        coded += "_"
    return df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(
        F.col(f"`{ids}`"), F.array().cast("array<int>")).alias(coded)).mapInArrow(
        run, columns_ddl(df, kept) + f"`{out}` binary")


def digests(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids, and of the bytes that the ids decode to."""
    spark = df.sparkSession
    bounded_batches(spark)
    name, lines = read_ranks(spark, ranks_path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(name, lines)
        for batch in batches:
            body = batch.column(1)
            for a, b in text_slices(body):
                got = tool.encode(body.slice(a, b - a).to_pylist())
                data, places = tool.decode(got.ids)
                at = places[got.bounds].tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(got.bounds)),
                     pa.array([sha256(x).hexdigest() for x in got.joined()], pa.string()),
                     pa.array([sha256(data[x:y]).hexdigest() for x, y in zip(at, at[1:])],
                              pa.string())],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("key", key)


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
