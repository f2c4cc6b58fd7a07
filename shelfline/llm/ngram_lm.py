"""Language-model scores from a weighted backoff automaton over word n-grams.

States are n-gram histories.  A state has an arc for every word that followed it in training, and a
failure arc to the next shorter history.  With a Dirichlet prior of weight ``prior`` the arc of word
w from history h carries (c(h w) + prior * p(w | shorter h)) / (c(h) + prior), the failure arc
prior / (c(h) + prior), and the root (c(w) + 1) / (N + V + 1); every state's arcs and failure arc
sum to one over V words and one unknown word.  A text is read once from left to right.

Counts cover all training texts.  A task numbers the words of a bounded batch of texts and asks for
the counts of the batch's distinct n-grams; requests are dealt out by ranges of a 64-bit hash, packed
per batch and range.  Each range sums what training texts of all batches report, and answers each
batch; a very common n-gram is one entry per batch.  The batch's slice of the automaton then comes
back to the batch's texts.  Nothing of the model is broadcast but N and V.

Defined results: a null text is an empty text, which has one token, the end.  Without training texts
every score is that of the unknown word under an empty model.  Repeated rows each count and each get
their row.  Columns other than the key, the text and the training flag are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from shelfline.llm.common import bounded_batches, remainder, shuffle_width, table, whole
from shelfline.llm.registry import query

# No word holds these bytes.
BEGIN, FINISH = b"\t", b"\n"
BEGIN_KEY = xxh3_64_intdigest(BEGIN)
# Bytes of text that are numbered together, and bytes of text per hash range.
BATCH_TEXT, RANGE_TEXT = 6 << 20, 4 << 20
PRIOR = 200.0
ROWS = "batch long, part int, level int, n long, m long, a binary, b binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
TEXTS, TOTALS = 0, -1  # levels that are no n-gram order


def pack(values: np.ndarray) -> bytes:
    """Bytes of like significance together, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def joined_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of (history hash, word hash)."""
    with np.errstate(over="ignore"):
        h = history * np.uint64(0x9E3779B97F4A7C15) ^ word
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ h >> np.uint64(32)


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct words, place of each position's word, positions by text)."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        own = t.encode("utf-8", "surrogatepass").lower().split()
        words.append(BEGIN)
        words += own
        words.append(FINISH)
        sizes.append(len(own) + 2)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    keys = np.array([xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.uint32)
    rank[order] = np.arange(len(keys), dtype=np.uint32)
    return (keys[order], rank[coded.indices.to_numpy(zero_copy_only=False)],
            np.array(sizes, np.int64))


def levels(keys: np.ndarray, places: np.ndarray, sizes: np.ndarray, order: int):
    """(level, hashes of the n-grams ending at each position, which positions have one)."""
    words = keys[places]
    at = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = words
    for level in range(2, order + 1):
        own = np.concatenate([own[:1], joined_key(own[:-1], words[1:])])
        yield level, own, at >= level - 1


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=NAMES)


def text_part(batch: int, bits: int) -> int:
    """A range for a batch's texts: the numbers of batches are mixed, so that they spread evenly."""
    return (batch * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) >> (64 - bits)


def _requests(order: int, bits: int, with_texts: bool):
    shift = np.uint64(64 - bits)

    def parts(batch: int, level: int, keys: np.ndarray, counts: np.ndarray):
        edges = np.arange(1 << bits, dtype=np.uint64) << shift
        cuts = np.append(np.searchsorted(keys, edges), len(keys))
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[part], cuts[part + 1]
            yield (batch, part, level, int(b - a), None, pack_sorted(keys[a:b]),
                   pack(counts[a:b].astype(np.uint32)))

    def made(batch: int, texts: list[str], head: pa.Table) -> Iterator[tuple]:
        keys, places, sizes = numbered(texts)
        train = np.repeat(head.column("train").to_numpy(), sizes)
        yield from parts(batch, 1, keys, np.bincount(places[train], minlength=len(keys)))
        for level, own, valid in levels(keys, places, sizes, order):
            distinct = np.unique(own[valid])
            seen = np.sort(own[valid & train])
            yield from parts(batch, level, distinct, np.searchsorted(seen, distinct, "right")
                             - np.searchsorted(seen, distinct, "left"))
        if with_texts:
            sink = pa.BufferOutputStream()
            head = head.append_column("size", pa.array(sizes))
            with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(
                    compression="zstd")) as out:
                out.write_table(head)
            yield (batch, text_part(batch, bits), TEXTS, len(texts), None,
                   sink.getvalue().to_pybytes(), pack(places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts: list[str] = []
        heads: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal number, size
            rows, held = [], 0
            for row in made(number, texts, pa.Table.from_batches(heads)):
                rows.append(row)
                held += len(row[5]) + len(row[6])
                if held > 4 << 20:
                    yield _table(rows)
                    rows, held = [], 0
            if rows:
                yield _table(rows)
            number, size = number + 1, 0
            texts.clear()
            heads.clear()

        for batch in batches:
            body = batch.column(2)
            start = 0
            for i, n in enumerate(pa.compute.binary_length(body).to_pylist()):
                size += n + 8
                if size >= BATCH_TEXT:
                    texts.extend(body.slice(start, i + 1 - start).to_pylist())
                    heads.append(batch.select([0, 1]).slice(start, i + 1 - start))
                    start = i + 1
                    yield from flush()
            if start < batch.num_rows:
                texts.extend(body.slice(start).to_pylist())
                heads.append(batch.select([0, 1]).slice(start))
        if texts:
            yield from flush()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in ``columns``; rows of texts stand alone unless a batch is wanted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[2] == TEXTS and columns != [0]:
                yield [row]
                continue
            if held and any(held[-1][c] != row[c] for c in columns):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answers(totals_only: bool):
    """Sum each range's counts; answer every batch in the order it asked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, [1, 2]):
            _, part, level = rows[0][:3]
            if level == TEXTS:
                yield _table(rows)
                continue
            asked = [unpack_sorted(r[5]) for r in rows]
            counts = np.concatenate([unpack(r[6], np.uint32) for r in rows])
            distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(place, counts, len(distinct)).astype(np.uint64)
            if totals_only:
                words = total[distinct != np.uint64(BEGIN_KEY)]
                yield _table([(0, part, TOTALS, int(words.sum()), int((words > 0).sum()), None, None)])
                continue
            at = 0
            for row, own in zip(rows, asked):
                mine = total[place[at:at + len(own)]]
                at += len(own)
                small = mine.max() < 1 << 32
                yield _table([(row[0], part, level, len(own), int(small),
                               row[5] if level == 1 else None,
                               pack(mine.astype(np.uint32) if small else mine))])

    return run


def _traverse(order: int, prior: float, tokens: int, types: int):
    """Read each text along the automaton; the counts of its n-grams are those of its arcs."""
    def counts_of(rows: list[tuple]) -> np.ndarray:
        return np.concatenate([unpack(r[6], np.uint32 if r[4] else np.uint64) for r in rows]
                              ).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, [0]):
            by = {}
            for r in rows:
                by.setdefault(r[2], []).append(r)
            head = pa.ipc.open_stream(by[TEXTS][0][5]).read_all()
            sizes = head.column("size").to_numpy()
            places = unpack(by[TEXTS][0][6], np.uint32)
            keys = np.concatenate([unpack_sorted(r[5]) for r in by[1]])
            count = counts_of(by[1])[places]
            root = (count + 1.0) / (tokens + types + 1.0)
            weight = root
            for level, own, valid in levels(keys, places, sizes, order):
                arcs = np.zeros(len(own))
                distinct = np.unique(own[valid])
                arcs[valid] = counts_of(by[level])[np.searchsorted(distinct, own[valid])]
                history = np.concatenate([[0.0], count[:-1]])
                # With an arc its weight, without one the failure arc's times the shorter history's.
                weight = np.where(valid, (arcs + prior * weight) / (history + prior), weight)
                count = arcs
            starts = np.cumsum(sizes) - sizes
            word = np.ones(len(places), bool)
            word[starts] = False
            known = word & (root > 1.5 / (tokens + types + 1.0))

            def by_text(x):
                return pa.array(np.add.reduceat(np.where(word, x, 0), starts))

            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [head.column("key").combine_chunks(), pc_not(head.column("train")),
                 pa.array(sizes - 1), by_text(known.astype(np.int64)),
                 pa.array(np.full(n, tokens, np.int64)), by_text(np.log10(root)),
                 by_text(np.log10(weight))],
                names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                       "score"])

    return run


def pc_not(column: pa.ChunkedArray) -> pa.Array:
    return pa.compute.invert(column.combine_chunks())


def scores(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = 2,
           prior: float = PRIOR) -> DataFrame:
    """Scores of every text under the model of the rows where ``train`` holds."""
    spark = df.sparkSession
    bounded_batches(spark)
    width = shuffle_width(spark)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(train, F.lit(False)).alias("train"),
                     whole(text).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max(4 * width, int(size / RANGE_TEXT), 2).bit_length()

    def asked(depth: int, with_texts: bool) -> DataFrame:
        return rows.mapInArrow(_requests(depth, bits, with_texts), ROWS).repartition(
            width, "part").sortWithinPartitions("part", "level")

    tokens, types = asked(1, False).mapInArrow(_answers(True), ROWS).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    kind = df.schema[key].dataType.simpleString()
    return asked(order, True).mapInArrow(_answers(False), ROWS).repartition(
        width, "batch").sortWithinPartitions("batch", "level", "part").mapInArrow(
        _traverse(order, prior, tokens, types),
        f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double").withColumnRenamed("key", key)


@query("op3_backoff_lm")
def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
