"""Document fingerprints: a Merkle tree over sections, paragraphs and the segments inside them.

A text is cut into paragraphs at line feeds; a section ends at a blank paragraph, or after a
paragraph whose own hash says so (one in eight), so an edit moves no cut far from it.  Long
paragraphs are cut into segments at sentence ends, or after 32 characters.  The pieces cover the
text, so equal roots mean equal texts, and unequal branches tell where two texts differ.

Defined results: a null text is an empty text; an empty text has the root of no sections and is
wholly like another empty text (1.0).  Repeated rows each get their own row.  Columns other than
the key and the text are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, bounded_batches, shuffle_width, table, whole
from shelfline.llm.registry import query

SEGMENT = re.compile(r"[^.!?]{1,32}[.!?]*|[.!?]+")
# One paragraph in so many ends a section.
SECTION_CUT = 8


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


class Tree:
    """The tree of one text; ``sections`` holds (hash, [(hash, [(hash, length)])])."""

    __slots__ = ("root", "sections")

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list]] = []
        paragraphs: list[tuple[bytes, list]] = []
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if i < len(lines) - 1:
                line += "\n"
            if not line:
                continue
            leaves = [(_hash(x.encode("utf-8", "surrogatepass")), len(x))
                      for x in SEGMENT.findall(line)]
            own = _hash(b"p" + b"".join(h for h, _ in leaves))
            paragraphs.append((own, leaves))
            if not line.strip() or own[0] % SECTION_CUT == 0:
                self._close(paragraphs)
                paragraphs = []
        if paragraphs:
            self._close(paragraphs)
        self.root = _hash(b"r" + b"".join(h for h, _ in self.sections))

    def _close(self, paragraphs: list) -> None:
        self.sections.append((_hash(b"s" + b"".join(h for h, _ in paragraphs)), paragraphs))

    def weights(self) -> Counter:
        """Characters under each leaf hash."""
        out: Counter = Counter()
        for _, paragraphs in self.sections:
            for _, leaves in paragraphs:
                for leaf, n in leaves:
                    out[leaf] += n
        return out


def likeness(a: Counter, b: Counter) -> float:
    """Twice the characters in equal leaves over all characters of both; 1.0 for two empty texts."""
    total = a.total() + b.total()
    if not total:
        return 1.0
    if len(b) < len(a):
        a, b = b, a
    return 2.0 * sum(min(n, b[k]) for k, n in a.items() if k in b) / total


def near(a: Tree, b: Tree) -> float:
    """The likeness of two texts, found by descending their trees: equal branches count as a whole.

    Equal roots are equal texts.  Otherwise equal sections are set aside, then equal paragraphs of what is
    left, then equal leaves; that is ``likeness`` of all leaves, as what is set aside is equal on both sides.
    """
    sizes = [sum(n for _, ps in t.sections for _, leaves in ps for _, n in leaves) for t in (a, b)]
    if not sum(sizes):
        return 1.0
    if a.root == b.root:
        return 1.0
    shared, left = 0, [a.sections, b.sections]
    for _ in range(2):
        common = Counter(h for h, _ in left[0]) & Counter(h for h, _ in left[1])
        below = []
        for side, nodes in enumerate(left):
            unused, rest = Counter(common), []
            for h, children in nodes:
                if unused[h]:
                    unused[h] -= 1
                    shared += 0 if side else sum(_size(c) for c in children)
                else:
                    rest += children
            below.append(rest)
        left = below
    mine, theirs = Counter(), Counter()
    for total, leaves in zip((mine, theirs), left):
        for h, n in leaves:
            total[h] += n
    return 2.0 * (shared + (mine & theirs).total()) / sum(sizes)


def _size(node: tuple) -> int:
    """Characters under a paragraph or a leaf."""
    return node[1] if isinstance(node[1], int) else sum(n for _, n in node[1])


def differing(a: Tree, b: Tree) -> list[tuple[int, int, int]]:
    """(section number, start, end) of the paragraphs of ``b`` that ``a`` lacks, in ``b``'s text.

    Equal roots, and equal section hashes, are not descended into.
    """
    if a.root == b.root:
        return []
    sections = Counter(h for h, _ in a.sections)
    known = Counter(h for _, ps in a.sections for h, _ in ps)
    out, at = [], 0
    for number, (own, paragraphs) in enumerate(b.sections):
        whole_equal = sections[own] > 0
        sections[own] -= whole_equal
        for h, leaves in paragraphs:
            n = sum(k for _, k in leaves)
            if whole_equal or known[h] > 0:
                known[h] -= 1
            else:
                out.append((number, at, at + n))
            at += n
    return out


NODES = ("level string, section int, paragraph int, start long, end long, hash string")


def tree_nodes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per node: the root, the sections and the paragraphs, with code point ranges."""
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree, rows, at = Tree(t), [], 0
                rows.append((k, "root", None, None, 0, len(t), tree.root.hex()))
                for i, (h, paragraphs) in enumerate(tree.sections):
                    begun = at
                    for j, (ph, leaves) in enumerate(paragraphs):
                        n = sum(x for _, x in leaves)
                        rows.append((k, "paragraph", i, j, at, at + n, ph.hex()))
                        at += n
                    rows.append((k, "section", i, None, begun, at, h.hex()))
                names = ["key", "level", "section", "paragraph", "start", "end", "hash"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], type=p) for c, p in enumerate(
                        [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(),
                         pa.int64(), pa.int64(), pa.string()])], names=names)

    return df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).mapInArrow(
        run, f"key {kind}, {NODES}").withColumnRenamed("key", key)


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, edited_from long")


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as much, at most, from the start of ``other``."""
    n = len(text) // 3
    return text[:len(text) - n] + other[:n] if n else text


class Text:
    """A text with its tree, as one side of a comparison."""

    def __init__(self, key, body: str):
        self.key, self.body, self.tree = key, body, Tree(body)

    def compared(self, other: Text) -> tuple:
        """A row of RESULT: this text against its edited form and against the next text."""
        new = edited(self.body, other.body)
        tree = Tree(new) if new != self.body else self.tree
        changed = differing(self.tree, tree)
        return (len(self.body), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), self.tree.root.hex(),
                tree.root.hex(), near(self.tree, tree), near(self.tree, other.tree),
                changed[0][1] if changed else None)


RESULT_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]
# Compared rows, and the first and the last text of each range.
DONE, FIRST, LAST = 0, 1, 2


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text",
                      buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    ``edited_from`` is where the first differing paragraph of the edited text begins (null: none).

    Keys may be of any type with an order.  Rows are dealt out by ranges of (key descending, hash of the
    text), null keys last, so that a key many rows share is spread over ranges; each range compares its
    neighbours.  Of every range the first and last text are written as well, and compared with their
    neighbours afterwards: two texts a range, however many rows there are.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), whole(text).alias("body")).withColumn(
        "hash", F.xxhash64("body"))
    order = [F.col("key").desc_nulls_last(), F.col("hash")]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, names, out = TaskContext.get().partitionId(), None, ["kind", "range", "key", "body"], []

        def made(key_type: pa.DataType) -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), key_type, pa.string(), *RESULT_TYPES]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                              names=names + RESULT_NAMES)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Text(k, body.as_py())
                if held is None:
                    out.append((FIRST, part, k, own.body, *[None] * 7))
                else:
                    out.append((DONE, part, held.key, None, *held.compared(own)))
                held = own
                if len(out) >= 512:
                    yield made(key_type)
                    out.clear()
        if held is not None:
            out.append((LAST, part, held.key, held.body, *[None] * 7))
            yield made(key_type)

    kept = Scratch(spark, "merkle").keep(rows.repartitionByRange(
        buckets or 4 * shuffle_width(spark), *order).sortWithinPartitions(*order, "body").select(
        "key", "body").mapInArrow(within, f"kind int, range int, key {kind}, body string, {RESULT}"))
    ranges = sorted(r["range"] for r in kept.where(F.col("kind") == FIRST).select("range").collect())
    follows = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1])), "range int, next int")
    firsts = kept.where(F.col("kind") == FIRST).select(F.col("range").alias("next"), F.col("body").alias("other"))
    ends = kept.where(F.col("kind") == LAST).select("range", "key", "body").join(
        F.broadcast(follows), "range").join(firsts, "next").select("key", "body", "other")  # a row a range

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Text(None, a.as_py()).compared(Text(None, b.as_py()))
                     for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in found], t) for i, t in enumerate(RESULT_TYPES)]],
                names=["key", *RESULT_NAMES])

    return kept.where(F.col("kind") == DONE).select("key", *RESULT_NAMES).unionByName(
        ends.mapInArrow(across, f"key {kind}, {RESULT}")).withColumnRenamed("key", key)


@query("op1_merkle_fingerprints")
def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
