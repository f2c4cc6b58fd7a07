"""A prefix trie of conversations that are rebuilt from shared heads, by composable fingerprints.

A conversation c is the first h turns of its base conversation followed by its own turns after its
first h.  No rebuilt text is ever made.  With x_i a hash of the i-th turn, a run of turns has the
fingerprint (n, sum of x_i * B^i) modulo 2^64, and runs compose by (n, a)(m, b) = (n + m, a + B^n b): a
monoid whose elements can be cut as well, since B is odd and so has an inverse.  Prefix products of the
original conversations are summed range by range of the sorted turns and composed over ranges; the
fingerprint of a rebuilt prefix is then put together from the products of the base's head and of the
own suffix.  Two products with different B make 128 bits.

Prefixes of equal depth and fingerprint are a node.  Equality is verified, not believed.  A turn is
referred to by the hash of its role and text; where several turns share a hash, their texts are read
once and turns that differ get numbers, so the reference is exact.  A node whose members differ in the
reference of their last turn or in their parent is a collision, and the work starts again with other B.
By induction over depth, nodes are exact.

Subtrees are never walked.  A node belongs to its smallest member, whose nodes are the lower end of its
own path; so the sum over a subtree is the sum, over the members, of what each owns below the node.
What is owned is summed by runs of equal member counts, as differences of running lengths.

One conversation may hold most turns, and one node most conversations: turns are dealt out by ranges of
their order; joins send rows of keys beyond a share of the rows, of which there can be only a bounded
number, past the shuffle; ids that end at a node are hashed as a stream of packed pieces.

Defined results: null role and text are empty; turns go by turn, role, text, null turns first; repeated
rows are turns of their own.  Rows without a conversation id belong to none and are left out.  An empty
table gives no nodes, not even a root.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, bounded_batches, shuffle_width, table
from shelfline.llm.registry import query
from shelfline.session import broadcast_within

# Pairs of odd multipliers; a later pair is used only where an earlier one made a collision.
MULTIPLIERS = [(0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F),
               (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
MOST_HEAD = 5
# Ids packed into one piece of a node's ends.
PIECE_IDS = 4096
# Code points of a role and a text by which turns of one conversation and turn are dealt to ranges.
LEAD = 64
HALF = 1 << 64
NODE = ["depth", "f1", "f2"]


def signed(x: int) -> int:
    x %= HALF
    return x - HALF if x >> 63 else x


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def mixed(x: np.ndarray, variant: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ variant * np.uint64(0x9FB21C651E98DF25) ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


# --- turns ----------------------------------------------------------------------------------------

def turns_of(df: DataFrame, conv: str, turn: str, role: str, text: str, mask: int) -> DataFrame:
    def said(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    return df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        said(role).alias("role"), said(text).alias("text")).withColumn(
        "ref", F.xxhash64("role", "text").bitwiseAND(F.lit(mask)))


def variants(turns: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(ref, role, text, variant) of turns that share a hash with other turns; None without any.

    Only texts whose hash occurs more than once are compared, copies collapsed first.
    """
    often = scratch.keep(turns.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1").select("ref"))
    kinds = turns.select("ref", "role", "text").join(broadcast_within(often), "ref", "left_semi").groupBy(
        "ref", "role", "text").agg(F.count("*").alias("n"))
    clash = scratch.keep(kinds.select("ref").groupBy("ref").agg(F.count("*").alias("n")).where("n > 1"))
    if not clash.limit(1).count():
        return None
    order = Window.partitionBy("ref").orderBy("role", "text")
    return scratch.keep(kinds.drop("n").join(clash.select("ref"), "ref").withColumn(
        "variant", F.row_number().over(order).cast("long")))


SCANNED = ("conv long, part int, seq long, ref long, variant long, n_chars long, chars long, "
           "e1 long, a1 long, e2 long, a2 long")


def scanned(turns: DataFrame, bases: tuple[int, int], width: int) -> DataFrame:
    """Every turn with its place and running products within its conversation's part of a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, seen, chars, lead, sums = None, 0, 0, [1, 1], [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ref, variant = unsigned(batch.column(1)), unsigned(batch.column(2))
            sizes = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            ends = np.append(starts[1:], n)
            first = np.repeat(starts, ends - starts)
            goes_on = conv is not None and own[0] == conv
            held = slice(0, int(ends[0]) if goes_on else 0)

            def running(x: np.ndarray, before: int) -> np.ndarray:
                total = np.cumsum(x, dtype=x.dtype)
                total = total - (total[first] - x[first])
                total[held] += x.dtype.type(before)
                return total

            at = np.arange(n) - first
            seq = at + 1
            seq[held] += seen
            columns = [own, np.full(n, part, np.int32), seq, ref, variant, sizes,
                       running(sizes, chars)]
            last = int(starts[-1])
            whole = goes_on and last == 0
            chars = int(columns[-1][-1])
            for k, base in enumerate(bases):
                step = powers(base, n + 1)
                weight = step[at]
                weight[held] *= np.uint64(lead[k])
                term = mixed(ref, variant, base) * weight
                total = running(term, sums[k])
                columns += [term, total]
                lead[k] = (lead[k] if whole else 1) * int(step[n - last]) % HALF
                sums[k] = int(total[-1])
            conv, seen = own[-1], int(seq[-1])
            yield pa.RecordBatch.from_arrays([long_array(c) for c in columns], names=[
                x.split()[0] for x in SCANNED.split(", ")])

    dealt = turns.repartitionByRange(width, "conv", "turn", "role", F.left("text", F.lit(LEAD)))
    return dealt.sortWithinPartitions("conv", "turn", "role", "text").select(
        "conv", "ref", "variant", F.length("text").cast("long").alias("n_chars")).mapInArrow(run, SCANNED)


OFFSETS = "conv long, part int, before long, chars_before long, o1 long, w1 long, o2 long, w2 long"


def offsets(parts: DataFrame, bases: tuple[int, int], width: int) -> DataFrame:
    """What stands before each part of a conversation: turns, code points, products, powers of B."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = None
        for batch in batches:
            out = []
            for c, part, n, chars, a1, a2 in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    conv, state = c, [0, 0, 0, 1, 0, 1]
                out.append((c, part, *state[:2], *map(signed, state[2:])))
                state = [state[0] + n, state[1] + chars, (state[2] + state[3] * a1) % HALF,
                         state[3] * pow(bases[0], n, HALF) % HALF, (state[4] + state[5] * a2) % HALF,
                         state[5] * pow(bases[1], n, HALF) % HALF]
            names = [x.split()[0] for x in OFFSETS.split(", ")]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return parts.repartition(width, "conv").sortWithinPartitions("conv", "part").select(
        "conv", "part", "n", "chars", "a1", "a2").mapInArrow(run, OFFSETS)


PLACED = ("conv long, pos long, ref long, variant long, n_chars long, chars long, e1 long, a1 long, "
          "e2 long, a2 long")


def placed(turns: DataFrame, before: DataFrame) -> DataFrame:
    """Every turn with its place (from 1) and products within its whole conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = dict(zip(b.schema.names, b.columns))
            made = [c["conv"], pa.compute.add(c["seq"], c["before"]), c["ref"], c["variant"],
                    c["n_chars"], pa.compute.add(c["chars"], c["chars_before"])]
            for k in "12":
                w = unsigned(c[f"w{k}"])
                made += [long_array(unsigned(c[f"e{k}"]) * w),
                         long_array(unsigned(c[f"a{k}"]) * w + unsigned(c[f"o{k}"]))]
            yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in PLACED.split(", ")])

    return turns.join(before, ["conv", "part"]).mapInArrow(run, PLACED)


def past_hot_keys(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner"
                  ) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``rows`` how many of ``left`` meet it.

    Keys that meet more than a share of all rows are at most 4 * width; they are broadcast, and their
    rows are not shuffled.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    most = 4 * shuffle_width(left.sparkSession)
    hot = F.col(rows) > total // most
    own = [c for c in right.columns if c not in keys]
    few = right.where(hot).select(*keys, F.struct(*own).alias("_hot"))
    met = left.join(F.broadcast(few), keys, "left")
    rest = right.where(~hot).select(*keys, F.struct(*own).alias("_own"))
    some = met.where("_hot is not null").select(*left.columns, "_hot.*")
    return some.unionByName(met.where("_hot is null").drop("_hot").join(rest, keys, how).select(
        *left.columns, "_own.*"))


# --- rebuilt conversations -------------------------------------------------------------------------

ENTRY = ("conv long, depth long, f1 long, f2 long, p1 long, p2 long, ref long, variant long, "
         "n_chars long, chars long, ends boolean")


def rebuilt(turns: DataFrame, bases: tuple[int, int], base: Callable[[Column], Column],
            head: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """One row for every prefix of every rebuilt conversation, the empty ones included."""
    firsts = turns.where(F.col("pos") <= MOST_HEAD).groupBy("conv").agg(F.array_sort(F.collect_list(
        F.struct("pos", "a1", "a2", "chars", "ref", "variant", "n_chars"))).alias("firsts"))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n_turns"))
    own = scratch.keep(convs.join(firsts, "conv").withColumn("h", head(F.col("conv")).cast("int")).withColumn(
        "base", base(F.col("conv"))))
    bases_of = own.select(F.col("conv").alias("base"), F.col("firsts").alias("head"))
    known = own.join(bases_of, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.slice(
        "firsts", 1, 0)), F.lit(1), F.col("h")))
    known = known.withColumn("hl", F.size("head")).withColumn(
        "depth", F.col("hl") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0).cast("long")))

    def at(column: str, place: Column, field: str) -> Column:
        return F.coalesce(F.get(F.col(column), place - 1)[field], F.lit(0).cast("long"))

    known = scratch.keep(known.select(
        "conv", "n_turns", "h", "hl", F.col("depth").alias("whole"), "head",
        *[at("head", F.col("hl"), x).alias(f"head_{x}") for x in ("a1", "a2", "chars")],
        *[at("firsts", F.least("h", F.size("firsts")), x).alias(f"own_{x}")
          for x in ("a1", "a2", "chars")]))
    heads = known.select("conv", "whole", "head", F.explode(F.sequence(F.lit(0), F.col("hl"))).alias(
        "d")).select(
        "conv", F.col("d").cast("long").alias("depth"), at("head", F.col("d"), "a1").alias("f1"),
        at("head", F.col("d"), "a2").alias("f2"),
        F.when(F.col("d") > 0, at("head", F.col("d") - 1, "a1")).alias("p1"),
        F.when(F.col("d") > 0, at("head", F.col("d") - 1, "a2")).alias("p2"),
        *[at("head", F.col("d"), x).alias(x) for x in ("ref", "variant", "n_chars", "chars")],
        (F.col("d") == F.col("whole")).alias("ends"))

    inverse = [pow(b, -1, HALF) for b in bases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = dict(zip(b.schema.names, b.columns))
            h, hl, pos, whole, chars, of_own, of_head = (
                c[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in (
                    "h", "hl", "pos", "whole", "chars", "own_chars", "head_chars"))
            depth = hl + pos - h
            made, above = [], []
            for k, back in zip("12", inverse):
                # The suffix moves from place h to place hl.
                shift = powers(back, MOST_HEAD + 1)[h - hl]
                f = unsigned(c[f"head_a{k}"]) + shift * (unsigned(c[f"a{k}"]) - unsigned(c[f"own_a{k}"]))
                made.append(f)
                above.append(f - shift * unsigned(c[f"e{k}"]))
            yield pa.RecordBatch.from_arrays(
                [c["conv"], *map(long_array, [depth, *made, *above]), c["ref"], c["variant"],
                 c["n_chars"], long_array(of_head + chars - of_own), pa.array(depth == whole)],
                names=[x.split()[0] for x in ENTRY.split(", ")])

    tails = past_hot_keys(turns, known.drop("head"), ["conv"], "n_turns").where("pos > h").mapInArrow(
        run, ENTRY)
    return heads.unionByName(tails)


def nodes_of(entries: DataFrame) -> tuple[DataFrame, Column]:
    """((node, owner, n, parent and last turn) by node, condition that a node is a collision)."""
    above, last = F.struct("p1", "p2"), F.struct("ref", "variant")
    nodes = entries.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.count("*").alias("n"), F.min(above).alias("above"),
        F.max(above).alias("above_most"), F.min(last).alias("last"), F.max(last).alias("last_most"))
    same = F.col("above").eqNullSafe(F.col("above_most")) & F.col("last").eqNullSafe(F.col("last_most"))
    return nodes, ~same


# --- sums over subtrees ----------------------------------------------------------------------------

def subtree_sums(entries: DataFrame, nodes: DataFrame, children: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, saved, leaves) of the nodes with more than one member."""
    held = nodes.join(children, NODE, "left").select(
        *NODE, "owner", "n", F.col("n_children").isNull().alias("childless"))
    common = scratch.keep(past_hot_keys(entries.select("conv", *NODE, "n_chars", "chars", "ends"),
                                        held.where("n > 1"), NODE, "n"))
    owned = F.col("owner") == F.col("conv")
    # Member counts do not grow along a path, so equal counts are one stretch of it.
    runs = common.where(owned).groupBy("conv", "n").agg(
        F.max("chars").alias("upto"), F.min(F.col("chars") - F.col("n_chars")).alias("since"))
    below = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    value = (F.col("n") - 1) * (F.col("upto") - F.col("since"))
    runs = scratch.keep(runs.withColumn("value", value).withColumn("later", F.coalesce(
        F.sum("value").over(below), F.lit(0).cast("long"))).select("conv", "n", "upto", "value", "later"))
    totals = runs.groupBy("conv").agg(F.sum("value").alias("total"))
    # A conversation that ends at a childless node it owns is that leaf's; all that end elsewhere than
    # at a common node own their leaf.
    ends = common.where("ends").select("conv", (owned & F.col("childless")).alias("leaf"))
    mine = common.where(owned).join(runs, ["conv", "n"]).select(*NODE, "conv", (
        F.col("later") + (F.col("n") - 1) * (F.col("upto") - F.col("chars") + F.col("n_chars"))
        ).alias("saved"))
    others = common.where(~owned).join(totals, "conv", "left").select(*NODE, "conv", F.coalesce(
        "total", F.lit(0).cast("long")).alias("saved"))
    return mine.unionByName(others).join(ends, "conv", "left").groupBy(*NODE).agg(
        F.sum("saved").alias("saved"), F.sum(F.coalesce("leaf", F.lit(True)).cast("long")).alias("leaves"))


def ends_digests(ends: DataFrame, width: int) -> DataFrame:
    """(node, digest): SHA-256 of the ids that end at a node, ascending and comma-joined.

    Ids are packed where ranges of (node, id) put them; the pieces of a node are hashed as a stream.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, conv = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if not len(conv):
                continue
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = sorted({0, len(conv), *new.tolist(), *range(0, len(conv), PIECE_IDS)})
            ids = list(map(str, conv.tolist()))
            at = np.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(k[at]) for k in keys], pa.array(conv[at]),
                 pa.array([",".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])])],
                names=[*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                + [pa.array([r[3] for r in rows], pa.string())], names=[*NODE, "digest"])

        for batch in batches:
            out = []
            for d, f1, f2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, f1, f2) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, f1, f2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield batch_of(out)
        if node:
            yield batch_of([(*node, state.hexdigest())])

    packed = ends.select(*NODE, "conv").repartitionByRange(width, *NODE, "conv").sortWithinPartitions(
        *NODE, "conv").mapInArrow(pack, "depth long, f1 long, f2 long, first long, ids string")
    return packed.repartition(width, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        digest, "depth long, f1 long, f2 long, digest string")


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
         text: str = "text", base: Callable[[Column], Column] = lambda c: c - c % 100,
         head: Callable[[Column], Column] = lambda c: F.crc32(c.cast("string")) % (MOST_HEAD + 1),
         multipliers: list[tuple[int, int]] = MULTIPLIERS, mask: int = -1) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).

    ``base`` names the conversation whose first ``head`` turns (5 at most) begin a conversation in place
    of its own.  ``mask`` narrows turn hashes, for tests.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    width, scratch = shuffle_width(spark), Scratch(spark, "trie")
    turns = turns_of(df, conv, turn, role, text, mask)
    clash = variants(turns, scratch)
    if clash is None:
        turns = turns.withColumn("variant", F.lit(0).cast("long"))
    else:
        turns = turns.join(clash, ["ref", "role", "text"], "left").withColumn(
            "variant", F.coalesce("variant", F.lit(0).cast("long")))
    for bases in multipliers:
        local = scratch.keep(scanned(turns, bases, width))
        parts = local.groupBy("conv", "part").agg(F.max(F.struct(
            F.col("seq").alias("n"), "chars", "a1", "a2")).alias("x")).select("conv", "part", "x.*")
        whole = scratch.keep(placed(local, scratch.keep(offsets(parts, bases, width))))
        entries = scratch.keep(rebuilt(whole, bases, base, head, scratch))
        nodes, collision = nodes_of(entries)
        nodes = scratch.keep(nodes)
        if not nodes.where(collision).limit(1).count():
            break
    else:
        raise ValueError("every pair of multipliers made a collision")
    nodes = nodes.select(*NODE, "owner", "n", "above.p1", "above.p2")
    children = scratch.keep(nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count("*").alias("n_children")))
    zero, empty = F.lit(0).cast("long"), hashlib.sha256().hexdigest()
    sums = subtree_sums(entries, nodes, children, scratch)
    ends = ends_digests(entries.where("ends"), width)
    found = nodes.join(children, NODE, "left").join(sums, NODE, "left").join(ends, NODE, "left")
    found = scratch.keep(found.select(
        *NODE, "p1", "p2", "owner", "n", F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), F.coalesce("saved", zero).alias(
            "saved"), F.coalesce("digest", F.lit(empty)).alias("digest")))
    parents = found.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
        F.col("owner").alias("parent"), "n_children")
    below = past_hot_keys(found.where("depth > 0").withColumnRenamed("n_children", "own_children"),
                          parents, ["depth", "p1", "p2"], "n_children").drop("n_children").withColumnRenamed(
        "own_children", "n_children")
    top = found.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))
    return below.unionByName(top).select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"))


# Prefixes spelled out as lists of turn numbers; crc32 bit by bit.
SQL = """
WITH t AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS x,
    length(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
    CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) ORDER BY n) AS v
  FROM (SELECT unnest(range(256)) AS n)),
own AS (SELECT conv_id, list(x ORDER BY pos) AS xs FROM t GROUP BY conv_id),
c AS (SELECT conv_id, xs, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)), lambda a, b:
      xor(v[xor(a, b) % 256 + 1], a // 256)), 4294967295) % 6 AS h FROM own, crc),
r AS (SELECT c.conv_id, list_concat(coalesce(b.xs[1:h], []), c.xs[h + 1:]) AS xs
  FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
e AS (SELECT conv_id, d, xs[1:d] AS node, d = len(xs) AS last
  FROM (SELECT conv_id, xs, unnest(range(len(xs) + 1)) AS d FROM r)),
sizes AS (SELECT x, any_value(size) AS size FROM t GROUP BY x),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(
    conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.node, d, (n_convs - 1) * coalesce(size, 0) AS saved,
    CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
  FROM n LEFT JOIN kids USING (node) LEFT JOIN sizes ON x = n.node[d]),
sums AS (SELECT up AS node, sum(saved) AS saved, sum(leaf) AS leaves
  FROM (SELECT saved, leaf, unnest(list_transform(range(d + 1), lambda k: node[1:k])) AS up FROM w)
  GROUP BY up)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN sums USING (node) LEFT JOIN kids USING (node)
LEFT JOIN n p ON n.d > 0 AND p.node = n.node[1:n.d - 1]
"""


@query("op12_conversation_trie", SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
