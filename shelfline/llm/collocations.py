"""Collocations: phrases of two to four words, counted over an FM-index per shard.

A shard is a bounded amount of text.  Its words are numbered, the pieces they stand in are closed by
sentinels of their own, the suffixes are sorted, and the Burrows-Wheeler transform is written with the
vocabulary; texts are not needed after that.  A phrase is an interval of suffixes.  Extended to the left
by a word it is the interval that the LF mapping leads to; extended to the right it is a run of rows
within its interval.  Both meet in the row j of a phrase of k + 1 words: j itself lies in the interval
of its first k words, and the row after j's first word in that of its last k.  So, level by level, the
runs of rows with equal pairs of intervals are the phrases of k + 1 words and the run lengths their
counts.

Phrases are summed across shards under exact names, no hashes of phrases: a phrase of k + 1 words is the
pair of the names of its first k and last k words.  At each level every shard sends its pairs and counts,
packed by range of a hash; each range sums them, gives a name to those that occur ``least`` times or
more, and answers the shards.  Rarer phrases have no name, and neither they nor what holds them is
extended, as it would be rarer still.  Counts of all parts of a named phrase are thus at hand: what is
left is joins of the named phrases.

Everything is kept apart by group (language).  Candidates are scored by twice their count over the counts
of the two parts, at the cut where that is lowest; those inside a longer candidate that stands nearly as
often are dropped.  Scores are exact: decimals of 38 digits.

Defined results: a null text is empty, a null group is ``und``; repeated rows count each.  Texts without
pieces give nothing.  Empty tables give no rows.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from shelfline.llm.common import Scratch, bounded_batches, shuffle_width, table, whole
from shelfline.llm.ngram_lm import pack, unpack
from shelfline.llm.registry import query

WORDS, LEAST, TOP, SCALE, COVER = 4, 30, 2000, 2_000_000, 80
# Bytes of text in one shard, and bytes of text for each range that sums counts.
SHARD_TEXT, RANGE_TEXT = 5 << 20, 8 << 20
# Tokens held as such.
TOKENS = 1 << 16
NONE = "und"
# All ends of pieces become the first; none of them can stand in a word.
ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
# A name is the number of its range, from 1, and below these bits its place in the range.
NAME_BITS = 40


def tokens_of(text: str) -> list[bytes]:
    """The words, with b"." at the ends of pieces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(ENDS).replace(b".", b" . ").split(b" ")


def suffixes(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes; symbol 0 closes a piece, and every such end differs from the others.

    Prefixes of three symbols are sorted first, then doubled where suffixes are still equal.
    """
    n = len(symbols)
    closing = symbols == 0
    ends = int(closing.sum())
    rank = symbols.astype(np.int64) + (ends - 1)
    rank[closing] = np.arange(ends)
    top = int(rank.max()) + 1

    def ahead(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        # Past the end nothing decides: the last symbol is an end, which differs from all others.
        return x[np.minimum(at, n - 1)]

    step = 1
    place = np.arange(n)
    key = rank
    if top < 1 << 20:
        key = (rank * top + ahead(rank, place + 1)) * top + ahead(rank, place + 2)
        step = 3
    order = np.argsort(key)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    while True:
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, sizes)
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(rows):
            return order
        own = order[rows]
        key = rank[own] * (n + 1) + ahead(rank, own + step)
        by = np.argsort(key)
        order[rows] = own[by]
        key = key[by]
        new[rows[1:]] |= key[1:] != key[:-1]
        step *= 2


class Shard:
    """The transform of a shard, and which word of which group each number is."""

    def __init__(self, bwt: np.ndarray, vocabulary: int):
        self.bwt = bwt
        counts = np.bincount(bwt, minlength=vocabulary + 1)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        # Row of the suffix after the first symbol of a row: the inverse of the LF mapping.
        self.after = np.argsort(bwt, kind="stable")

    @staticmethod
    def transform(symbols: np.ndarray) -> np.ndarray:
        return symbols[suffixes(symbols) - 1]

    def named_words(self, names: np.ndarray) -> np.ndarray:
        """The names of the words that rows begin with; 0 for ends and words without a name."""
        return np.repeat(np.concatenate([[np.uint64(0)], names]), np.diff(self.starts))

    def longer(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first row, end, name of all but the last word, of all but the first) of every interval.

        ``rows`` are the names at one level.  Rows without both names belong to no interval.
        """
        last = rows[self.after]
        both = (rows != 0) & (last != 0)
        at = np.flatnonzero(both)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, rows[:0], rows[:0]
        new = np.empty(len(at), bool)
        new[0] = True
        a, b = rows[at], last[at]
        # Rows of one phrase lie side by side, since they are sorted by their words.
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        return at[first], at[first] + sizes, a[first], b[first]


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_parts(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (spread(a * np.uint64(0x9E3779B97F4A7C15) ^ b) >> np.uint64(64 - bits)).astype(np.int64)


# --- the index ------------------------------------------------------------------------------------

INDEX = "shard long, groups array<string>, sizes array<int>, words array<binary>, counts binary, bwt binary"


class Words:
    """The words of one group in a shard, numbered as they come."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.numbers: list[np.ndarray] = []
        self.tokens: list[bytes] = []

    def add(self, text: str) -> None:
        self.tokens += tokens_of(text)
        self.tokens.append(b".")
        if len(self.tokens) > TOKENS:
            self.flush()

    def flush(self) -> None:
        """Numbers in place of tokens, which take much more room."""
        coded = pa.array(self.tokens, pa.binary()).dictionary_encode()
        number = np.array([self.known.setdefault(w, len(self.known)) for w in coded.dictionary.to_pylist()],
                          np.int32)
        self.numbers.append(number[coded.indices.to_numpy(zero_copy_only=False)])
        self.tokens.clear()


def built(shard: int, held: dict[str, Words]) -> pa.RecordBatch | None:
    """One row of the index: words by group, their counts, and the transform."""
    groups, sizes, words, symbols, last = [], [], [], [], 0
    for group, given in sorted(held.items()):
        given.flush()
        # Empty tokens lie between blanks; "." closes a piece.
        kept = sorted(w for w in given.known if w not in (b"", b"."))
        if not kept:
            continue
        number = {w: i for i, w in enumerate(kept, last + 1)} | {b".": 0, b"": -1}
        place = np.array([number[w] for w in given.known], np.int64)[np.concatenate(given.numbers)]
        place = place[place >= 0]
        # Ends that follow an end close nothing.
        place = place[np.append(True, (place[1:] != 0) | (place[:-1] != 0))]
        symbols.append(place[1:] if place[0] == 0 else place)
        groups.append(group)
        sizes.append(len(kept))
        words += kept
        last += len(kept)
    if not groups:
        return None
    joined = np.concatenate(symbols)
    bwt = Shard.transform(joined)
    counts = np.bincount(joined, minlength=last + 1)[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([groups], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32())),
         pa.array([words], pa.list_(pa.binary())), pa.array([pack(counts.astype(np.uint64))], pa.binary()),
         pa.array([pack(bwt.astype(np.uint32))], pa.binary())],
        names=["shard", "groups", "sizes", "words", "counts", "bwt"])


def index(df: DataFrame, group: str, text: str, shard_text: int) -> DataFrame:
    """The FM-index of every shard of ``df``."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        held: dict[str, Words] = {}
        for batch in batches:
            for g, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                held.setdefault(g, Words()).add(body)
                size += len(body) + 8
                if size >= shard_text:
                    if (made := built(number, held)) is not None:
                        yield made
                    number, size = number + 1, 0
                    held.clear()
        if (made := built(number, held)) is not None:
            yield made

    return df.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(NONE)).alias("g"),
                     whole(text).alias("body")).where("body <> ''").mapInArrow(run, INDEX)


# --- summing across shards ---------------------------------------------------------------------------

ASKED = "shard long, part int, a binary, b binary, n binary, words array<binary>, groups array<string>"
# An answer to a shard, or a named phrase: of a word the group and the word, of others the two names.
ANSWERED = ("shard long, part int, names binary, name long, a long, b long, word binary, grp string, n long")


def batch_of(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
        names=[x.split()[0] for x in schema.split(", ")])


ASKED_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()),
               pa.list_(pa.string())]
ANSWER_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(),
                pa.string(), pa.int64()]


def word_parts(groups: list[str], sizes: list[int], words: list[bytes], bits: int) -> np.ndarray:
    """The range of every word of a shard; the group is its seed."""
    out, at = np.empty(len(words), np.int64), 0
    for g, n in zip(groups, sizes):
        seed = xxh3_64_intdigest(g.encode("utf-8", "surrogatepass"))
        out[at:at + n] = [xxh3_64_intdigest(w, seed) >> (64 - bits) for w in words[at:at + n]]
        at += n
    return out


def ask_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, groups, sizes, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                counts = unpack(counts, np.uint64)
                part = word_parts(groups, sizes, words, bits)
                of = np.repeat(np.arange(len(groups)), sizes)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
                rows = []
                for x, y in zip(cuts, cuts[1:]):
                    own = order[x:y]
                    rows.append((shard, int(part[own[0]]), None, None, pack(counts[own]),
                                 [words[i] for i in own], [groups[i] for i in of[own]]))
                yield batch_of(rows, ASKED, ASKED_TYPES)

    return run


def grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in ``column``."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def answer(level: int, least: int):
    """Sum each range; name what occurs often enough; tell every shard the names in its order."""
    def words_summed(rows: list[tuple]):
        place: dict[tuple[str, bytes], int] = {}
        asked = [np.array([place.setdefault(w, len(place)) for w in zip(r[6], r[5])], np.int64)
                 for r in rows]
        counts = np.concatenate([unpack(r[4], np.uint64) for r in rows])
        total = np.zeros(len(place), np.uint64)
        np.add.at(total, np.concatenate(asked), counts)
        kinds = list(place)
        return asked, total, lambda i: (None, None, kinds[i][1], kinds[i][0])

    def pairs_summed(rows: list[tuple]):
        a, b, n = (np.concatenate([unpack(r[c], np.uint64) for r in rows]) for c in (2, 3, 4))
        order = np.lexsort((b, a))
        new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order], first)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        cuts = np.cumsum([len(unpack(r[4], np.uint64)) for r in rows])[:-1]
        kinds = order[first]
        return np.split(place, cuts), total, lambda i: (int(a[kinds[i]]), int(b[kinds[i]]), None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 1):
            part = rows[0][1]
            asked, total, kind = (words_summed if level == 1 else pairs_summed)(rows)
            often = np.flatnonzero(total >= least)
            name = np.zeros(len(total), np.uint64)
            name[often] = (np.uint64(part + 1) << np.uint64(NAME_BITS)) + np.arange(
                len(often), dtype=np.uint64)
            out = [(r[0], part, pack(name[own]), *[None] * 6) for r, own in zip(rows, asked)]
            for at in range(0, len(often), 4096):
                out.extend((None, part, None, int(name[i]), *kind(i), int(total[i]))
                           for i in often[at:at + 4096].tolist())
                yield batch_of(out, ANSWERED, ANSWER_TYPES)
                out = []
            if out:
                yield batch_of(out, ANSWERED, ANSWER_TYPES)

    return run


# A shard's index (level 0) or an answer to it.
HELD = "shard long, level int, part int, groups array<string>, sizes array<int>, words array<binary>, data binary"


def ask_pairs(bits: int, level: int):
    """Extend every named phrase of ``level - 1`` words, and send the pairs of names and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 0):
            by: dict[int, list[tuple]] = {}
            for r in rows:
                by.setdefault(r[1], []).append(r)
            shard, _, _, groups, sizes, words, data = by[0][0]
            index = Shard(unpack(data, np.uint32).astype(np.int64), len(words))

            def answered(depth: int, part: np.ndarray) -> np.ndarray:
                """The names of one level in the shard's own order."""
                names = np.zeros(len(part), np.uint64)
                if depth in by:
                    names[np.argsort(part, kind="stable")] = np.concatenate(
                        [unpack(r[6], np.uint64) for r in by[depth]])
                return names

            named = index.named_words(answered(1, word_parts(groups, sizes, words, bits)))
            for depth in range(2, level + 1):
                first, end, a, b = index.longer(named)
                part = pair_parts(a, b, bits)
                if depth < level:
                    names = answered(depth, part)
                    named = np.zeros(len(named), np.uint64)
                    size = end - first
                    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    named[at] = np.repeat(names, size)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            out = []
            for x, y in zip(cuts, cuts[1:]):
                own = order[x:y]
                out.append((shard, int(part[own[0]]), pack(a[own]), pack(b[own]),
                            pack((end - first)[own].astype(np.uint64)), None, None))
            if out:
                yield batch_of(out, ASKED, ASKED_TYPES)

    return run


def named_phrases(df: DataFrame, group: str = "lang", text: str = "text", words: int = WORDS,
                  least: int = LEAST, shard_text: int = SHARD_TEXT, scratch: Scratch | None = None
                  ) -> tuple[list[DataFrame], DataFrame]:
    """([named phrases of 1, 2, ... words], (grp, n) all word occurrences by group).

    Words are (name, grp, word, n); longer phrases (name, a, b, n) with the names of all but the last
    and all but the first word.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "collocations")
    width = shuffle_width(spark)
    shards = scratch.keep(index(df, group, text, shard_text))
    size = df.agg(F.sum(F.octet_length(whole(text)))).first()[0] or 0
    bits = max(4 * width, size // RANGE_TEXT, 2).bit_length()
    state = shards.select("shard", F.lit(0).alias("level"), F.lit(-1).alias("part"), "groups", "sizes",
                          "words", F.col("bwt").alias("data"))
    found = []
    for level in range(1, words + 1):
        if level == 1:
            asked = shards.select("shard", "groups", "sizes", "words", "counts").mapInArrow(
                ask_words(bits), ASKED)
        else:
            asked = state.repartition(width, "shard").sortWithinPartitions(
                "shard", "level", "part").mapInArrow(ask_pairs(bits, level), ASKED)
        told = scratch.keep(asked.repartition(width, "part").sortWithinPartitions("part").mapInArrow(
            answer(level, least), ANSWERED))
        own = ["grp", F.col("word").cast("string").alias("word")] if level == 1 else ["a", "b"]
        found.append(told.where("name is not null").select("name", *own, "n"))
        state = state.unionByName(told.where("names is not null").select(
            "shard", F.lit(level).alias("level"), "part", F.col("names").alias("data")),
            allowMissingColumns=True)
    totals = shards.select("shard", "groups", "sizes", "counts").mapInArrow(counted, "grp string, n long")
    return found, totals.groupBy("grp").agg(F.sum("n").alias("n"))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word occurrences by group of each shard."""
    for batch in batches:
        rows = []
        for _, groups, sizes, counts in zip(*(c.to_pylist() for c in batch.columns)):
            counts, at = unpack(counts, np.uint64), 0
            for g, n in zip(groups, sizes):
                rows.append((g, int(counts[at:at + n].sum())))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                          pa.array([r[1] for r in rows], pa.int64())], names=["grp", "n"])


def mined(df: DataFrame, group: str = "lang", text: str = "text", words: int = WORDS, least: int = LEAST,
          cover: int = COVER, shard_text: int = SHARD_TEXT) -> DataFrame:
    """(grp, phrase, a, l, r, n, score) of every candidate that no longer one covers, all of them."""
    scratch = Scratch(df.sparkSession, "collocations")
    found, totals = named_phrases(df, group, text, words, least, shard_text, scratch)
    none = F.array().cast("array<bigint>")
    # ``heads`` and ``tails`` are the counts of the proper beginnings and ends, by rising length.
    known = found[0].select("name", "grp", F.col("word").alias("phrase"), F.col("word").alias("last"), "n",
                            none.alias("heads"), none.alias("tails"))
    out = None
    for level in range(2, words + 1):
        left = known.select(F.col("name").alias("a"), "grp", "phrase", F.concat(
            "heads", F.array("n")).alias("heads"))
        right = known.select(F.col("name").alias("b"), "last", F.concat("tails", F.array("n")).alias("tails"))
        known = scratch.keep(found[level - 1].join(left, "a").join(right, "b").select(
            "name", "a", "b", "grp", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n",
            "heads", "tails"))
        # "div" is exact on decimals; a quotient would be rounded before its floor is taken.
        cuts = F.expr(f"""transform(heads, (l, i) -> named_struct(
            'score', cast({SCALE} as decimal(20,0)) * cast(n as decimal(18,0))
                     div cast(l + element_at(tails, -(i + 1)) as decimal(20,0)),
            'k', i + 1, 'l', l, 'r', element_at(tails, -(i + 1))))""")
        scored = known.withColumn("cut", F.array_min(cuts)).select(
            "name", "grp", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
        if level < words:
            longer = found[level]
            most = longer.select(F.col("a").alias("name"), "n").unionByName(
                longer.select(F.col("b").alias("name"), "n")).groupBy("name").agg(F.max("n").alias("most"))
            scored = scored.join(most, "name", "left").where(
                f"most is null or cast(100 as decimal(20,0)) * most < cast({cover} as decimal(20,0)) * a"
            ).drop("most")
        scored = scored.drop("name")
        out = scored if out is None else out.unionByName(scored)
    return out.join(totals, "grp")


def best(df: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of every group, with their rank.

    Every salted part of a group keeps its first ``top`` rows, so that no group is sorted in one task.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").cast("binary")]
    some = df.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn(
        "place", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))).where(
        F.col("place") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast(
        "long")).where(F.col("rank") <= top).drop("salt", "place")


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(
    body, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM docs),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, ws[i:i + k - 1] AS g FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, range(1, 5) t(k))),
f AS (SELECT lang, g, count(*) AS c FROM grams GROUP BY lang, g HAVING count(*) >= {LEAST}),
cuts AS (SELECT f.lang, f.g, f.c AS a, k, x.c AS l, y.c AS r, ({SCALE}::HUGEINT * f.c // (x.c + y.c))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f) f
  JOIN f x ON x.lang = f.lang AND x.g = f.g[1:k] JOIN f y ON y.lang = f.lang AND y.g = f.g[k + 1:]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, sub, max(c) AS most FROM (
    SELECT lang, c, g[i:i + k - 1] AS sub FROM (
      SELECT lang, c, g, k, unnest(range(1, len(g) - k + 2)) AS i FROM f, range(2, 4) t(k) WHERE k < len(g)))
  GROUP BY lang, sub)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC,
    array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM low JOIN n USING (lang) LEFT JOIN inside ON inside.lang = low.lang AND sub = g
WHERE most IS NULL OR 100 * most < {COVER} * a
QUALIFY rank <= {TOP}
"""


@query("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(mined(table(spark, sf_dir, "documents"))).select(
        F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
