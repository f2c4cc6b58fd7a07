"""CSV members of any size, parsed by many tasks.

A member lies in blocks of bytes.  Where records end depends on whether a block begins inside quotes,
which depends on all blocks before it; so each block says, for every state of a CSV reader it might
begin in, the state it ends in.  Such outcomes compose, and one pass over them, a few bytes a block,
gives every block its beginning.  The text before a block's first end of record goes to the block where
that record began.  Each block is then read by itself, from the start of a record.

The dialect is judged the same way for all encodings, delimiters and numbers of skipped lines that the
first block does not rule out: what blocks count is summed over the member.  The result is that of reading the member at once.

Encodings are told apart by whole members too: a block is decoded from its first whole character to the
end of its last, which may lie in the next block, and what one block takes the next one must have left.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.session import broadcast_within
from shelfline.sources.columns import scrub

BLOCK_BYTES = 4 << 20
# Bytes of the next block that a block also has: the rest of a character.
AHEAD = 4
# States of a reader: at the start of a field, within a bare one, within quotes, after a quote there.
START, BARE, QUOTED, CLOSED = range(4)
OTHER, DELIMITER, END, QUOTE = range(4)
#: NEXT[symbol][state]
NEXT = np.array([[BARE, BARE, QUOTED, BARE], [START, START, QUOTED, START], [START, START, QUOTED, START],
                 [QUOTED, BARE, CLOSED, QUOTED]])
MEMBER = ["archive", "file_seq"]


# --- outcomes -------------------------------------------------------------------------------------

def _packed(steps: np.ndarray) -> np.ndarray:
    """Functions of four states as one byte each."""
    return (steps << (2 * np.arange(4))).sum(axis=-1).astype(np.uint8)


_ALL = np.arange(256)[:, None] >> (2 * np.arange(4)) & 3
#: THEN[f, g]: first f, then g.
THEN = _packed(_ALL[np.arange(256)[None, :, None], _ALL[:, None, :]])
STEP = _packed(NEXT)


def symbols(text: str, delimiter: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places) of a text; of a run of other characters, which do what one does, the first."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.zeros(len(codes), np.uint8)
    kind[codes == ord(delimiter)] = DELIMITER
    kind[(codes == 10) | (codes == 13)] = END
    kind[codes == 34] = QUOTE
    kept = np.flatnonzero((kind != OTHER) | np.append(True, kind[:-1] != OTHER)[:len(kind)])
    return kind[kept], kept


def outcome(kind: np.ndarray) -> int:
    """The composition of all steps of a text."""
    steps = STEP[kind]
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        steps = np.append(THEN[steps[:len(steps) - len(odd):2], steps[1::2]], odd)
    return int(steps[0]) if len(steps) else int(_packed(np.arange(4)))


def first_end(kind: np.ndarray, places: np.ndarray, state: int) -> int | None:
    """Where the first end of record is, read from ``state``."""
    for at in range(0, len(kind), 256):
        for k, place in zip(kind[at:at + 256].tolist(), places[at:at + 256].tolist()):
            if k == END and state != QUOTED:
                return place
            state = int(NEXT[k][state])
    return None


def after_lines(text: str, lines: int) -> tuple[int, int]:
    """(place after so many lines, lines still to skip)."""
    at = 0
    for found in re.finditer(r"\r\n|\r|\n", text):
        if not lines:
            break
        at, lines = found.end(), lines - 1
    return (at, lines) if not lines else (len(text), lines)


# --- decoding -------------------------------------------------------------------------------------

def decoded(content: bytes, ahead: bytes, lead: bytes, first: bool, encoding: str
            ) -> tuple[str, int, int] | None:
    """(text, bytes left to the block before, bytes taken from the next); None if it is not so encoded.

    ``lead`` is how the member begins.  Blocks begin at multiples of four bytes of it.
    """
    name, left, taken = encoding, 0, 0
    if encoding == "utf-16" and not first:
        name = "utf-16-be" if lead[:2] == b"\xfe\xff" else "utf-16-le"
    if encoding == "utf-8":
        while not first and left < min(3, len(content)) and content[left] & 0xC0 == 0x80:
            left += 1
        # A character whose first byte is in the block is the block's.
        for back in range(1, min(4, len(content) - left) + 1):
            byte = content[-back]
            if byte & 0xC0 != 0x80:
                size = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                taken = max(0, size - back)
                break
    elif encoding.startswith("utf-16"):
        big = name == "utf-16-be" or (name == "utf-16" and lead[:2] == b"\xfe\xff")
        high = 0 if big else 1
        if not first and len(content) >= 2 and content[high] & 0xFC == 0xDC:
            left = 2
        if len(content) - left >= 2 and len(content) % 2 == 0 and content[-2 + high] & 0xFC == 0xD8:
            taken = 2
    try:
        return (content[left:] + ahead[:taken]).decode(name), left, min(taken, len(ahead))
    except (UnicodeDecodeError, UnicodeError):
        return None


def readings(content: bytes, ahead: bytes, lead: bytes, first: bool) -> dict[str, tuple[str, int, int]]:
    """The text of a block by encoding, NUL characters gone, with its bytes left and taken."""
    out = {}
    for encoding in fv.CSV_ENCODINGS:
        got = decoded(content, ahead, lead, first, encoding)
        if got is not None:
            text = got[0].replace("\x00", "")
            out[encoding] = (text.lstrip("\ufeff") if first else text, *got[1:])
    return out


# --- blocks ---------------------------------------------------------------------------------------

def cut_blocks(pieces: Iterator[bytes], size: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(number, content, bytes ahead, how the member begins) of every block of a stream of bytes.

    Blocks end at multiples of four bytes, not within a character of one code unit and, where that
    can be had, not between the two characters that end a line.
    """
    held, number, lead = b"", 0, b""
    for piece in pieces:
        held += piece
        lead = lead or held[:4]
        while len(held) > size + AHEAD:
            end = size // 4 * 4
            while end > 4 and b"\r" in held[end - 4:end]:
                end -= 4
            end = end if end > 4 else size // 4 * 4
            yield number, held[:end], held[end:end + AHEAD], lead
            held, number = held[end:], number + 1
    if held or not number:
        yield number, held, b"", lead


# --- passes ---------------------------------------------------------------------------------------

BLOCK_ROW = "archive string, file_seq long, block long, content binary, ahead binary, lead binary"
OUTCOME = ("archive string, file_seq long, block long, encoding string, delimiter string, left int, "
           "taken int, closed boolean, steps array<int>, lines array<int>, heads array<string>")
# What a block needs to be read: its beginning under one dialect, or what a later block hands it.
DIALECT = "archive string, file_seq long, encoding string, delimiter string, skip int, endless boolean"
BEGINNING = ("archive string, file_seq long, block long, encoding string, delimiter string, skip int, "
             "lines int, state int, piece long, text string")
# How often dialects were whole, or what a block holds under one: records, longest, first of them.
COUNTED = ("archive string, file_seq long, block long, encoding string, delimiter string, skip int, "
           "records long, longest int, first array<string>")
RECORD = "archive string, file_seq long, block long, place long, cells array<string>"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
          "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[kind]) for n, kind in (x.split(" ") for x in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind])
                                       for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dialects that a member's first block does not rule out; ``endless``: no record ends there.

    One is ruled out if its header has a single column, or a whole record after it has more columns than
    the header: the member makes no table in it, whatever comes later.
    """
    for archive, seq, _, content, ahead, lead in _rows(batches):
        made, known = [], {}
        for encoding, (text, _, _) in readings(content, ahead, lead, True).items():
            for delimiter in fv.CSV_DELIMITERS:
                for skip in fv.CSV_SKIP_ROWS:
                    if (text, delimiter, skip) not in known:
                        known[text, delimiter, skip] = _may_be_table(text, delimiter, skip, bool(ahead))
                    possible, endless = known[text, delimiter, skip]
                    if possible:
                        made.append((archive, seq, encoding, delimiter, skip, endless))
        if made:
            yield _batch(made, DIALECT)


def _may_be_table(text: str, delimiter: str, skip: int, goes_on: bool) -> tuple[bool, bool]:
    """(may the member be a table, does no record end in its first block)."""
    header, last, own = None, None, text[after_lines(text, skip)[0]:]
    for record in _records(own, delimiter):
        # A record counts once another follows: the last one may not be whole.
        if last is not None:
            if header is None:
                header = last
                if len(header) < 2:
                    return False, False
            elif len(last) > len(header):
                return False, False
        last = record
    return (goes_on or header is not None or last is not None,
            header is None and first_end(*symbols(own, delimiter), START) is None)


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every encoding and delimiter of a block that may be its member's, what it does.

    ``steps`` and ``lines`` are, by number of lines to skip first, the composed steps after them and the
    lines still to skip; ``heads`` is, by state, the text up to the first end of record, null where
    none ends; ``closed``: does the text end with an end of line, null without text.
    """
    most = max(fv.CSV_SKIP_ROWS)
    for archive, seq, block, content, ahead, lead, pairs in _rows(batches):
        made, known = [], {}
        wanted = {(p["encoding"], p["delimiter"]) for p in pairs}
        for encoding, (text, left, taken) in readings(content, ahead, lead, block == 0).items():
            for delimiter in fv.CSV_DELIMITERS:
                if (encoding, delimiter) not in wanted:
                    continue
                if (text, delimiter) not in known:
                    kind, places = symbols(text, delimiter)
                    ends = [after_lines(text, n) for n in range(most + 1)]
                    cuts = np.searchsorted(places, [at for at, _ in ends]).tolist()
                    steps = [outcome(kind[cuts[-1]:])]
                    for x, y in zip(cuts[-2::-1], cuts[:0:-1]):
                        steps.append(int(THEN[outcome(kind[x:y]), steps[-1]]))
                    heads = [first_end(kind, places, state) for state in range(4)]
                    known[text, delimiter] = (text[-1] in "\r\n" if text else None, steps[::-1],
                                              [more for _, more in ends],
                                              [None if at is None else text[:at] for at in heads])
                made.append((archive, seq, block, encoding, delimiter, left, taken, *known[text, delimiter]))
        if made:
            yield _batch(made, OUTCOME)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the outcomes of a member in the order of its blocks, for all dialects at once.

    Rows are sorted by member and block; what is held is one small state for each dialect.  A dialect
    that the member cannot be read in has no beginning from there on.
    """
    member, out = None, []
    states: dict[tuple, list] = {}
    for archive, seq, block, encoding, delimiter, left, taken, closed, steps, lines, heads in _rows(batches):
        if (archive, seq) != member:
            member, states = (archive, seq), {}
        for skip in fv.CSV_SKIP_ROWS:
            own = (encoding, delimiter, skip)
            # Lines to skip, state, is a record open, block where it began, bytes owed, next block.
            more, state, opened, owner, owed, due = states.get(own, (skip, START, False, 0, 0, 0))
            if block != due or left != owed:
                continue
            head = (archive, seq, block, *own)
            if more or not opened:
                out.append((*head, more, -1, None, None))
                begun = lines[more] == 0
            else:
                out.append((*head, 0, state, None, None))
                text = heads[state]
                begun = text is not None
                # A null text, where no record ends: all of the block belongs to the record.
                out.append((archive, seq, owner, *own, 0, state, block, text))
            after = int(_ALL[steps[more], START if more or not opened else state])
            still = lines[more]
            if closed is not None:
                opened = not still and not (closed and after == START)
            states[own] = (still, START if still else after, opened, block if begun else owner, taken,
                           block + 1)
        if len(out) > 512:
            yield _batch(out, BEGINNING)
            out = []
    if out:
        yield _batch(out, BEGINNING)


def _records(text: str, delimiter: str) -> Iterator[list[str]]:
    csv.field_size_limit(2 ** 31 - 1)
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
            if any(c.strip() for c in r))


# A block, its beginnings (order 0), or a piece of text for its last record.
PART = ("archive string, file_seq long, block long, piece long, content binary, ahead binary, lead binary, "
        "encoding string, delimiter string, skip int, lines int, state int, text string")


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(archive, file_seq, block, encoding, delimiter, skip, text) of blocks from record to record."""
    def finished(parts: list[tuple]) -> Iterator[tuple]:
        archive, seq, block, _, content, ahead, lead = parts[0][:7]
        if content is None:
            return
        texts = {k: v[0] for k, v in readings(content, ahead, lead, block == 0).items()}
        tails: dict[tuple, list[str]] = {}
        for p in parts[1:]:
            if p[3] >= 0:
                tails.setdefault(p[7:10], []).append(p[12])
        for p in parts[1:]:
            if p[3] >= 0:
                continue
            encoding, delimiter, skip, lines, state = p[7:12]
            text = texts[encoding]
            if state < 0:
                at, more = after_lines(text, lines)
                text = "" if more else text[at:]
            else:
                at = first_end(*symbols(text, delimiter), state)
                text = "" if at is None else text[at + 1:]
            yield archive, seq, block, encoding, delimiter, skip, text + "".join(
                tails.get((encoding, delimiter, skip), []))

    parts: list[tuple] = []
    for row in _rows(batches):
        if parts and parts[0][:3] != row[:3]:
            yield from finished(parts)
            parts = []
        parts.append(row)
    if parts:
        yield from finished(parts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, known = None, {}
    for archive, seq, block, encoding, delimiter, skip, text in _readable(batches):
        if place != (archive, seq, block):
            place, known = (archive, seq, block), {}
        # Most encodings, and after the first block all numbers of skipped lines, give one text.
        if (delimiter, text) not in known:
            records, longest, first = 0, 0, None
            for record in _records(text, delimiter):
                first = record if first is None else first
                records, longest = records + 1, max(longest, len(record))
            known[delimiter, text] = records, longest, first
        yield _batch([(archive, seq, block, encoding, delimiter, skip, *known[delimiter, text])], COUNTED)


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings whose text is all of a block, with that text."""
    for *head, piece, _, content, ahead, lead in _rows(batches):
        text = readings(content, ahead, lead, piece == 0)[head[3]][0]
        yield _batch([(*head, piece, text)], BEGINNING)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for archive, seq, block, _, delimiter, _, text in _readable(batches):
        out = []
        for place, record in enumerate(_records(text, delimiter)):
            out.append((archive, seq, block, place, record))
            if len(out) >= 20_000:
                yield _batch(out, RECORD)
                out = []
        if out:
            yield _batch(out, RECORD)


def _typed(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[x.split(" ")[0] for x in ddl.split(", ")])


def _parts(blocks: DataFrame, beginnings: DataFrame) -> DataFrame:
    """Blocks with what they need to be read, side by side and in order."""
    none = {"string": "cast(null as string)", "int": "cast(null as int)"}
    left = blocks.selectExpr("archive", "file_seq", "block", "-2L as piece", "content", "ahead", "lead", *[
        f"{none[k]} as {n}" for n, k in (x.split(" ") for x in PART.split(", ")[7:])])
    right = beginnings.selectExpr(
        "archive", "file_seq", "block", "coalesce(piece, -1L) as piece", "cast(null as binary) as content",
        "cast(null as binary) as ahead", "cast(null as binary) as lead", "encoding", "delimiter", "skip",
        "lines", "state", "text")
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(width, *MEMBER, "block").sortWithinPartitions(
        *MEMBER, "block", "piece")


def split_tables(blocks: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """((archive, file_seq, row_seq, cells) of every record, (archive, file_seq, dialect, header)).

    ``blocks`` has the rows of ``cut_blocks``; it is read four times, so it should be written.  Records
    are numbered from 0 after the header.  A member that no dialect makes a table has no dialect.
    ``keep`` writes a small table once and reads it back.
    """
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _typed(blocks, BLOCK_ROW)
    dialect = ["encoding", "delimiter", "skip"]
    may = keep(_typed(blocks.where("block = 0").repartition(width, *MEMBER), BLOCK_ROW).mapInArrow(
        _plausible, DIALECT))
    # Some dialects of each member beyond a block: bounded by a check before they are broadcast.
    pairs = broadcast_within(may.groupBy(*MEMBER).agg(F.collect_set(F.struct(
        "encoding", "delimiter")).alias("pairs")))
    # A few blocks a task: one task wrote all blocks of a member, and would read them as one batch.
    spread = blocks.repartition(width, *MEMBER, "block").join(pairs, MEMBER)
    outcomes = spread.select(*blocks.columns, "pairs").mapInArrow(_outcomes, OUTCOME)
    # The outcomes of a member are small and have an order.
    begun = keep(outcomes.repartition(width, *MEMBER).sortWithinPartitions(
        *MEMBER, "block", "encoding", "delimiter").mapInArrow(_beginnings, BEGINNING))
    begun = begun.join(broadcast_within(may), [*MEMBER, *dialect])
    sizes = blocks.groupBy(*MEMBER).agg(F.count("*").alias("blocks"))
    spanned = F.col("piece").isNotNull() & F.col("text").isNull()
    # Where no record ends in any block there is one record, and no table.  Text of one byte a character
    # reads so in encodings of two; without this, a member's first block would be handed all of its text.
    whole = begun.groupBy(*MEMBER, *dialect, "endless").agg(
        F.count_if(F.col("piece").isNull()).alias("blocks"),
        F.count_if(spanned & (F.col("block") == 0)).alias("spans")).where(
        "not endless or spans < blocks - 1").join(sizes, [*MEMBER, "blocks"], "left_semi")
    ready = begun.drop("endless").join(whole.select(*MEMBER, *dialect), [*MEMBER, *dialect], "left_semi")
    if ready.where(spanned).limit(1).count():
        texts = ready.where(spanned).join(blocks.select(*MEMBER, F.col("block").alias("piece"), "content",
                                                        "ahead", "lead"), [*MEMBER, "piece"])
        ready = ready.where(~spanned).unionByName(keep(texts.select(
            *[x.split(" ")[0] for x in BEGINNING.split(", ")], "content", "ahead", "lead").repartition(
            width, *MEMBER, "piece").mapInArrow(_whole_texts, BEGINNING)))
    counts = _typed(_parts(blocks, ready), PART).mapInArrow(_counts, COUNTED)
    judged = keep(counts.groupBy(*MEMBER, *dialect).agg(
        F.sum("records").alias("records"), F.max("longest").alias("longest"),
        F.min_by("first", F.when(F.col("records") > 0, F.col("block"))).alias("header")))
    scored = judged.withColumn("score", _score()).where("score > 0")
    order = F.struct(-F.col("score"), F.array_position(_listed(fv.CSV_ENCODINGS), F.col("encoding")),
                     F.array_position(_listed(fv.CSV_DELIMITERS), F.col("delimiter")), F.col("skip"))
    best = scored.groupBy(*MEMBER).agg(F.min_by(F.struct(*dialect, "header"), order).alias("best"))
    chosen = keep(sizes.join(best, MEMBER, "left").select(*MEMBER, "best.*"))
    own = ready.join(chosen.select(*MEMBER, *dialect), [*MEMBER, *dialect], "left_semi")
    records = keep(_typed(_parts(blocks, own), PART).mapInArrow(_cells, RECORD))
    before = records.groupBy(*MEMBER, "block").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy(*MEMBER).orderBy("block").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("n")
    numbered = records.join(before, [*MEMBER, "block"]).withColumn(
        "row_seq", F.col("before") + F.col("place") - 1).where("row_seq >= 0").select(
        *MEMBER, "row_seq", "cells")
    return numbered, chosen


def _listed(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _score() -> Column:
    """Worth of a dialect: expected columns, then columns, then rows; 0 if it makes no table."""
    names = F.transform("header", lambda h: F.lower(scrub(h)))
    known = F.size(F.filter(_listed(fv.CSV_EXPECTED_COLUMNS), lambda e: F.array_contains(
        names, e) | F.array_contains(names, F.concat(e, F.lit(".")))))
    width = F.size("header")
    return F.when((width >= 2) & (F.col("longest") <= width) & (F.col("records") > 1),
                  fv.CSV_MATCH_WEIGHT * known + fv.CSV_COLUMN_WEIGHT * width + F.col("records") - 1).otherwise(0)
