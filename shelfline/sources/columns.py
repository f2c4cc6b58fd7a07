"""Header rules: validation, mapping to standard names, date headers.

Each rule exists once, as a column expression over an ``array<string>`` of header names, so it runs
for millions of files as well as for one; :func:`header_map` is the same rule for the header of a
file being decoded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import let, literals, strip_space

# Field of a feed row -> the header it comes from.
FIELDS = dict(zip(["title", "brand", "availability", "price", "popularity_rank"],
                  fv.REQUIRED_COLUMNS))
_JUNK = "[\\x{0}\\x{FEFF}\\x{FFFE}]|\\x{FF}\\x{FE}|\\x{FE}\\x{FF}"


def scrub(text: Column) -> Column:
    """Drop NUL and byte-order marks, trim."""
    return strip_space(F.regexp_replace(text, _JUNK, ""))


def accepted_names(required: str) -> list[str]:
    """Lower-cased spellings of a required column, in order of preference.

    A trailing full stop more is accepted everywhere, by the check and by the mapping alike.
    """
    names = [required] + (fv.TITLE_ALIASES if required == "Title" else [])
    lowered = list(dict.fromkeys(n.lower() for n in names))
    return lowered + [n + "." for n in lowered]


def header_of(header: Column, required: str) -> Column:
    """The header used for a required column: best spelling, then leftmost; null if none."""
    bare = F.transform(header, lambda h: F.lower(strip_space(h)))
    names = literals(accepted_names(required))
    return let(bare, lambda b: let(
        F.filter(names, lambda n: F.array_contains(b, n)),
        lambda found: F.when(F.size(found) > 0, F.get(
            header, F.array_position(b, found[0]).cast("int") - 1))))


def missing_columns(files: DataFrame, ids: list[str], header: str = "header") -> DataFrame:
    """One issue per file and required column it lacks."""
    absent = F.filter(F.array(*[F.when(header_of(F.col(header), r).isNull(), F.lit(r))
                                for r in fv.REQUIRED_COLUMNS]), lambda r: r.isNotNull())
    return files.select(*ids, F.explode(absent).alias("missing"))


def column_mapping(files: DataFrame, ids: list[str], header: str = "header") -> DataFrame:
    """One row per file and feed field with the header that fills it (null if none)."""
    pairs = F.array(*[F.struct(F.lit(field).alias("field"),
                               header_of(F.col(header), required).alias("source"))
                      for field, required in FIELDS.items()])
    return files.select(*ids, F.explode(pairs).alias("_m")).select(*ids, "_m.*")


def missing_months(files: DataFrame, ids: list[str], required=("Dec",)) -> DataFrame:
    """Feeds without a required month."""
    wanted = files.sparkSession.createDataFrame([(m,) for m in required], "month string")
    feeds = files.select(*ids).distinct()
    asked = feeds.select(*ids, F.explode(F.array(*[F.lit(m) for m in required])).alias("month"))
    return asked.join(files.select(*ids, "month").distinct(), [*ids, "month"], "left_anti")


def header_map(header: list[str]) -> dict[str, int]:
    """Field -> position in one header, by the same order of preference."""
    bare = [str(h).strip().lower() for h in header]
    places = {}
    for field, required in FIELDS.items():
        found = [n for n in accepted_names(required) if n in bare]
        if found:
            places[field] = bare.index(found[0])
    return places


def date_header(name: Column) -> Column:
    """``2023-01-01 00:00:00`` or ``2023-01-01`` -> ``Jan 2023``; any other header as it is."""
    stamp = r"^(\d{4})-(\d{2})-\d{2}( \d{2}:\d{2}:\d{2})?$"
    month = F.regexp_extract(name, stamp, 2).try_cast("int")
    label = F.get(literals(fv.MONTHS), month - 1)
    return F.when(name.rlike(stamp) & label.isNotNull(), F.concat(
        label, F.lit(" "), F.regexp_extract(name, stamp, 1))).otherwise(name)


def rename_date_columns(df: DataFrame) -> DataFrame:
    """The same rule on a table's own column names."""
    import re

    def named(column: str) -> str:
        hit = re.fullmatch(r"(\d{4})-(\d{2})-\d{2}( \d{2}:\d{2}:\d{2})?", column)
        if hit and 1 <= int(hit.group(2)) <= 12:
            return f"{fv.MONTHS[int(hit.group(2)) - 1]} {hit.group(1)}"
        return column

    return df.toDF(*[named(c) for c in df.columns])


def trimmed_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def first_of_each_column(df: DataFrame) -> DataFrame:
    """Drop later columns of a name already seen."""
    unique = [f"_c{i}" for i in range(len(df.columns))]
    firsts = {c: u for u, c in reversed(list(zip(unique, df.columns)))}
    kept = [(u, c) for u, c in zip(unique, df.columns) if firsts[c] == u]
    return df.toDF(*unique).select(*[F.col(u).alias(c) for u, c in kept])


def volume_columns(columns: list[str]) -> dict[str, list[str]]:
    """Which columns of a side file carry volumes: monthly ones, the average, the peak."""
    monthly = [c for c in columns if re.fullmatch(
        r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4}", c)]
    lower = {c: c.lower() for c in columns}
    return {"monthly": monthly,
            "average": [c for c in columns if "avg" in lower[c] and (
                "msv" in lower[c] or "volume" in lower[c])],
            "peak": [c for c in columns if lower[c] == "peak seasonality"]}
