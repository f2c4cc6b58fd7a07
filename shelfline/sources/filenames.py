"""Feed file names, months, and which file of a month counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import let, literals


def _month_name(raw: Column) -> Column:
    """Standard month of a spelled one, null for anything else."""
    aliases = F.create_map(*[F.lit(x) for pair in fv.MONTH_ALIASES.items() for x in pair])
    spelled = F.initcap(F.lower(raw))
    name = F.coalesce(F.try_element_at(aliases, spelled), spelled)
    return F.when(name.isin(fv.MONTHS), name)


def parse_file_name(name: Column) -> Column:
    """``struct<month, year, extension>`` of a file name; all null when it is no feed file.

    Only the first shape that fits is read, so a name is not rescued by a later one.
    """
    shapes = [f"(?idU){p}" for p in fv.FILE_NAME_PATTERNS]
    fitting = F.lit(None).cast("int")
    for i in reversed(range(len(shapes))):
        fitting = F.when(name.rlike(shapes[i]), F.lit(i)).otherwise(fitting)

    def group(shape: Column, n: int) -> Column:
        chosen = F.lit(None).cast("string")
        for i, pattern in enumerate(shapes):
            chosen = F.when(shape == i, F.regexp_extract(name, pattern, n)).otherwise(chosen)
        return chosen

    def read(shape: Column, month: Column) -> Column:
        return F.struct(
            month.alias("month"),
            F.when(month.isNotNull(), group(shape, 2).try_cast("int")).alias("year"),
            F.when(month.isNotNull(), F.lower(group(shape, 3))).alias("extension"))

    return let(fitting, lambda shape: let(
        let(group(shape, 1), _month_name), lambda month: read(shape, month)))


def with_file_parts(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Add ``month, year, extension`` of a file name column."""
    return files.withColumn("_parts", parse_file_name(F.col(name))).select("*", "_parts.*").drop(
        "_parts")


def month_number(month: Column) -> Column:
    """1 to 12, 0 for anything that is no month."""
    return F.coalesce(F.array_position(literals(fv.MONTHS), month), F.lit(0)).cast("int")


def file_status(files: DataFrame, archive: str = "archive", order: str = "file_seq") -> DataFrame:
    """Add ``accepted`` and ``issue`` to ``archive, file_seq, file_name, month, error`` rows.

    The first file of a month that could be read takes the month; the year is not part of it.
    Whatever comes later is a duplicate, readable or not.
    """
    usable = F.col("month").isNotNull() & F.col("error").isNull()
    taken = files.filter(usable).groupBy(F.col(archive).alias("_a"), F.col("month").alias("_m")).agg(
        F.min(order).alias("_taken"))
    joined = files.join(taken, (F.col(archive) == F.col("_a")) & (F.col("month") == F.col("_m")),
                        "left")
    issue = (F.when(F.col("month").isNull(), F.concat(
                F.lit(fv.BAD_NAME), F.col("file_name")))
             .when(F.col(order) > F.col("_taken"), F.concat(
                 F.lit(fv.SECOND_OF_MONTH), F.col("month")))
             .when(F.col("error").isNotNull(), F.concat(
                 F.lit(fv.UNREADABLE), F.col("file_name"), F.lit(": "), F.col("error"))))
    return joined.withColumn("issue", issue).withColumn(
        "accepted", F.col("issue").isNull()).drop("_a", "_m", "_taken")
