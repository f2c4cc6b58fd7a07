"""Peak months of a product as one column expression over its twelve month columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.functions.text import let

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """Double where the text is a plain number, null otherwise (never an error)."""
    bare = F.trim(text.cast("string"))
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def peak_months(by_month: list[tuple[str, Column]], keep: int = 4, need: int = 3,
                lowest_first: bool = True) -> Column:
    """Stable months among the ``keep`` best ones.

    ``by_month`` holds (label, value) in calendar order, which also settles ties.  Fewer than
    ``need`` values give an empty text.  Months no further from the mean of the best ``keep`` than
    their population standard deviation survive, best first; if none does, the best month stands.
    Sums run as folds over the sorted array, so the result does not depend on evaluation order.
    """
    sign = 1 if lowest_first else -1
    entries = F.filter(
        F.array(*[F.struct((value * sign).alias("v"), F.lit(i).alias("i"), F.lit(label).alias("m"))
                  for i, (label, value) in enumerate(by_month)]),
        lambda e: e["v"].isNotNull())

    def stable(best: Column) -> Column:
        n = F.size(best)
        mean = F.aggregate(best, F.lit(0.0), lambda acc, e: acc + e["v"]) / n

        def within(mu: Column) -> Column:
            square = lambda e: (e["v"] - mu) * (e["v"] - mu)
            deviation = F.sqrt(F.aggregate(best, F.lit(0.0), lambda acc, e: acc + square(e)) / n)
            return let(deviation, lambda sd: F.filter(best, lambda e: F.abs(e["v"] - mu) <= sd))

        return let(mean, within)

    def label(best: Column) -> Column:
        return let(stable(best), lambda kept: F.when(F.size(kept) > 0, F.array_join(
            F.transform(kept, lambda e: e["m"]), ", ")).otherwise(best[0]["m"]))

    return let(F.slice(F.array_sort(entries), 1, keep), lambda best: F.when(
        F.size(best) >= min(need, keep), label(best)).otherwise(F.lit("")))


def peak_popularity(columns: dict[str, str]) -> Column:
    """Peak months from popularity ranks: a low rank is a good month."""
    return peak_months([(m, F.col(columns[m])) for m in fv.MONTHS])
