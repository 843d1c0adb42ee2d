"""Exact order statistics of a whole table by repeated histograms.

The range that holds a rank is cut into equal bins; the counts per bin tell which one holds it, and that
one is cut again, until it is a single value. Values are counted once before, so repeats cost nothing,
and every step reads only the range that is left. The driver sees one row a bin."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.session import stored

#: Bins of a range.
BINS = 4096


def at_ranks(df: DataFrame, value: Column, ranks_of, bins: int = BINS) -> list[int]:
    """The values at ranks, from 0, in ascending order. value is a long, nulls don't count; ranks_of
    gives the ranks for the number of values, each below it."""
    counts = stored(df.where(value.isNotNull()).groupBy(value.cast("long").alias("v")).agg(F.count("*").alias("n")), "counts")
    whole = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).first()
    if not whole.n:
        return []
    ranks = ranks_of(whole.n)
    # of each rank: the range that holds it, and how many values lie below that range
    place = {r: (whole.low, whole.high, 0) for r in ranks}
    while open_ := {x for x in place.values() if x[0] < x[1]}:
        for low, high, below in open_:
            width = -(-(high - low + 1) // bins)
            number = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(low)) / width).cast("long")
            part = counts.where(F.col("v").between(low, high)).groupBy(number.alias("bin")).agg(F.sum("n").alias("n"))
            found = sorted((r.bin, r.n) for r in part.collect())
            for rank in [r for r, x in place.items() if x == (low, high, below)]:
                before = below
                for bin_, n in found:
                    if rank < before + n:
                        at = low + bin_ * width
                        place[rank] = (at, min(at + width - 1, high), before)
                        break
                    before += n
    return [place[r][0] for r in ranks]


def median(df: DataFrame, value: Column, name: str, bins: int = BINS) -> DataFrame:
    """One row with the median of value as a double: the mean of the two middle ones where their number
    is even, null where there is none."""
    found = at_ranks(df, value, lambda n: [(n - 1) // 2, n // 2], bins)
    middle = 0.5 * found[0] + 0.5 * found[1] if found else None
    return df.sparkSession.createDataFrame([(middle,)], f"{name} double")
