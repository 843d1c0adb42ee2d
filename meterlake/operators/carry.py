"""Values carried forward along a file's lines, as a scan over chunks of the file.

What a line does to the value that is carried is an operation: it leaves the value, sets it, or clears
it. Operations compose, and what a whole chunk does is what its last operation does. So each chunk is
summed up by one row; the value at a chunk's beginning comes from the rows of the chunks before it, and
only lines of one chunk are sorted together. A file of any length needs no task that holds it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a chunk: bytes, where lines are ordered by their offsets.
CHUNK = 16 << 20


def _operation(value: Column, clears: Column) -> Column:
    """null where a line leaves the value, else a struct of what it becomes."""
    clear = F.coalesce(clears, F.lit(False))
    return F.when(clear | value.isNotNull(), F.struct(F.when(~clear, value).alias("v")))


def _last(operation: str, order: str) -> Column:
    return F.max_by(operation, F.when(F.col(operation).isNotNull(), F.col(order)))


def carried(lines: DataFrame, value: Column, clears: Column, name: str, path: str = "path", order: str = "byte_offset", chunk: int = CHUNK, raw: DataFrame | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds the latest value before each line of its file, forgotten after a line that clears it.

    value: null where a line has none. clears is seen by the lines after it; a line that clears carries
    nothing on. order: a number that no two lines of a file share; it decides the chunk.

    Only files of several chunks are summed up, one path for each chunk at most. raw and made: where lines
    are made(raw) at some cost, those of other files aren't made again for it."""
    place = F.coalesce(F.floor(F.col(order) / chunk), F.lit(-1)).cast("long")
    dealt = lambda df: df.withColumns({"_operation": _operation(value, clears), "_chunk": place})
    behind = (F.col(order) >= chunk) | (F.col(order) < 0) | F.col(order).isNull()
    raw, made = (lines, lambda df: df) if raw is None or made is None else (raw, made)
    several = raw.where(behind).select(path).distinct()
    sums = dealt(made(raw.join(F.broadcast(several), path, "left_semi"))).groupBy(path, "_chunk").agg(_last("_operation", order).alias("_last"))
    before = Window.partitionBy(path).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    entry = sums.withColumn("_entry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    own = Window.partitionBy(path, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt(lines).withColumn("_own", F.last("_operation", ignorenulls=True).over(own))
    rows = rows.join(entry.where("_entry is not null"), [path, "_chunk"], "left")
    return rows.withColumn(name, F.coalesce("_own", "_entry")["v"]).drop("_operation", "_chunk", "_own", "_entry")


def carried_on(lines: DataFrame, value: Column, clears: Column, name: str, path: str = "path", order: str = "byte_offset") -> DataFrame:
    """path and the value, if there is one, that each file's lines carry on behind their last."""
    rows = lines.select(path, order, _operation(value, clears).alias("_operation"))
    return rows.groupBy(path).agg(_last("_operation", order)["v"].alias(name)).where(F.col(name).isNotNull())
