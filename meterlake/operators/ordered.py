"""Positions and running sums over a whole table, without a window in one task.

Rows fall in chunks of their order's leading number. Each chunk is sorted by itself and starts
at the sum of those before it; only one row a chunk passes through the single-task window."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.session import stored


def running(df: DataFrame, lead: Column, chunk: int, order: list, sums: dict[str, Column], position: str | None = None, whole: dict[str, Column] | None = None, by: str | None = None) -> DataFrame:
    """Adds running sums, and the position from 0, in the order by lead (a long) and then order;
    whole: sums over all rows. by: a column each of whose values has sums of its own.

    The chunks' totals are a second, narrow pass over df: only what the sums need is read again."""
    df = df.withColumn("_chunk", F.floor(lead / chunk))
    make = dict(sums) | ({position: F.lit(1)} if position else {})
    if not make:
        return df.drop("_chunk")
    all_ = whole or {}
    own = [by] if by else []
    totals = df.groupBy(*own, "_chunk").agg(*[F.sum(x).alias(f"_{k}") for k, x in (make | all_).items()])
    before = Window.partitionBy(*own).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*own).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(*[F.col(c).alias("__by") for c in own], F.col("_chunk").alias("__chunk"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in make], *[F.sum(f"_{k}").over(every).alias(k) for k in all_])
    within = Window.partitionBy(*own, "_chunk").orderBy(lead, *order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_chunk") == F.col("__chunk")
    same = same & F.col(by).eqNullSafe(F.col("__by")) if by else same
    out = df.withColumns({k: F.sum(x).over(within) for k, x in make.items()}).join(bases, same)
    out = out.withColumns({k: F.col(k) + F.col(f"_{k}") - (1 if k == position else 0) for k in make})
    return out.drop("_chunk", "__chunk", "__by", *[f"_{k}" for k in make])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the position from 0 in an order that no number leads, such as a collation. Ranges of the order
    are written and sorted by themselves; only one row a range passes through the single-task window."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order)
    out = rows.withColumn(name, F.row_number().over(within) - 1).join(bases, "_range")
    return out.withColumn(name, (F.col(name) + F.col("_base")).cast("long")).drop("_range", "_base")
