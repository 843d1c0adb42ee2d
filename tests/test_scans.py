"""Scans over chunks and order statistics against plain windows and loops."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterlake.operators import ranks
from meterlake.operators.carry import carried, carried_on


def logs(seed: int) -> list[tuple]:
    """path, byte_offset, value, clears: one log is by far the longest; whole stretches do nothing."""
    rng = random.Random(seed)
    rows = []
    for path, n in (("long", 600), ("a", 40), ("b", 1), ("quiet", 50)):
        at = 0
        for _ in range(n):
            act = rng.random() if path != "quiet" and at // 900 % 3 else 1
            value = f"v{rng.randrange(99)}" if act < 0.3 else None
            rows.append((path, at, value, rng.choice([True, None]) if act < 0.15 or act > 0.95 and act < 1 else False))
            at += rng.randrange(1, 60)
    rng.shuffle(rows)
    return rows


def stepwise(rows):
    out, after, now = {}, {}, {}
    for path, at, value, clears in sorted(rows, key=lambda r: r[:2]):
        out[path, at] = now.get(path)
        if clears:
            now[path] = None
        elif value is not None:
            now[path] = value
        after[path] = now.get(path)
    return out, {p: v for p, v in after.items() if v is not None}


@pytest.mark.parametrize("chunk", [1, 50, 1000, 1 << 24])
def test_carried(spark, chunk):
    rows = logs(chunk)
    df = spark.createDataFrame(rows, "path string, byte_offset long, value string, clears boolean").repartition(3)
    want, after = stepwise(rows)
    got = carried(df, F.col("value"), F.col("clears"), "c", chunk=chunk).collect()
    assert len(got) == len(rows) and {(r.path, r.byte_offset): r.c for r in got} == want
    assert {r.path: r.v for r in carried_on(df, F.col("value"), F.col("clears"), "v").collect()} == after


def test_carried_sorts_chunks_only(spark):
    """No window of the plan sorts the lines of a whole file."""
    df = spark.createDataFrame(logs(1), "path string, byte_offset long, value string, clears boolean")
    plan = carried(df, F.col("value"), F.col("clears"), "c")._jdf.queryExecution().analyzed().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2 and all("_chunk" in x for x in windows)
    assert sum("byte_offset" in x.split("specifiedwindowframe")[0] or "byte_offset" in x for x in windows) == 1


VALUES = [[], [7], [3, 9], [5] * 9, [1, 2, 2, 2, 9, 9], [0, 2**52], [-(2**62), 2**62, 5], list(range(1001)), [None, 4, None, 8]]


@pytest.mark.parametrize("values", VALUES, ids=lambda v: f"{len(v)}-{str(v[:2])}")
@pytest.mark.parametrize("bins", [2, 64])
def test_median(spark, values, bins):
    known = [v for v in values if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = ranks.median(df, F.col("x"), "m", bins).first().m
    assert got == (statistics.median(known) if known else None) == df.agg(F.median("x")).first()[0]


def test_ranks(spark):
    rng = random.Random(2)
    values = [int(rng.paretovariate(0.5)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(4)
    wanted = [0, 1, 299, 1500, 2998, 2999]
    assert ranks.at_ranks(df, F.col("x"), lambda n: wanted, 16) == [sorted(values)[r] for r in wanted]


def test_windows_agree(spark):
    """As the windows over whole files that the scan took the place of."""
    df = spark.createDataFrame(logs(9), "path string, byte_offset long, value string, clears boolean")
    own = Window.partitionBy("path").orderBy("byte_offset")
    cleared = F.coalesce(F.sum(F.when(F.col("clears"), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("path", "g").orderBy("byte_offset").rowsBetween(Window.unboundedPreceding, -1)
    old = df.withColumn("g", cleared).withColumn("c", F.last("value", ignorenulls=True).over(within)).drop("g")
    assert carried(df, F.col("value"), F.col("clears"), "c", chunk=300).exceptAll(old).isEmpty()
