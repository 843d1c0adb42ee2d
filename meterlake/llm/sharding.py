"""Sharding: a Feistel permutation over global row numbers shuffles rows reproducibly.

The shuffled place of row r of n is permute(r); its shard is place mod shards and its slot
place div shards, so shard sizes differ by one at most, slots have no gaps, and either
direction is computed without a table of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import order, scratch
from meterlake.llm.text import U, mix

ROUNDS = 6


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _rounds(x: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    """The permutation of the least power-of-two range that holds n; halves may differ by a bit."""
    low, high = _halves(n)
    sizes = [(high, low) if r % 2 == 0 else (low, high) for r in range(ROUNDS)]
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        a_bits, b_bits = sizes[r]  # before round r the upper part has a_bits, the lower b_bits
        key = mix(np.array([(seed * 1000003 + r * 7919 + 1) % 2**64], np.uint64))[0]
        if inverse:
            b, a = x >> U(a_bits), x & U((1 << a_bits) - 1)
            a = a ^ (mix(b ^ key) & U((1 << a_bits) - 1))
            x = (a << U(b_bits)) | b
        else:
            a, b = x >> U(b_bits), x & U((1 << b_bits) - 1)
            a = a ^ (mix(b ^ key) & U((1 << a_bits) - 1))
            x = (b << U(a_bits)) | a
    return x


def permute(rows, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """A seeded permutation of 0 to n - 1. Values that leave the range walk on along their cycle."""
    x = np.asarray(rows).astype(np.uint64)
    if n < 2:
        return x.astype(np.int64)
    x = _rounds(x, n, seed, inverse)
    out = np.flatnonzero(x >= U(n))
    while len(out):
        x[out] = _rounds(x[out], n, seed, inverse)
        out = out[x[out] >= U(n)]
    return x.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(permute([row], n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that has this shard and slot."""
    return int(permute([slot * shards + shard], n, seed, inverse=True)[0])


def shard_rows(df: DataFrame, key: str, ties: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds row (rank by key, null first, then ties), shard int and slot long.

    Rows alike in key and ties are interchangeable: the set of results is the same on each run.
    An empty table gives no rows. Columns of these names are replaced, others stay."""
    needed = list(dict.fromkeys([key, *ties]))
    out, n = order.numbered(scratch.packed(df, *needed), key, ties, scratch.partitions(df.sparkSession), "row")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    out = out.withColumn("_place", place("row")).withColumn("shard", (F.col("_place") % shards).cast("int")).withColumn("slot", F.floor(F.col("_place") / shards).cast("long"))
    return scratch.unpacked(out, needed, df.columns, "row", "shard", "slot")


def op3_feistel_shards(spark, sf_dir: str, shards: int = 8, seed: int = 20) -> DataFrame:
    """All documents in shards 0 to 7 under the law "rows"."""
    text = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(rows, "doc_id", ["text_crc32", "size"], shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
