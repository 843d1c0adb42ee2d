"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Each unit vector o is rotated by a seeded random rotation; its code is the signs of the rotated
components, its factor f the inner product of the rotated vector with its own scaled code. For
any other rotated vector q, <code, q> / f is an unbiased estimate of <o, q>, and the error is
below EPSILON * sqrt((1 - f * f) / f / f / (D - 1)) but for a small, known share of pairs. Only
pairs whose upper bound reaches the threshold are computed exactly, in double precision.

Which pairs are estimated at all: signs along further random directions give each vector a key
in each of several tables; pairs meet where they share a key, and count in the first table where
they do. A bucket above BLOCK vectors is cut in blocks, and each pair of blocks is a group.

What goes through the shuffle to every table is a vector's code, its factor and its rotated
components in 8 bits each, whose rounding widens the bound. A group answers with those of its
vectors that have a pair to recompute, a row each at most and never a row a pair; these alone
are sent again as whole vectors."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import graph, scratch

#: Vectors in a block; a group holds two blocks at most.
BLOCK = 1024
#: Width of the confidence bounds, in standard errors.
EPSILON = 4.0
#: Vectors expected in a bucket, and the share of pairs at the threshold that meet in some table.
BUCKET, RECALL = 256, 0.97


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factor of each row."""
    o = unit @ turn.T
    return np.packbits(o >= 0, axis=1), np.abs(o).sum(axis=1) / math.sqrt(o.shape[1])


def compared(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded rows with rotated ones, and each coded row's bound on the error."""
    d = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    got = signs @ turned.T.astype(np.float32) / (math.sqrt(d) * factors[:, None])
    return got, EPSILON * np.sqrt((1 - factors**2).clip(0) / factors**2 / max(1, d - 1))


def estimate(codes: np.ndarray, factors: np.ndarray, other: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """compared, for rows of other that are yet to be rotated."""
    return compared(codes, factors, other @ turn.T)


def rounded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated rows in 8 bits a component, and each row's step between two of their values."""
    step = np.abs(turned).max(axis=1) / 127
    return np.rint(turned / step[:, None]).astype(np.int8), step


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors: buckets keep their size as n grows."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(1, round(math.log2(max(2, n / BUCKET)))))
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - same**bits)))


def _keys(small: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """A key for each row and table. Sums of whole numbers: they come out alike wherever they are made."""
    planes = np.rint(np.random.default_rng(seed + 1).standard_normal((small.shape[1], bits * tables)) * 1024)
    signs = (small.astype(float) @ planes >= 0).reshape(len(small), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _coded(df: DataFrame, vector: str, bits: int, tables: int, seed: int) -> DataFrame:
    """id, copies, unit vector, code, factor, rounded components and keys; vectors are of one length,
    known from each row."""
    to = "id long, copies long, unit binary, code binary, factor double, small binary, step double, key_list array<int>"
    names = ["id", "copies", "unit", "code", "factor", "small", "step", "key_list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch["_bytes"].to_pylist()]) // 8
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                x = np.frombuffer(b"".join(part["_bytes"].to_pylist()), "<f8").reshape(-1, d)
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                turn = rotation(d, seed)
                codes, factors = encode(unit, turn)
                small, step = rounded(unit @ turn.T)
                keys = _keys(small, bits, tables, seed)
                whole, code, eighths = (pa.array([r.tobytes() for r in m], pa.binary()) for m in (unit, codes, small))
                key_list = pa.array([k.tolist() for k in keys], pa.list_(pa.int32()))
                arrays = [part["id"], part["copies"], whole, code, pa.array(factors), eighths, pa.array(step), key_list]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, to)


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _sides(key: tuple, group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None, int]:
    """A group's blocks, and where the second begins; none if the group is one block with itself."""
    _, _, one, two, _ = key
    if one == two:
        return group, None, 0
    group = group.sort_values("block", kind="stable", ignore_index=True)
    m = int((group["block"] == one).sum())
    return group.iloc[:m], group.iloc[m:], m


def _may_reach(coded: pd.DataFrame, turned: pd.DataFrame, threshold: float) -> np.ndarray:
    """Whether the upper bound of a coded row's inner product with a rotated one reaches the threshold."""
    factors, step = coded["factor"].to_numpy(), turned["step"].to_numpy()
    small = _matrix(turned["small"], "i1")
    got, bound = compared(_matrix(coded["code"], "u1"), factors, small * step[:, None])
    slack = math.sqrt(small.shape[1]) / 2 * step[None, :] / factors[:, None]
    return got + bound[:, None] + slack >= threshold


def _to_recompute(left: pd.DataFrame, right: pd.DataFrame | None, table: int, threshold: float, plan: tuple[int, int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, by place, whose upper bounds reach the threshold by either's code, and that no table before
    this one joins."""
    if not len(left) or right is not None and not len(right):
        return np.zeros(0, int), np.zeros(0, int)
    small = _matrix(left["small"], "i1")
    other = small if right is None else _matrix(right["small"], "i1")
    may = _may_reach(left, right if right is not None else left, threshold)
    may &= may.T if right is None else _may_reach(right, left, threshold).T
    i, j = np.nonzero(may)
    if right is None:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        first = np.ones(len(i), bool)
        (a, i_at), (b, j_at) = (np.unique(x, return_inverse=True) for x in (i, j))
        k1, k2 = _keys(small[a], *plan, seed), _keys(other[b], *plan, seed)
        for t in range(table):
            first &= k1[i_at, t] != k2[j_at, t]
        i, j = i[first], j[first]
    return i, j


def _group_suspects(threshold: float, plan: tuple[int, int], seed: int):
    """Of a group those vectors that have a pair to recompute."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, right, m = _sides(key, group)
        i, j = _to_recompute(left, right, key[0], threshold, plan, seed)
        no = (left if right is None else pd.concat([left, right]))[["no", "block"]]
        out = no.iloc[np.unique(np.concatenate([i, j + m]))]
        return out.assign(**dict(zip(("table", "bucket", "one", "two", "dims"), key, strict=True)))

    return run


def _group_links(threshold: float, plan: tuple[int, int], seed: int):
    """Links within one group: of the one block's vectors, or between the two blocks'."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, right, m = _sides(key, group)
        i, j = _to_recompute(left, right, key[0], threshold, plan, seed)
        whole = left if right is None else pd.concat([left, right])
        ids, copies, x = whole["id"].to_numpy(), whole["copies"].to_numpy(), _matrix(whole["unit"], "<f8")
        j = j + m
        parts = [slice(a, a + 65536) for a in range(0, len(i), 65536)]
        exact = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[i[p]], x[j[p]]) for p in parts]])
        i, j = i[exact >= threshold], j[exact >= threshold]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = ids.copy()
        while len(i):  # the least id that links inside the group reach
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if (before == root).all():
                break
        has = links > 0
        return pd.DataFrame({"id": ids[has], "links": links[has].astype("int64"), "root": root[has]})

    return run


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = 0.9, seed: int = 11) -> DataFrame:
    """key, n_links, component_id and kept for every row.

    Vectors that are null or zero or hold null or non-finite components, and rows without a key,
    link with nothing; so do vectors of different lengths. Exact copies are one vector with a
    count until the end. Other columns, whatever their names, are not read. Vectors of any length
    are compared whole, though a task makes a rotation of its square. An empty table gives no rows."""
    spark = df.sparkSession
    x = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else (np.asarray(v, "<f8") + 0.0).tobytes())

    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(good, F.lit(False)).alias("good"), packed(F.when(good, x)).alias("_bytes"))
    rows = scratch.written(rows.withColumn("_sum", F.md5("_bytes")), "vectors")
    one = rows.where("good").groupBy("_sum").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("_bytes").alias("_bytes"))
    n = one.count()
    shape = plan(n, threshold)
    coded = _coded(one, "_bytes", *shape, seed).withColumn("no", F.monotonically_increasing_id())
    coded = scratch.written(coded, "coded")
    at = ["table", "bucket", "dims"]
    placed = coded.withColumn("dims", F.octet_length("small")).select("dims", "no", "code", "factor", "small", "step", F.posexplode("key_list").alias("table", "bucket"))
    counts = placed.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(counts.where("blocks > 1"), at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("no", F.lit(seed)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("one", F.least("block", "with")).withColumn("two", F.greatest("block", "with")).drop("blocks", "with")
    group = ["table", "bucket", "one", "two", "dims"]
    suspects = placed.groupBy(*group).applyInPandas(_group_suspects(threshold, shape, seed), "no long, block int, table int, bucket int, one int, two int, dims int")
    suspects = scratch.written(suspects, "suspects").join(coded.drop("key_list"), "no")
    found = suspects.groupBy(*group).applyInPandas(_group_links(threshold, shape, seed), "id long, links long, root long")
    found = scratch.written(found, "links")
    whole = graph.components(found.where("id <> root"), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = one.select("_sum", F.col("id").alias("first"), "copies").join(links.withColumnRenamed("id", "first"), "first", "left").join(whole.withColumnRenamed("id", "first"), "first", "left")
    label = label.select("_sum", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = rows.join(label, "_sum", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op10_rotation_codes(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
