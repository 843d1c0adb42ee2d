"""Approximate nearest neighbours by largest inner product, with adaptive dimension scans.

Vectors lie in lists by their nearest centroid; the centroids are fitted on a bounded sample, every
vector is in a list. A query probes the lists whose centroids have the largest inner products with it;
how many, the sample tells: so many that sampled queries find RECALL of their true neighbours.

Within a list all vectors are turned by one random rotation and scanned in column blocks. After each
block, a candidate's squared distance over the columns so far is a random share of its whole squared
distance, by a known law. If it is larger than that share may be for a candidate that beats the query's
k-th best so far, but for one case in 1 / MISS, the candidate is abandoned. What is left after
the last test is computed in double precision on the original vectors. Some vectors of the sample, the
seeds, give each query its first threshold; they lie in no list, as every query meets them.

Equal vectors are one vector with their least ids until the end."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from meterlake.llm import scratch
from meterlake.llm.embeddings import rotation

#: The sample that the index is fitted on: vectors a list, lists, and components in all, at most.
A_LIST, LISTS, SAMPLE_VALUES = 64, 1024, 1 << 24
#: Lloyd steps, sampled queries, and the share of their true neighbours that probing must find.
STEPS, ASKED, RECALL = 8, 256, 0.97
#: Seeds by their bytes and as a share of all vectors, at most, and the chance that a test abandons a true neighbour.
SEED_BYTES, SEED_SHARE, MISS = 2 << 20, 1 / 8, 0.001
#: Columns of a block, vectors and queries that one task scans at once.
COLUMNS, TILE_QUERIES, TILE_VECTORS = 16, 256, 1024
#: Bytes of the vectors, and queries, of a group, at most (about, as they are dealt out by hash).
VECTOR_BYTES, QUERIES = 16 << 20, 4_096


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order wherever it stands."""
    parts = [(a[i : i + 16_384] * b[i : i + 16_384]).sum(axis=1) for i in range(0, len(a), 16_384)]
    return np.concatenate(parts) if parts else np.zeros(0)


def shares(d: int, columns: int = COLUMNS, miss: float = MISS, seed: int = 5) -> list[tuple[int, int, float]]:
    """Begin and end of each column block, and the share of its squared length that a randomly turned
    vector has in the columns up to there, which it exceeds with chance miss. 1 in the last block."""
    ends = [*range(columns, d, columns), d]
    squares = np.random.default_rng(seed).chisquare(np.diff([0, *ends]), (int(40 / miss), len(ends)))
    part = np.cumsum(squares, axis=1) / squares.sum(axis=1, keepdims=True)
    limits = np.quantile(part, 1 - miss, axis=0)
    limits[-1] = 1.0
    return list(zip([0, *ends[:-1]], ends, limits.tolist(), strict=True))


def survivors(queries: np.ndarray, vectors: np.ndarray, limit: np.ndarray, blocks: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of turned queries and vectors that no test abandons; limit: squared distance up to which
    a pair counts. Pairs are scanned as a whole matrix while most of them are left, then one by one."""
    so_far = np.zeros(limit.shape)
    slack = 1e-9 * ((queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1))
    pairs = None
    for a, b, share in blocks[:-1]:
        q, x = queries[:, a:b], vectors[:, a:b]
        if pairs is None:
            so_far += (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * (q @ x.T)
            alive = so_far <= share * limit + slack
            if np.count_nonzero(alive) < alive.size / 8:
                pairs = np.nonzero(alive)
                far, most = so_far[pairs], limit[pairs] + slack[pairs]
            else:
                so_far[~alive] = np.inf
        else:
            i, j = pairs
            far = far + ((q[i] - x[j]) ** 2).sum(axis=1)
            good = far <= share * most
            pairs, far, most = (i[good], j[good]), far[good], most[good]
    return np.nonzero(np.isfinite(so_far)) if pairs is None else pairs


class Best:
    """The k best candidates of each of n queries so far: (query, score, id), and each one's threshold."""

    def __init__(self, n: int, k: int, threshold: np.ndarray):
        self.k, self.threshold = k, threshold
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        full = rank == self.k - 1
        self.threshold[q[full]] = np.maximum(self.threshold[q[full]], s[full])


def scan(best: Best, which: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, blocks: list[tuple[int, int, float]]) -> None:
    """Scans the vectors of a list for the queries of these numbers."""
    turned_q, turned_x = queries @ turn.T, vectors @ turn.T
    square_q, square_x = (queries**2).sum(axis=1), (vectors**2).sum(axis=1)
    for a in range(0, len(vectors), TILE_VECTORS):
        x = slice(a, a + TILE_VECTORS)
        for b in range(0, len(which), TILE_QUERIES):
            q = slice(b, b + TILE_QUERIES)
            own = which[q]
            limit = square_q[q, None] + square_x[x] - 2 * best.threshold[own][:, None]
            i, j = survivors(turned_q[q], turned_x[x], limit, blocks)
            score = inner(queries[q][i], vectors[x][j])
            good = score >= best.threshold[own[i]]
            best.add(own[i[good]], score[good], ids[x][j[good]])


def fitted(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of the sample by Lloyd's steps, begun at some of its vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))].copy()
    for _ in range(STEPS):
        own = nearest(sample, centres)
        order = np.argsort(own, kind="stable")
        begins = np.searchsorted(own[order], np.arange(len(centres) + 1))
        has = np.flatnonzero(np.diff(begins))
        centres[has] = np.add.reduceat(sample[order], begins[has], axis=0) / np.diff(begins)[has, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The list of each vector."""
    half = (centres**2).sum(axis=1) / 2
    parts = [np.argmin(half - vectors[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(vectors), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def probed(queries: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The lists that each query probes."""
    return np.argsort(-(queries @ centres.T), axis=1, kind="stable")[:, :probes]


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Lists to probe, so that some of the sample find recall of their k nearest others in it."""
    asked = np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    if not true.size:
        return len(centres)
    place = np.argsort(probed(sample[asked], centres, len(centres)), axis=1)  # of each list in a query's order
    rank = np.sort(np.take_along_axis(place, nearest(sample, centres)[true], axis=1).ravel())
    return int(rank[int(np.ceil(recall * len(rank))) - 1]) + 1


def _numbers(values: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(-1, d)


def _dealt(sizes: dict[int, int], lists: int, most: int) -> list[list[int]]:
    """The parts of each list, 0 to ...: small lists share a part, a list above most vectors has several."""
    out, part, filled = [], 0, 0
    for i in range(lists):
        n = sizes.get(i, 0)
        if filled and filled + n > most:
            part, filled = part + 1, 0
        count = max(1, -(-n // most))
        out.append(list(range(part, part + count)))
        part, filled = (part + count, 0) if count > 1 else (part, filled + n)
    return out


def _usable(x: Column) -> Column:
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


@F.pandas_udf(BinaryType())
def _packed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else (np.asarray(v, "<f8") + 0.0).tobytes())


def _flat(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of packed lists, and the list that each comes from."""
    parts = [np.frombuffer(v, "<i4") for v in values]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _group(d: int, k: int, seed: int, seeds: np.ndarray, seed_ids: np.ndarray):
    """The best candidates of a group's queries among its vectors, and the seeds that come with them."""
    turn, blocks = rotation(d, seed), shares(d)

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame({"query": [], "score": [], "vector": []})
        x, q = _numbers(vectors["bytes"].tolist(), d), _numbers(queries["bytes"].tolist(), d)
        ids, lists = vectors["id"].to_numpy(), vectors["list"].to_numpy()
        number, of = _flat(queries["probes"])
        best = Best(len(q), k, queries["threshold"].to_numpy().copy())
        with_seed, by = _flat(queries["seeds"])
        best.add(by, inner(q[by], seeds[with_seed]), seed_ids[with_seed])
        for i in np.unique(lists):
            own = np.flatnonzero(lists == i)
            which = of[number == i]
            scan(best, which, q[which], ids[own], x[own], turn, blocks)
        return pd.DataFrame({"query": queries["id"].to_numpy()[best.query], "score": best.score, "vector": best.id})

    return run


def search(df: DataFrame, key: str, vector: str, asked: Column, k: int = 20, seed: int = 12) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest others of each row for which asked holds.

    Vectors that are null or zero or hold null or non-finite components, and rows without a key, take no
    part; nor do vectors of another length than most have (of two such lengths, the smaller). Rows with
    the query's id are its own; of several vectors with a query's id one asks. An id that different
    vectors share is listed for each. Vectors of any length are worked on whole. An empty table, or one
    without queries, gives no rows. No other column is looked at."""
    spark, none = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    x = F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull() & _usable(x)).select(F.col(key).cast("long").alias("id"), asked.alias("asked"), _packed(x).alias("bytes"))
    rows = scratch.written(rows.withColumn("sum", F.md5("bytes")), "vectors")
    lengths = rows.groupBy((F.octet_length("bytes") / 8).cast("int").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not lengths:
        return spark.createDataFrame([], none)
    d = lengths.d
    rows = rows.where(F.octet_length("bytes") == 8 * d)
    one = scratch.written(rows.groupBy("sum").agg(F.min("id").alias("id"), F.max("asked").alias("asked"), F.first("bytes").alias("bytes")), "distinct")
    counts = one.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()
    if not counts.asked:
        return spark.createDataFrame([], none)

    lists = int(min(LISTS, max(1, counts.n**0.5 / 2)))
    wanted = max(1, min(A_LIST * lists, SAMPLE_VALUES // d))
    share = int(2**30 * min(1.0, wanted / counts.n))
    near = F.pmod(F.xxhash64("sum", F.lit(seed)), F.lit(2**30)) <= share
    chosen = one.where(near).orderBy("sum").select("id", "bytes").collect() or one.select("id", "bytes").limit(1).collect()
    sample = _numbers([r.bytes for r in chosen], d)
    centres = fitted(sample, lists, seed)
    first_few = min(SEED_BYTES // (8 * d), int(SEED_SHARE * counts.n))
    seeds, seed_ids = sample[:first_few], np.array([r.id for r in chosen[:first_few]], np.int64)
    # with too few seeds to fill a result every list is probed
    probes = probes_for(sample, centres, k) if len(seeds) > k else len(centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch["id"].to_numpy(), seed_ids)))
            own = nearest(_numbers(batch["bytes"].to_pylist(), d), centres).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["bytes"], pa.array(own)], names=["id", "bytes", "list"])

    vectors = scratch.written(one.select("id", "bytes").mapInArrow(placed, "id long, bytes binary, list int"), "placed")
    sizes = {r.list: r["count"] for r in vectors.groupBy("list").count().collect()}
    parts = scratch.partitions(spark)
    most = int(max(1, min(VECTOR_BYTES / (8 * d), max(512, counts.n / (2 * parts)))))
    dealt = _dealt(sizes, len(centres), most)
    blocks = max(1, -(-counts.asked // QUERIES))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each part that it probes, with the lists that it probes there."""
        for batch in batches:
            q = _numbers(batch["bytes"].to_pylist(), d)
            scores = q @ seeds.T
            first = np.full(len(q), -np.inf)
            if len(seeds) > k:
                first = np.partition(scores, len(seeds) - k - 1, axis=1)[:, len(seeds) - k - 1]
                first -= 1e-9 * (1 + np.abs(scores).max(axis=1))
            at, to, which, known = [], [], [], []
            for i, own in enumerate(probed(q, centres, probes)):
                there: dict[int, list[int]] = {}
                for n in own.tolist():
                    for part in dealt[n]:
                        there.setdefault(part, []).append(n)
                at += [i] * len(there)
                to += there
                which += [np.array(v, "<i4").tobytes() for v in there.values()]
                good = np.flatnonzero(scores[i] >= first[i])  # seeds go along once
                known += [good.astype("<i4").tobytes()] + [b""] * (len(there) - 1)
            again = pa.array(at, pa.int64())
            lists_of = [pa.array(v, pa.binary()) for v in (which, known)]
            made = [batch["id"].take(again), batch["bytes"].take(again), pa.array(first[at]), pa.array(to, pa.int32()), *lists_of]
            yield pa.RecordBatch.from_arrays(made, names=["id", "bytes", "threshold", "part", "probes", "seeds"])

    kind = "id long, bytes binary, threshold double, part int, probes binary, seeds binary"
    queries = one.where("asked").select("id", "bytes").mapInArrow(asking, kind)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int"))
    several = F.array(*[F.array(*map(F.lit, p)) for p in dealt])
    own_parts = F.element_at(several, F.col("list") + 1)
    turn = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.size(own_parts)).cast("int")
    vectors = vectors.withColumn("part", F.element_at(own_parts, turn + 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = vectors.groupBy("part", "block").cogroup(queries.groupBy("part", "block"))
    found = met.applyInPandas(_group(d, k + 1, seed, seeds, seed_ids), "query long, score double, vector long")
    return _listed(scratch.written(found, "found"), rows, one, k)


def _listed(found: DataFrame, rows: DataFrame, one: DataFrame, k: int) -> DataFrame:
    """Ids instead of distinct vectors. k + 1 vectors and k + 1 ids of each are enough, as one of them
    may be the query itself."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vector")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    alike = Window.partitionBy("sum").orderBy("id")
    least = rows.groupBy("sum", "id").agg(F.lit(1).alias("x")).withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1)
    members = one.select("sum", F.col("id").alias("vector")).join(least.select("sum", "id"), "sum").select("vector", "id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.join(members, "vector").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    asking = rows.where("asked").groupBy("id").agg(F.min("sum").alias("sum"))
    asking = asking.join(one.select("sum", F.col("id").alias("query")), "sum").select("query", F.col("id").alias("query_id"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    out = asking.join(best, "query").select("query_id", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def op12_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
