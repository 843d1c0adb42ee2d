"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes. Where its top bits are zero a chunk may end: before the
normal size more bits must be zero, after it fewer, so sizes gather around it. An insertion moves
only the boundaries near it. A fingerprint is the set of the chunks' digests with their lengths;
likeness is containment: the share of one text's distinct chunk bytes that the other has too."""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import order, scratch
from meterlake.llm import text as T

#: Bytes of a chunk: least, normal, most. The gear window is the least size.
LEAST, NORMAL, MOST = 32, 64, 256
#: Zero bits asked for before and after the normal size.
STRICT, LOOSE = 8, 4
_GEAR = (T.mix(np.arange(1, 257, dtype=np.uint64) * T._A) >> T.U(32)).astype(np.uint32)
_RECORD = np.dtype([("digest", ">u8"), ("length", ">u2")])


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each chunk, by row and start."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    far = np.iinfo(np.int64).max
    strict = np.append(loose[h[loose] >> np.uint32(32 - STRICT) == 0] + 1, far)
    loose = np.append(loose + 1, far)
    rows, at = np.flatnonzero(np.diff(offsets)), offsets[:-1]
    at, ends = at[rows], offsets[1:][rows]
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        cut = strict[np.searchsorted(strict, at + LEAST)]
        late = cut >= at + NORMAL
        cut[late] = np.minimum(loose[np.searchsorted(loose, at[late] + NORMAL)], at[late] + MOST)
        cut = np.minimum(cut, ends)
        made.append((rows, at, cut))
        on = cut < ends
        rows, at, ends = rows[on], cut[on], ends[on]
    if not made:
        return (np.zeros(0, np.int64),) * 3
    row, start, end = (np.concatenate(x) for x in zip(*made, strict=True))
    by = np.argsort(start, kind="stable")
    return row[by], start[by], end[by]


def digest_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text its distinct (digest, length) records, by digest."""
    data, offsets = T.utf8(column)
    row, start, end = chunks(data, offsets)
    digest = T.word_hashes(data, start, end, lower=False)
    by = np.lexsort((digest, row))
    row, digest, size = row[by], digest[by], (end - start)[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
    records = np.zeros(int(new.sum()), _RECORD)
    records["digest"], records["length"] = digest[new], size[new]
    return np.split(records, np.searchsorted(row[new], np.arange(1, len(column))))


def to_string(records: np.ndarray) -> str:
    """The fingerprint as text: ten bytes a record, base64."""
    return base64.b64encode(records.tobytes()).decode()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's chunk bytes that b holds; 1 for two empty sets, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, at, _ = np.intersect1d(a["digest"], b["digest"], assume_unique=True, return_indices=True)
    return float(a["length"][at].sum(dtype=np.int64) / a["length"].sum(dtype=np.int64))


def fingerprints(df: DataFrame, text: str, name: str = "fingerprint") -> DataFrame:
    """Adds each text's fingerprint as a string; null and empty give the empty string. A column of
    that name is replaced, the others stay."""
    df = scratch.in_small_batches(df.drop(name))
    to = df.select("*", F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text):
                made = pa.array(map(to_string, digest_sets(part[text])), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    return df.mapInArrow(run, to)


def with_next(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out by ranges of key, sorted by key (null first) and then text; each range ends
    with a copy of the row that follows it (_ghost = 1), and the last one with the first row.

    Bounds come from a sketch of the keys. The driver sees the least key of each range."""
    low = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    cuts = order.cut_points(df, key, scratch.partitions(df.sparkSession))
    df = df.withColumns({"_k": low, "_part": order.part_of(F.col(key), cuts)})
    firsts = sorted((r._part, r.k) for r in df.groupBy("_part").agg(F.min("_k").alias("k")).collect())
    if not firsts:
        return df.withColumn("_ghost", F.lit(0))
    # (part, key of the row that follows it): the key's rows go there once more
    after = [(p, firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    heads = F.create_map(*[x for p, k in after for x in (F.lit(k), F.lit(p))])
    again = heads[F.col("_k")]
    places = F.when(again.isNull(), F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")), F.struct(again.alias("p"), F.lit(1).alias("g"))))
    df = df.withColumn("_place", F.explode(places)).withColumn("_ghost", F.col("_place.g")).withColumn("_part", F.col("_place.p")).drop("_place")
    return df.repartitionById(len(cuts) + 1, "_part").sortWithinPartitions("_ghost", "_k", F.xxhash64("text"), "text")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last quarter replaced by the beginning of the next document's. Null
    texts are empty; of rows with one doc_id the text decides the order; a lone row is its own next."""
    to = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(ids: list, texts: list[str]) -> pa.RecordBatch:
        edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(texts, texts[1:])]
        own, other = digest_sets(pa.array(texts, pa.large_string())), digest_sets(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([to_string(x) for x in own[:-1]], pa.string()), pa.array([to_string(x) for x in other], pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, other)], pa.float64()), pa.array([containment(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []  # the last row seen: it waits for the next
        for batch in batches:
            for part in T.slices(batch, "text"):
                ghost = part["_ghost"].to_pylist()
                n = ghost.index(1) + 1 if 1 in ghost else len(ghost)
                ids += part["doc_id"].to_pylist()[:n]
                texts += [t or "" for t in part["text"].to_pylist()[:n]]
                if len(ids) > 1:
                    yield pairs(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
                if 1 in ghost:
                    for _ in batches:
                        pass
                    return

    rows = with_next(scratch.in_small_batches(docs).select(F.col("doc_id").cast("long"), "text"), "doc_id")
    return rows.select("doc_id", "text", "_ghost").mapInArrow(run, to)


def op1_chunk_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their next documents."""
    return compared_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
