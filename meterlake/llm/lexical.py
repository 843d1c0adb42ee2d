"""Ranked lexical search by MaxScore per shard.

One pass over the texts makes, for each document, the counts of those terms that the queries have; a
second one counts documents per term; the third ranks. There a task takes SHARD documents at a time as
a shard: it turns their counts into posting lists, and gives each query's lists upper bounds, the weight
times the highest impact in the shard. The lists of least bounds whose sum stays below the query's
least score so far, the threshold, are not essential: a document that has only those cannot qualify.
Documents of essential lists are scored; the other lists are probed by binary search, those of high
bounds first, only for documents that can still reach the threshold. A task carries its best documents
from shard to shard, so that thresholds rise, and gives them out once.

Queries go to tasks in blocks of bounded size, each a job of its own; documents stay where they are."""

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import scratch
from meterlake.llm import text as T

#: Documents of a shard, and bytes of their packed counts; whichever is reached first ends it.
SHARD, SHARD_BYTES = 4096, 16 << 20
#: Queries and bytes of their texts that a block is expected to hold.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
#: Fixed values of the score: 100 - 25 + 25 * n / (L / N) and 1000 tf / (1000 tf + 12 m), times 10^6.
FLOOR, SLOPE, TOP, TF, LENGTH = 75, 25, 1_000_000_000, 1000, 12
#: Stands for a null document id within tasks.
NONE = np.iinfo(np.int64).max

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the terms, and for each row the index of its first: runs of ASCII letters and
    digits and of all code points from U+0080."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each term, A-Z lower-cased: of its bytes, and of their complements."""
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return np.stack([T.word_hashes(lower, starts, ends, False), T.word_hashes(~lower, starts, ends, False)])


class Queries(NamedTuple):
    """Items, the terms of each with their counts, and the hashes of all terms in order of the first."""

    items: list[int]
    counts: list[dict[int, int]]
    known: np.ndarray


def queries_of(items: list[int], texts: list[str | None]) -> Queries:
    data, offsets = T.utf8(pa.array(texts, pa.large_string()))
    starts, ends, first = terms(data, offsets)
    both = hashes(data, starts, ends)
    known, which = np.unique(both, axis=1, return_inverse=True)
    which = which.reshape(-1)
    return Queries(items, [dict(Counter(which[a:b].tolist())) for a, b in zip(first, first[1:])], known)


def _found(both: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Number of each term in known, or -1."""
    if not known.shape[1]:
        return np.full(both.shape[1], -1)
    at = np.minimum(np.searchsorted(known[0], both[0]), known.shape[1] - 1)
    hit = (known[0][at] == both[0]) & (known[1][at] == both[1])
    return np.where(hit, at, -1)


def counted(docs: DataFrame, key: str, text: str, known: np.ndarray) -> DataFrame:
    """id, n (terms with repeats) and, as packed 32-bit and 64-bit integers, the numbers in known of the
    terms that are there, with their counts; documents without a term go."""
    if len(np.unique(known[0])) < known.shape[1]:
        raise ValueError("two terms of the queries have one hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offsets = T.utf8(part["text"])
                starts, ends, first = terms(data, offsets)
                n = np.diff(first)
                found = _found(hashes(data, starts, ends), known)
                row = np.repeat(np.arange(len(n)), n)
                pair, tf = np.unique(row[found >= 0] * known.shape[1] + found[found >= 0], return_counts=True)
                row, term = (pair // known.shape[1], pair % known.shape[1]) if known.shape[1] else (pair, pair)
                cut = np.searchsorted(row, np.arange(len(n) + 1))
                term, tf = term.astype("<i4"), tf.astype("<i8")
                has = np.flatnonzero(n)
                packed = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in has], pa.binary()) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(has)), pa.array(n[has]), *packed], names=["id", "n", "terms", "tfs"])

    rows = scratch.in_small_batches(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms binary, tfs binary")


def _document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; the driver sees one number a term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            own += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), "<i4"), minlength=size)
        has = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(own[has])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    if size:
        for r in postings.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            out[r.term] = r.df
    return out


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = FLOOR + (SLOPE * n * documents) // length
    return (TOP * tf) // (TF * tf + LENGTH * m)


class _Shard:
    """Posting lists of some documents: of each term the documents' places, in order, and impacts."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: list[bytes], tfs: list[bytes], documents: int, length: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        term = np.frombuffer(b"".join(terms[i] for i in order), "<i4")
        tf = np.frombuffer(b"".join(tfs[i] for i in order), "<i8")
        place = np.repeat(np.arange(len(ids)), [len(terms[i]) // 4 for i in order])
        impact = impacts(tf, n[order][place], documents, length)
        by_term = np.argsort(term, kind="stable")
        self.places, self.impacts = place[by_term], impact[by_term]
        self.terms, self.starts = np.unique(term[by_term], return_index=True)
        self.ends = np.append(self.starts[1:], len(term))
        self.highest = np.maximum.reduceat(self.impacts, self.starts) if len(term) else self.starts
        self.scores = np.zeros(len(ids), np.int64)

    def lists(self, weights: dict[int, int]) -> list[tuple[int, int, int, int]]:
        """Upper bound, weight, begin and end of the lists of a query, high bounds first."""
        wanted = np.array(list(weights), np.int64)
        at = np.minimum(np.searchsorted(self.terms, wanted), max(0, len(self.terms) - 1))
        hit = self.terms[at] == wanted if len(self.terms) else np.zeros(len(wanted), bool)
        rows = [(weights[t] * int(self.highest[k]), weights[t], int(self.starts[k]), int(self.ends[k])) for t, k in zip(wanted[hit].tolist(), at[hit].tolist())]
        return sorted(rows, reverse=True)

    def best(self, weights: dict[int, int], threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that score threshold or more, 1 at least."""
        found = self.lists(weights)
        bounds = [x[0] for x in found]
        rest = np.cumsum([0, *bounds[::-1]])[::-1]  # rest[i]: the bounds of the lists from i on
        essential = int(np.count_nonzero(rest[:-1] >= threshold))
        touched = []
        for _, weight, a, b in found[:essential]:
            self.scores[self.places[a:b]] += weight * self.impacts[a:b]  # a list has a document once
            touched.append(self.places[a:b])
        if not touched:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.unique(np.concatenate(touched))
        scores = self.scores[places]
        self.scores[places] = 0
        for i in range(essential, len(found)):
            can = scores + rest[i] >= threshold
            places, scores = places[can], scores[can]
            if not len(places):
                break
            _, weight, a, b = found[i]
            at = np.minimum(np.searchsorted(self.places[a:b], places), b - a - 1) + a
            scores = scores + np.where(self.places[at] == places, weight * self.impacts[at], 0)
        good = scores >= max(1, threshold)
        return places[good], scores[good]


def _kept(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _ranked(postings: DataFrame, queries: Queries, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id and score of the k best documents of each task for each query."""
    wanted = [{t: c * int(weights[t]) for t, c in counts.items() if weights[t] > 0} for counts in queries.counts]
    items = queries.items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)

        def search(part: pa.Table) -> None:
            ids = part["id"].fill_null(NONE).to_numpy().astype(np.int64)
            shard = _Shard(ids, part["n"].to_numpy(), part["terms"].to_pylist(), part["tfs"].to_pylist(), documents, length)
            for i, own in enumerate(wanted):
                ids, scores = best[i]
                places, new = shard.best(own, int(scores[-1]) if len(scores) == k else 1)
                if len(places):
                    best[i] = _kept(np.concatenate([ids, shard.ids[places]]), np.concatenate([scores, new]), k)

        waiting, rows, size = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= SHARD or size >= SHARD_BYTES:
                search(pa.Table.from_batches(waiting))
                waiting, rows, size = [], 0, 0
        if rows:
            search(pa.Table.from_batches(waiting))
        for item, (ids, scores) in zip(items, best):
            if len(ids):
                whole = pa.array(ids, pa.int64(), mask=ids == NONE)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), whole, pa.array(scores)], names=["item_id", "doc_id", "score"])

    return postings.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k highest-scoring documents of score
    above 0; equal scores by ascending document id, null last.

    Null texts have no terms; texts of any length are worked on whole. Rows that repeat a document's id
    are documents of their own. Of items with one id the least text counts; items without an id, or
    without a term that a document holds, have no rows. Empty tables give no rows. No other column of
    either table is looked at."""
    spark = docs.sparkSession
    asked = items.where(F.col(item).isNotNull()).groupBy(F.col(item).cast("long").alias("item_id")).agg(F.min(item_text).alias("text"))
    asked = scratch.written(asked, "items")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.b // BLOCK_BYTES))
    made = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        queries = queries_of([r.item_id for r in rows], [r.text for r in rows])
        postings = scratch.written(counted(docs, key, text, queries.known), "postings")
        total = postings.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total.n:
            break
        df = _document_counts(postings, queries.known.shape[1])
        weights = np.floor(1000 * np.log((2 * total.n + 2) / (2 * df + 1))).astype(np.int64)
        made.append(scratch.written(_ranked(postings, queries, weights, total.n, total.l, k), "ranked"))
    if not made:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = made[0]
    for other in made[1:]:
        found = found.union(other)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_maxscore(spark, sf_dir: str) -> DataFrame:
    """All documents for each item of the benchmark."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_OP11 = r"""
WITH found AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT d, doc_id, t, len(t)::BIGINT AS n FROM found WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
wanted AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM asked GROUP BY ALL),
words AS (SELECT d, doc_id, n, unnest(t) AS term FROM docs),
tf AS (SELECT d, doc_id, n, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
impact AS (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))) AS part
  FROM tf JOIN df USING (term), total),
scored AS (
  SELECT item_id, d, doc_id, sum(repeats * part)::BIGINT AS score
  FROM wanted JOIN impact USING (term) GROUP BY item_id, d, doc_id HAVING sum(repeats * part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
