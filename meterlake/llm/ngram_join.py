"""N-gram Jaccard join by token-combination prefixes.

A document's set is that of its distinct word shingles, as 64-bit hashes. All sets follow one
global order: first the shingles with small hashes (the window), in it the rare before the
frequent, each by hash, then the others by hash. If two sets are similar enough, each has at
most e members that the other lacks, so prefixes that survive e losses share a signature:

- a rare shingle is a signature by itself and counts one;
- frequent shingles fall in groups by hash, and K of one group together are a signature; a group
  of m counts m - K + 1, so each loss takes away one at most. The prefix is extended until it
  counts e + 1.

Groups grow in number with the size of the sets, so signatures grow with the text, not with its
square; a set near the upper edge of its size class gives signatures for the next class too.

Which shingles are frequent: tasks count the window's shingles by their low bits, sorted and summed
in arrays; the arrays of one range of these bits meet in one task, which holds that range alone. Two
shingles with the same low bits count as one, for all documents alike, so no link hangs on it.

Signatures only nominate. Exact copies are one set from the start. Members of a bucket are first
compared with its least member (a star, as many pairs as members). Where a bucket then still holds
more pairs of different components than CLOUD for each member, as clouds of near copies do, a few of
its components by hash send a member that meets all others, and the crowd's sets are joined once more
by prefixes of single shingles, in the order of the crowd's own frequencies. In all other buckets the
pairs of different components that are left meet. Before whole sets meet, counts of both sets'
members by hash give an upper bound of what they share, which rules out pairs for sure."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm import graph, scratch
from meterlake.llm import text as T

#: Shingles together in a signature of a frequent class, and window occurrences that make one frequent.
K, OFTEN = 2, 24
#: Frequent shingles that tasks hold: the most frequent ones, at most this many; others pass as rare.
FREQUENT = 500_000
#: Bits of a shingle that it is counted by: those that number its range, and those within the range.
RANGE_BITS, COUNT_BITS = 10, 24
#: Window shingles that a task gathers before it hands on their counts.
GATHERED = 2_000_000
#: Sets of this size or less are indexed by single shingles alone.
SMALL = 40
#: Expected frequent shingles in a group of a set at the lower edge of its class.
CROWD = 8
#: Pairs of different components for each member above which a bucket is crowded, components of it that
#: send a member, and buckets that a document knows.
CLOUD, SENT, KNOWN = 32, 8, 8
#: Ids that go to every task at most; more meet the texts by a shuffle.
WANTED = 1_000_000

_COUNTED = np.uint64((1 << RANGE_BITS + COUNT_BITS) - 1)


def allowed(n: int, percent: int) -> int:
    """Members of a set of n that a similar set can lack."""
    return n - (percent * n + 99) // 100


def _classes(n: int, percent: int) -> list[int]:
    """Size classes that a set gives signatures for; 0 is that of small sets."""
    found = [0] if percent * n <= 100 * SMALL or n <= SMALL else []
    if n > SMALL:
        s = n.bit_length() - 1
        found += [s, s + 1] if 100 * n >= percent << (s + 1) else [s]
    return found


def _groups(tokens: np.ndarray, size_class: int) -> np.ndarray:
    return (T.mix(tokens) % np.uint64(max(1, (1 << size_class) // CROWD))).astype(np.int64)


def _edge(percent: int) -> np.uint64:
    """Hashes below it are in the window: twice the share that may be lost."""
    return np.uint64(min(2**64 - 1, int(2**64 * 2 * (100 - percent) / 100)))


def window(u: np.ndarray, percent: int) -> np.ndarray:
    """The first members by hash, as many as any prefix can need: if all were frequent."""
    n = len(u)
    if 0 in _classes(n, percent):
        return u
    need, m = allowed(n, percent) + 1, int(np.searchsorted(u, _edge(percent)))
    for s in _classes(n, percent):
        g = _groups(u, s)
        while m < n and np.maximum(np.bincount(g[:m]) - (K - 1), 0).sum() < need:
            m = min(n, m + max(4, m // 4))
    return u[:m]


def signatures(n: int, w: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set of n by its window, whose frequent members are marked."""
    need, out = allowed(n, percent) + 1, []
    for s in _classes(n, percent):
        salt = np.uint64((s * int(T._B) + int(T._C)) % 2**64)
        if s == 0:
            order = np.argsort(often, kind="stable")[:need]
            out.append(T.mix(w[order] + salt))
            continue
        inside = int(np.searchsorted(w, _edge(percent)))
        rare = np.flatnonzero(~often[:inside])[:need]
        out.append(T.mix(w[rare] + salt))
        if len(rare) == need:
            continue
        count, group, held, pairs, ones = len(rare), _groups(w, s), {}, [], []
        for i in [*np.flatnonzero(often[:inside]).tolist(), *range(inside, len(w))]:
            if count == need:
                break
            if not often[i]:
                ones.append(i)
                count += 1
                continue
            mates = held.setdefault(int(group[i]), [])
            pairs += [(*c, i) for c in combinations(mates, K - 1)]
            mates.append(i)
            count += len(mates) >= K
        out.append(T.mix(w[ones] + salt))
        if pairs:
            # members of a combination come in the global order, the same in every set
            h = np.full(len(pairs), salt)
            for column in np.array(pairs).T:
                h = T.mix(h * T._A + w[column])
            out.append(h)
    return np.unique(np.concatenate(out))


def _sets(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    data, offsets = T.utf8(part["text"])
    starts, ends, bounds = T.words(data, offsets)
    s, to = T.shingles(T.word_hashes(data, starts, ends), bounds, width)
    return [np.unique(s[a:b]) for a, b in zip(to[:-1], to[1:])]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    to = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(flat.view(np.int64)))


def _binaries(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _mapped(docs: DataFrame, to: str, make) -> DataFrame:
    """Rows that make() returns, as arrays, for each slice of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(make(part), names=_names(to))

    return docs.mapInArrow(run, to)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else by
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counts_by_range(keys: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """number, keys and counts of each range that distinct, sorted keys fall in."""
    number = (keys >> np.uint64(COUNT_BITS)).astype(np.int32)
    at = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(keys) else np.zeros(0, int)
    low = (keys & np.uint64((1 << COUNT_BITS) - 1)).astype("<u4")
    cut = [slice(a, b) for a, b in zip(at, [*at[1:], len(keys)])]
    return [pa.array(number[at]), _binaries([low[c] for c in cut]), _binaries([counts[c].astype("<u4") for c in cut])]


def _surveyed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of each document size and digest of its set; and, in rows without those, how often which
    window shingles occur: keys and counts of a range."""
    to = "doc_id long, n long, d1 long, d2 long, range int, keys binary, counts binary"

    def documents(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        sums = [(T.mix(u).sum(dtype=np.uint64), T.mix(u + T._A).sum(dtype=np.uint64)) for u in sets]
        sums = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
        none = [pa.nulls(len(sets), t) for t in (pa.int32(), pa.binary(), pa.binary())]
        sizes = pa.array([len(u) for u in sets], pa.int64())
        return pa.RecordBatch.from_arrays([part["doc_id"], sizes, pa.array(sums[:, 0]), pa.array(sums[:, 1]), *none], names=_names(to))

    def handed_on(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        arrays = _counts_by_range(keys, counts)
        none = [pa.nulls(len(arrays[0]), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*none, *arrays], names=_names(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets = _sets(part, width)
                yield documents(part, sets)
                more = [window(u, percent) & _COUNTED for u in sets if len(u)]
                held += more
                size += sum(map(len, more))
                if size >= GATHERED:
                    yield handed_on(held)
                    held, size = [], 0
        if held:
            yield handed_on(held)

    return docs.mapInArrow(run, to)


class Frequent:
    """The most frequent shingles: keys in order, how often each occurs, and whether these are all that
    occur often enough."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, whole: bool):
        self.keys, self.counts, self.whole = keys, counts, whole

    def of(self, u: np.ndarray) -> np.ndarray:
        """Occurrences of each shingle, 0 for those that are not frequent."""
        if not len(self.keys):
            return np.zeros(len(u), np.int64)
        key = u & _COUNTED
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.counts[at], 0)


def _frequent(counts: DataFrame, least_count: int = OFTEN) -> Frequent:
    """The most frequent shingles that occur least_count times, FREQUENT at most."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range after the other: no more than its keys is held at once."""
        now, keys, values, pending = None, [], [], 0

        def often() -> pa.RecordBatch:
            key, n = _summed(keys, values)
            key = key[n >= least_count].astype(np.int64) + (now << COUNT_BITS)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[n >= least_count])], names=["key", "n"])

        for batch in batches:
            for number, k, n in zip(*[batch[c].to_pylist() for c in ("range", "keys", "counts")], strict=True):
                if number != now and keys:
                    yield often()
                    keys, values, pending = [], [], 0
                now = number
                keys.append(np.frombuffer(k, "<u4"))
                values.append(np.frombuffer(n, "<u4").astype(np.int64))
                pending += len(keys[-1])
                if pending >= GATHERED:
                    key, n = _summed(keys, values)
                    keys, values, pending = [key], [n], 0
        if keys:
            yield often()

    ranges = counts.repartition(scratch.partitions(counts.sparkSession), "range").sortWithinPartitions("range")
    counts = scratch.written(ranges.mapInArrow(totals, "key long, n long"), "frequent")
    step = F.floor(F.log2("n") * 8).cast("int")
    room, least = FREQUENT, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        room -= r.k
        if room < 0:
            break
        least = r.step
    top = counts.where(step >= least) if least is not None else counts.limit(0)
    top = top.select("key", "n").toArrow().sort_by("key")
    return Frequent(top["key"].to_numpy().astype(np.uint64), top["n"].to_numpy(), room >= 0)


def sketch(u: np.ndarray) -> np.ndarray:
    """How many members of a set fall in each of n / 4 to n / 2 places by hash; 255 may be more."""
    bits = max(0, len(u).bit_length() - 2)
    return np.minimum(np.bincount((u >> np.uint64(20)) & np.uint64((1 << bits) - 1), minlength=1 << bits), 255).astype(np.uint8)


def most_shared(a: np.ndarray, b: np.ndarray) -> int | None:
    """No fewer members than two sets share, by their sketches; None if these can't tell."""
    if max(a.max(initial=0), b.max(initial=0)) == 255:
        return None
    a, b = a.astype(np.int32), b.astype(np.int32)
    while len(a) > len(b):
        a = a.reshape(2, -1).sum(axis=0)
    while len(b) > len(a):
        b = b.reshape(2, -1).sum(axis=0)
    return int(np.minimum(a, b).sum())


def _likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that their sketches do not rule out."""

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
        out = []
        for a, n, b, m in zip(x, nx, y, ny, strict=True):
            most = most_shared(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))
            out.append(most is None or 100 * most >= percent * (n + m - most))
        return pd.Series(out, dtype="bool")

    one = signed.select(F.col("doc_id").alias("a"), F.col("sketch").alias("xa"), F.col("n").alias("na"))
    two = signed.select(F.col("doc_id").alias("b"), F.col("sketch").alias("xb"), F.col("n").alias("nb"))
    return pairs.join(one, "a").join(two, "b").where(likely("xa", "na", "xb", "nb")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets are similar enough."""

    @F.pandas_udf("long")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        both = zip(x, y, strict=True)
        count = [len(np.intersect1d(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), assume_unique=True)) for a, b in both]
        return pd.Series(count, dtype="int64")

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    got = pairs.join(left, "a").join(right, "b").withColumn("o", shared("ma", "mb"))
    got = got.withColumn("whole", F.col("na") + F.col("nb") - F.col("o"))
    return got.where(100 * F.col("o") >= percent * F.col("whole")).select("a", "b")


def _crowd_counts(sets: DataFrame) -> DataFrame:
    """How often which members occur in packed sets: keys and counts of a range."""

    def handed_on(held: list[np.ndarray]) -> pa.RecordBatch:
        arrays = _counts_by_range(*np.unique(np.concatenate(held) & _COUNTED, return_counts=True))
        return pa.RecordBatch.from_arrays(arrays, names=["range", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for members in batch["members"]:
                held.append(np.frombuffer(members.as_buffer(), "<u8"))
                size += len(held[-1])
                if size >= GATHERED:
                    yield handed_on(held)
                    held, size = [], 0
        if held:
            yield handed_on(held)

    return sets.select("members").mapInArrow(run, "range int, keys binary, counts binary")


def _crowd_heads(sets: DataFrame, often: "Frequent", percent: int) -> DataFrame:
    """id, size and, of the members that a similar set can lack and one more, the first in the crowd's
    order: token and place. What occurs once in the crowd comes first and meets nothing: it takes up
    its place, but needs no row where all counts are known."""
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places = [], []
            for members in batch["members"]:
                u = np.frombuffer(members.as_buffer(), "<u8")
                count = shared.value.of(u)
                first = np.argsort(count, kind="stable")[: allowed(len(u), percent) + 1]
                at = np.arange(len(first))
                if shared.value.whole:
                    at = at[count[first] > 0]
                tokens.append(u[first[at]])
                places.append(at.astype(np.uint64))
            arrays = [batch["id"], batch["n"], _lists(tokens), _lists(places)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "token", "at"])

    return sets.mapInArrow(run, "id long, n long, token array<long>, at array<long>")


def _crowd_pairs(docs: DataFrame, crowd: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs a, b of different parts of a crowd (id, part) that may be similar.

    Members follow one order, the rarest in the crowd first and equals by hash, so that what sets a
    near copy apart stands in front. A similar pair's first common member stands so early that enough
    can follow it in both sets; in the smaller set that is among the first few, its head. Only heads
    are looked up: what the whole crowd has in common stands behind them and brings no pair. Any order
    that all sets share finds every pair, so counts that tasks can't hold cost time alone."""
    texts = docs.join(crowd.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = scratch.written(_packed_sets(texts, width), "crowd-sets")
    often = _frequent(_crowd_counts(sets), 2)
    heads = scratch.written(_crowd_heads(sets, often, percent).join(crowd, "id"), "crowd-heads")
    ranked = heads.select("id", "n", "part", F.explode(F.arrays_zip("token", "at")).alias("x"))
    ranked = ranked.select("x.token", "id", "n", "x.at", "part")

    def enough(n: Column, at: Column, whole: Column) -> Column:
        return (100 + percent) * (n - at) >= percent * whole

    head = ranked.where(enough(F.col("n"), F.col("at"), 2 * F.col("n")))
    head = head.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ab"), F.col("part").alias("pb"))
    whole = F.col("n") + F.col("nb")
    fits = (F.col("part") != F.col("pb")) & (F.col("nb") <= F.col("n")) & _sizes_fit("n", "nb", percent)
    fits = fits & enough(F.col("n"), F.col("at"), whole) & enough(F.col("nb"), F.col("ab"), whole)
    met = ranked.join(head, "token").where(fits)
    return met.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _signed(docs: DataFrame, frequent: Frequent, width: int, percent: int) -> DataFrame:
    """doc_id, size of the set, its signatures and its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def made(part: pa.RecordBatch) -> list[pa.Array]:
        sets, found = _sets(part, width), []
        for u in sets:
            w = window(u, percent) if len(u) else u
            found.append(signatures(len(u), w, shared.value.of(w) > 0, percent) if len(u) else u)
        sizes = pa.array([len(u) for u in sets], pa.int64())
        return [part["doc_id"], sizes, _lists(found), _binaries([sketch(u) for u in sets])]

    return _mapped(docs, "doc_id long, n long, s array<long>, sketch binary", made)


def _packed_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, n and members of each document's whole set."""

    def made(part: pa.RecordBatch) -> list[pa.Array]:
        sets = _sets(part, width)
        return [part["doc_id"], pa.array([len(u) for u in sets], pa.int64()), _binaries(sets)]

    return _mapped(docs, "id long, n long, members binary", made).dropDuplicates(["id"])


class _Join:
    """The components that the links found so far make."""

    def __init__(self, docs: DataFrame, signed: DataFrame, width: int, percent: int):
        self.docs, self.signed, self.width, self.percent = docs, signed, width, percent
        self.parts = None

    def grow(self, pairs: DataFrame, name: str) -> None:
        """Verifies the pairs a, b and adds those that link. Only the sets of documents in likely pairs
        are made: where these are few, counted, their ids go to all tasks and no text moves."""
        pairs = scratch.written(_likely(pairs, self.signed, self.percent), name)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
        sets = _packed_sets(self.docs.join(wanted, "doc_id", "left_semi"), self.width)
        more = scratch.written(_verified(pairs, sets, self.percent), f"{name}-links")
        if self.parts is None:
            self.parts = scratch.written(graph.components(more, "a", "b"), "components")
        elif not more.isEmpty():
            self.parts = scratch.written(graph.merged(self.parts, more, "a", "b"), "components")

    def with_part(self, rows: DataFrame) -> DataFrame:
        """rows (id, ...) with part, the component of each."""
        own = self.parts.withColumnRenamed("component", "_part")
        return rows.join(own, "id", "left").withColumn("part", F.coalesce("_part", "id")).drop("_part")

    def still_open(self, rows: DataFrame) -> DataFrame:
        """Rows (s, id, ...) of buckets that still hold several components, with the component of each."""
        rows = self.with_part(rows)
        mixed = rows.groupBy("s").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("s")
        return rows.join(mixed, "s")


def _meets(percent: int) -> Column:
    """Whether id meets b in bucket s: of fitting sizes, in different parts, and in no lesser bucket
    that both know."""
    earlier = F.exists(F.array_intersect("t", "tb"), lambda x: x < F.col("s"))
    return (F.col("part") != F.col("pb")) & _sizes_fit("n", "nb", percent) & ~earlier


def _crowds(rows: DataFrame) -> DataFrame:
    """Buckets s with more pairs of different parts than CLOUD for each member, and their parts."""
    each = rows.groupBy("s", "part").agg(F.count("*").alias("k"))
    each = each.groupBy("s").agg(F.sum("k").alias("k"), F.sum(F.col("k").cast("double") ** 2).alias("q"), F.count("*").alias("crowd"))
    return each.where(F.col("k").cast("double") ** 2 - F.col("q") > 2.0 * CLOUD * F.col("k")).select("s", "crowd")


def _sent(crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs of one member of some parts of each crowded bucket, by hash, with all other members."""
    chosen = crowded.where(F.pmod(F.xxhash64("part"), F.col("crowd")) < SENT)
    least = F.min(F.struct(F.xxhash64("id"), "id", "n", "t")).alias("c")
    sent = chosen.groupBy("s", "part").agg(least)
    sent = sent.select("s", F.col("part").alias("pb"), F.col("c.id").alias("b"), F.col("c.n").alias("nb"), F.col("c.t").alias("tb"))
    met = crowded.join(sent, "s").where(_meets(percent))
    return met.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()


def _components(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """id and component of the documents in signed that link with others."""
    join = _Join(docs, signed, width, percent)
    rows = signed.select(F.col("doc_id").alias("id"), "n", F.explode("s").alias("s"))

    # round 0: each bucket's members against its least
    stars = rows.groupBy("s").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("k")).where("k > 1")
    stars = stars.select("s", F.col("c.id").alias("centre"), F.col("c.n").alias("cn"), "k")
    inside = scratch.written(rows.join(stars, "s"), "buckets")
    pairs = inside.where("id <> centre").where(_sizes_fit("n", "cn", percent))
    join.grow(pairs.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "stars")

    # what is left open; each document knows its least such buckets, so that a pair that shares
    # several is met in one of few
    left = scratch.written(join.still_open(inside.where("k > 2").select("s", "id", "n")), "open")
    least = left.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("s")), 1, KNOWN).alias("t"))
    left = scratch.written(left.join(least, "id"), "open-known")
    crowds = scratch.written(_crowds(left), "crowds")
    if not crowds.isEmpty():
        crowded = scratch.written(left.join(crowds, "s"), "crowded")
        join.grow(_sent(crowded, percent), "sent")
        crowd = scratch.written(join.with_part(crowded.select("id").distinct()), "crowd")
        join.grow(_crowd_pairs(docs, crowd, width, percent), "crowd-pairs")
        left = left.join(crowds.select("s"), "s", "left_anti")
    left = scratch.written(join.still_open(left.drop("part")), "left")
    other = left.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"), F.col("t").alias("tb"))
    rest = left.join(other, "s").where(F.col("id") > F.col("b")).where(_meets(percent))
    join.grow(rest.select(F.col("id").alias("a"), "b").distinct(), "rest")
    return join.parts


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the least doc_id that links reach.

    Two documents link when 100 * shared shingles >= percent * all shingles of both. A text of
    fewer words than width has its whole sequence as one shingle; without words, or without an
    id, a document links with nothing. Rows of one id are one document. An empty table gives no rows."""
    docs = scratch.in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    survey = scratch.written(_surveyed(docs, width, percent), "survey")
    every = survey.where("range is null").select("doc_id", "n", "d1", "d2")
    frequent = _frequent(survey.where("range is not null").select("range", "keys", "counts"))
    firsts = every.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"))
    firsts = scratch.written(firsts, "firsts")
    signed = _signed(docs, frequent, width, percent).join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    signed = scratch.written(signed.dropDuplicates(["doc_id"]), "signatures")
    whole = _components(docs, signed, width, percent)

    label = firsts.join(whole.withColumnRenamed("id", "first"), "first", "left")
    label = label.select("d1", "d2", F.coalesce("component", "first").alias("component"))
    out = every.join(label, ["d1", "d2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op5_combination_prefixes(spark, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, 90 percent."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


ORACLE_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.root)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""
