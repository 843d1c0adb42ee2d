"""Substring dedup by hashing lines.

A unit is a line, compared by a 128-bit digest of its words, lower-cased (A-Z) and without
punctuation at their ends. Of units with one digest the earliest ranked (by document, then place)
stays, the others go.

Passages are also pasted into lines, where no line's digest finds them. For those, anchors are
hashed: runs of ANCHOR_WORDS words, of WINDOW such runs that follow each other the one with the
least hash. A text of ANCHOR_WORDS + WINDOW - 1 words has the same anchor wherever it stands. An
anchor that occurs earlier is compared word by word, to both sides, with the words around its
earliest place, and matches of a given number of words go. From one anchor to the next a digest of
all words between them tells whether both places go on alike, so that only the ends of a match are
compared word by word."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import scratch
from meterlake.llm import text as T

#: Words that a repeated line must have to be removed from a corpus of prose: shorter ones, as headings
#: and greetings, are no sign of a copy. Words that a match inside lines must have.
LINE_WORDS, RUN_WORDS = 8, 20
#: Words of an anchor, and runs of so many words of which the one with the least hash is one.
ANCHOR_WORDS, WINDOW = 10, 40
#: Words on each side of an earliest place that copies are compared with: so many that match hold
#: another anchor, from which a longer match goes on.
CONTEXT = ANCHOR_WORDS + WINDOW + 1
#: Documents whose ids go to every task at most; more meet the texts by a shuffle.
WANTED = 1_000_000

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Words:
    """The words of a column of texts that have more than punctuation: row bounds, hash, byte range
    and line of each."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = T.utf8(column)
        data, (starts, ends, bounds) = self.data, T.words(self.data, self.offsets)
        lo, hi = starts.copy(), ends.copy()
        while len(i := np.flatnonzero((hi > lo) & _PUNCT[data[np.maximum(hi - 1, 0)]])) if len(lo) else False:
            hi[i] -= 1
        while len(i := np.flatnonzero((hi > lo) & _PUNCT[data[np.minimum(lo, len(data) - 1)]])) if len(lo) else False:
            lo[i] += 1
        real = hi > lo
        self.start, self.end = starts[real], ends[real]
        self.hash = T.word_hashes(data, lo[real], hi[real])
        rows = np.repeat(np.arange(len(self.offsets) - 1), np.diff(bounds))[real]
        self.bounds = np.searchsorted(rows, np.arange(len(self.offsets)))
        # lines are numbered over all rows; a row begins a new one
        self.line = np.cumsum(data == 10)[self.start] + rows if len(data) else rows

    def digests(self, first: np.ndarray, last: np.ndarray, base: np.uint64) -> np.ndarray:
        """A 64-bit digest of each range of words: a polynomial in base, wherever the range stands."""
        n = len(self.hash)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(base), -1, 2**64)))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(self.hash + base) * power[:n])])
        size = (last - first).astype(np.uint64)
        return T.mix((sums[last] - sums[first]) * back[first] + size * T._A)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word, and the word behind the last, of each line that has words."""
        first = np.flatnonzero(np.concatenate([[True], self.line[1:] != self.line[:-1]])) if len(self.line) else np.zeros(0, int)
        return first, np.append(first[1:], len(self.line)).astype(np.int64) if len(first) else first

    def anchors(self) -> np.ndarray:
        """First words of the anchors, in order."""
        grams, to = T.shingles(self.hash, self.bounds, ANCHOR_WORDS)
        of = np.repeat(np.arange(len(to) - 1), np.diff(to))
        inside = np.flatnonzero(of[: max(0, len(of) - WINDOW + 1)] == of[WINDOW - 1 :])
        if not len(inside):
            return inside
        least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[inside].argmin(axis=1)
        at = np.unique(inside + least)
        return at + (self.bounds[:-1] - to[:-1])[of[at]]

    def hashed(self, line_words: int) -> pa.Array:
        """What is hashed of each row, in order: first word (from the row's first), number of words,
        digest; check, the other half of a line's digest, 0 for anchors; and for those the digest of
        the words up to the end of the next anchor, 0 for a row's last."""
        first, last = self.lines()
        long = last - first >= line_words
        first, last = first[long], last[long]
        at = self.anchors()
        row = np.searchsorted(self.bounds, at, side="right") - 1
        follows = np.flatnonzero(row[1:] == row[:-1])
        gap = np.zeros(len(at), np.uint64)
        gap[follows] = self.digests(at[follows], at[follows + 1] + ANCHOR_WORDS, T._C) | np.uint64(1)
        check = self.digests(first, last, T._C) | np.uint64(1)
        digest = np.concatenate([self.digests(first, last, T._B), self.digests(at, at + ANCHOR_WORDS, T._B)])
        start = np.concatenate([first, at])
        size = np.concatenate([last - first, np.full(len(at), ANCHOR_WORDS)])
        check, gap = np.concatenate([check, np.zeros(len(at), np.uint64)]), np.concatenate([np.zeros(len(first), np.uint64), gap])
        by = np.argsort(start, kind="stable")
        row = np.searchsorted(self.bounds, start[by], side="right") - 1
        longs = [pa.array(x[by].view(np.int64)) for x in (digest, check, gap)]
        flat = [pa.array(start[by] - self.bounds[row], pa.int32()), pa.array(size[by], pa.int32()), *longs]
        flat = pa.StructArray.from_arrays(flat, names=["start", "size", "digest", "check", "gap"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(self.offsets))), pa.int32()), flat)

    def short_hashes(self, row: int) -> np.ndarray:
        """Half of the hash of each word of a row."""
        return (self.hash[self.bounds[row] : self.bounds[row + 1]] >> np.uint64(32)).astype("<u4")

    def removed(self, row: int, lines: list[dict], matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Byte ranges of a row's text to remove, given its repeated lines and ranges of words."""
        zero, first, last = self.offsets[row], self.bounds[row], self.bounds[row + 1]
        behind = lambda e: self.start[e] if e < last else self.offsets[row + 1]
        gone = [(self.start[first + r["start"]] - zero, behind(first + r["start"] + r["size"]) - zero) for r in lines]
        for s, e in matches:
            s, e = first + s, first + e
            # a range that ends with its line takes the break along only if it begins a line too
            ends = e < last and self.line[e] != self.line[e - 1]
            cut = ends and s > first and self.line[s] == self.line[s - 1]
            gone.append((self.start[s] - zero, (self.end[e - 1] if cut else behind(e)) - zero))
        return [(int(s), int(e)) for s, e in _merged(gone)]


def _merged(ranges: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """Number of words at the start that are the same."""
    k = min(len(x), len(y))
    unlike = np.flatnonzero(x[:k] != y[:k])
    return int(unlike[0]) if len(unlike) else k


def matches(own: np.ndarray, anchors: list[dict], run_words: int) -> list[tuple[int, int]]:
    """Ranges of a row's words, by their short hashes, that match an earlier place and have run_words or more.

    Anchors whose words up to the next one match too form a chain; its ends go on word by word."""
    found, s = [], 0
    for r in sorted(anchors, key=lambda r: r["start"]):
        if not r["before"]:
            left = np.frombuffer(r["left"], "<u4")
            s = r["start"] - _alike(own[: r["start"]][::-1], left[::-1])
        if not r["through"]:
            e = r["start"] + r["size"]
            e += _alike(own[e:], np.frombuffer(r["right"], "<u4"))
            if e - s >= run_words:
                found.append((s, e))
    return found


def _repeated(places: DataFrame) -> DataFrame:
    """_rank, _h, and the lines and anchors of each document that have an earlier place."""
    one = places.select("_rank", "_h", F.explode("places").alias("p"))
    one = one.select("p.digest", "p.check", "_rank", "_h", "p.start", "p.size", "p.gap")
    least = F.min(F.struct("_rank", "_h", "start", "gap")).alias("f")
    first = one.groupBy("digest", "check").agg(least, F.count("*").alias("k")).where("k > 1").select("digest", "check", "f")
    # written, as Spark splits a hot digest's rows only in a join that no aggregation feeds at once
    again = one.join(scratch.written(first, "firsts"), ["digest", "check"])
    again = again.where("struct(_rank, _h, start) <> struct(f._rank, f._h, f.start)")
    line = F.when(F.col("check") != 0, F.struct("start", "size"))
    anchor = F.when(F.col("check") == 0, F.struct("start", "size", "digest", "gap", "f"))
    again = again.groupBy("_rank", "_h").agg(F.collect_set(line).alias("lines"), F.array_sort(F.collect_set(anchor)).alias("a"))
    # whether the words up to the next anchor match, and those from the one before
    through = "coalesce(get(a, {0}).gap = get(a, {0}).f.gap and get(a, {0}).gap <> 0, false)"
    each = f"""transform(a, (x, i) -> struct(x.start as start, x.size as size, x.digest as digest, x.f as f,
        {through.format("i")} as through, {through.format("i - 1")} as before))"""
    return again.select("_rank", "_h", "lines", F.expr(each).alias("anchors"))


def _few(ids: DataFrame) -> DataFrame:
    """ids to be broadcast if they are few, counted."""
    return F.broadcast(ids) if ids.count() <= WANTED else ids


def _around(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """digest, left and right: the words on both sides of the earliest place of each anchor in ends."""
    asked = ends.groupBy(F.col("f._rank").alias("_rank"), F.col("f._h").alias("_h"))
    asked = asked.agg(F.collect_set(F.struct(F.col("f.start").alias("start"), "size", "digest")).alias("places"))
    asked = scratch.written(asked, "asked")
    texts = docs.join(_few(asked.select("_rank", "_h")), ["_rank", "_h"], "left_semi").dropDuplicates(["_rank", "_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                words, made = Words(part["text"]), []
                for i, places in enumerate(part["places"]):
                    own = words.short_hashes(i)
                    for p in places.as_py():
                        s, e = p["start"], p["start"] + p["size"]
                        made.append((p["digest"], own[max(0, s - CONTEXT) : s].tobytes(), own[e : e + CONTEXT].tobytes()))
                digest, left, right = zip(*made, strict=True) if made else ((), (), ())
                arrays = [pa.array(digest, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["digest", "left", "right"])

    return texts.join(asked, ["_rank", "_h"]).select("text", "places").mapInArrow(run, "digest long, left binary, right binary")


def _repeats(docs: DataFrame, line_words: int) -> DataFrame:
    """_rank, _h, the lines with an earlier place, and the anchors with the words around that place."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                arrays = [part["_rank"], part["_h"], Words(part["text"]).hashed(line_words)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_rank", "_h", "places"])

    to = "_rank long, _h long, places array<struct<start:int,size:int,digest:long,check:long,gap:long>>"
    rows = scratch.written(docs.mapInArrow(places, to).where("size(places) > 0"), "places")
    again = scratch.written(_repeated(rows), "repeats")
    each = again.select("_rank", "_h", F.explode("anchors").alias("p")).select("_rank", "_h", "p.*")
    ends = each.where("not (through and before)")
    known = scratch.written(_around(docs, ends.select("f", "size", "digest")), "around")
    ends = ends.join(known, "digest").select("_rank", "_h", "start", "size", "before", "through", "left", "right")
    none = F.lit(None).cast("binary")
    inner = each.where("through and before").select("_rank", "_h", "start", "size", "before", "through", none.alias("left"), none.alias("right"))
    anchors = ends.unionByName(inner).groupBy("_rank", "_h")
    anchors = anchors.agg(F.collect_list(F.struct("start", "size", "before", "through", "left", "right")).alias("anchors"))
    return again.select("_rank", "_h", "lines").join(anchors, ["_rank", "_h"], "left")


def remove_repeats(docs: DataFrame, line_words: int = 1, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with text replaced by what stays of it, and removed: the original offsets, in code
    points, of what was taken out.

    Every repeated line of line_words words or more goes, 1 for all, and every match of run_words or
    more inside lines. doc_id ranks documents (null last, then by a hash of the text). Rows alike in
    id and text count as one document and share its result. Null texts stay null, empty ones empty;
    a very long text is worked on alone. A column removed is replaced, others stay as they are. An
    empty table gives no rows."""
    needed, whole = ["doc_id", "text"], docs.columns
    docs = scratch.packed(scratch.in_small_batches(docs), *needed)
    kept = docs.columns
    keyed = docs.withColumns({"_h": F.xxhash64("text"), "_rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))})
    found = _repeats(keyed.where("text is not null").select("_rank", "_h", "text"), line_words)
    found = scratch.written(found, "found")
    to = docs.select("*", F.lit(None).cast("array<struct<start:long,end:long>>").alias("removed")).schema
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                words, texts, taken = Words(part["text"]), [], []
                for i, (text, lines, anchors) in enumerate(zip(part["text"].to_pylist(), part["lines"].to_pylist(), part["anchors"], strict=True)):
                    long = matches(words.short_hashes(i), anchors.as_py(), run_words) if anchors.is_valid else []
                    gone = words.removed(i, lines or [], long)
                    raw = words.data[words.offsets[i] : words.offsets[i + 1]]
                    chars = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
                    ends = [0, *[e for _, e in gone]]
                    stays = [raw[a:b].tobytes() for a, b in zip(ends, [*[s for s, _ in gone], len(raw)], strict=True)]
                    texts.append(b"".join(stays).decode() if gone else text)
                    taken.append([{"start": int(chars[s]), "end": int(chars[e])} for s, e in gone])
                arrays = [pa.array(texts, part.schema.field(c).type) if c == "text" else part[c] for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(taken, spans)], names=[*kept, "removed"])

    # only documents that have repeats move
    ids = _few(found.select("_rank", "_h"))
    some = keyed.join(ids, ["_rank", "_h"], "left_semi").join(found, ["_rank", "_h"]).select(*kept, "lines", "anchors")
    others = keyed.join(ids, ["_rank", "_h"], "left_anti").select(*kept, F.array().cast(to["removed"].dataType).alias("removed"))
    out = some.mapInArrow(cut, to).union(others)
    return scratch.unpacked(out, needed, whole, "removed")


def op9_line_hashing(spark, sf_dir: str) -> DataFrame:
    """All documents: what stays of each text, and what was removed from it."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), LINE_WORDS)
