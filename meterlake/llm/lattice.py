"""LM scoring by subword lattice likelihood.

The pieces of an existing vocabulary span a lattice over the bytes of each word; the likelihood of a
word is the sum over all its segmentations, by a forward recursion in log space. Three models of a
document are built on it, each a product over its words and an end:

- vocabulary_score weights pieces by the vocabulary's own scores and learns nothing but how often
  documents end;
- a class (a language) has a lattice of its own: its weights start at the vocabulary's scores and are
  fitted to the distinct words of the class's training documents by expected counts, from forward and
  backward sums. A further lattice, of all classes, starts at single bytes and learns what words are
  like that no language explains (numbers, addresses, keys); each class takes a share of it;
- score also has the words themselves as edges: a word that a class's training documents have c
  times spans its lattice as a whole with weight (c - D) / N, where the discount D depends on c alone.
  What the discounts leave over goes to the class's lattice, and to words of other classes as far as
  words that the class has once tell that it takes such.

A document's marginal likelihood is the sum over the classes, which it doesn't have to tell. Pieces
don't cross words, so a word is worked on once however often it occurs."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from meterlake.llm import scratch
from meterlake.llm import text as T

#: Learning steps, and the pseudo-counts of the vocabulary's own scores in each lattice.
STEPS, PRIOR = 6, 20.0
#: Share of the odd words' lattice at the start, and pseudo-counts of it.
ODD, ODD_PRIOR = 0.02, 1.0
#: Words whose counts and scores each task holds: the most frequent ones, at most this many.
FREQUENT = 300_000
#: Documents with this remainder of crc32(id) by 7 are held out.
FOLDS, HELD_OUT = 7, 2
#: Classes of the mixture at most: the largest languages, and one for all others. A task's work and
#: weights grow with it.
CLASSES = 12
#: Bytes of words, times lattices, that a recursion works on at once.
ROOM = 400_000
#: Bytes of rows that a task gathers from small batches before it works on them: of few words at a time
#: most have a length of their own, and each length costs a pass over the weights.
GATHERED = 4 << 20
LOG10 = math.log(10)


class Pieces:
    """Byte strings, found by hash in two tables; every single byte is one. logp: the vocabulary's weights."""

    def __init__(self, entries: list[bytes], logp: np.ndarray):
        self.entries, self.logp = entries, logp
        self.longest = max(map(len, entries))
        flat = np.frombuffer(b"".join(entries), np.uint8)
        ends = np.cumsum([len(e) for e in entries])
        self.codes = T.word_hashes(flat, np.concatenate([[0], ends[:-1]]), ends, lower=False)
        bits = max(8, (32 * len(entries) - 1).bit_length())
        # entries that meet others in the first table stand in the second; those that do there too, in order
        self.shifts = (np.uint64(64 - bits), np.uint64(64 - 2 * bits))
        self.mask = np.uint64((1 << bits) - 1)
        self.tables = [np.full(1 << bits, -1, np.int32) for _ in self.shifts]
        rest = np.arange(len(entries))
        for shift, table in zip(self.shifts, self.tables, strict=True):
            slot = (self.codes[rest] >> shift) & self.mask
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = rest[first]
            rest = np.delete(rest, first)
        self.rest = rest[np.argsort(self.codes[rest])]

    def __getstate__(self) -> dict:
        """Without the tables, which are many times as large as the entries and quickly made again."""
        return {"entries": self.entries, "logp": self.logp}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def find(self, eight: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the pieces at byte ranges of one size, -1 where there is none; eight: T.eights of the
        bytes. Only where another piece has the place in one table can a piece be in the next."""
        codes = T.run_hashes(eight, starts, size)
        out = self.tables[0][codes >> self.shifts[0]]
        other = np.flatnonzero((self.codes[out] != codes) & (out >= 0))
        if len(other):
            left = codes[other]
            at = self.tables[1][(left >> self.shifts[1]) & self.mask]
            at = np.where(self.codes[at] == left, at, -1)
            if len(self.rest):
                third = self.rest[np.minimum(np.searchsorted(self.codes[self.rest], left), len(self.rest) - 1)]
                at = np.where(self.codes[third] == left, third, at)
            out[other] = at
        return out


def read_pieces(path: str) -> Pieces:
    """A vocabulary file's pieces but those with a space inside, which no word has. Its scores fall by
    one with each rank, so the weight of a piece is one over its rank; bare bytes have the least."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in raw[1:]:
            found[raw] = max(found.get(raw, 0.0), 1 / (10 - min(0.0, model.get_score(i))))
    least = min(found.values(), default=1.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    weights = np.array([*found.values()])
    return Pieces([*found], np.log(weights / weights.sum()))


def _add(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over the first axis."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _forward(word: bytes, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """As likelihoods, for one word, byte after byte: those of its beginnings (bytes, sets)."""
    number = {e: i for i, e in enumerate(pieces.entries)}
    a = np.zeros((len(word) + 1, len(logp)))
    for j in range(1, len(word) + 1):
        spans = [(i, p) for i in range(max(0, j - pieces.longest), j) if (p := number.get(word[i:j])) is not None]
        a[j] = _add(np.stack([a[i] + logp[:, p] for i, p in spans]))
    return a


def _backward(word: bytes, pieces: Pieces, logp: np.ndarray, a: np.ndarray, share: np.ndarray, counts: np.ndarray) -> None:
    """As Lattice.expected, for one word, byte after byte; a as _forward gives it, share (sets)."""
    number = {e: i for i, e in enumerate(pieces.entries)}
    n = len(word)
    b = np.zeros_like(a)
    for i in range(n - 1, -1, -1):
        spans = [(j, p) for j in range(i + 1, min(n, i + pieces.longest) + 1) if (p := number.get(word[i:j])) is not None]
        tails = np.stack([b[j] + logp[:, p] for j, p in spans])
        b[i] = _add(tails)
        counts[:, [p for _, p in spans]] += (np.exp(a[i] + tails - a[n]) * share).T


class Lattice:
    """The lattices of some words of one length in bytes, for several sets of weights (sets, pieces)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, n: int, pieces: Pieces, logp: np.ndarray):
        self.n, self.words, self.sets = n, len(starts), len(logp)
        self.edges: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, numbers by start, log weights
        weights = np.concatenate([logp, np.full((self.sets, 1), -np.inf)], axis=1)
        eight = T.eights(data)
        for k in range(1, min(n, pieces.longest) + 1):
            start = (starts[None, :] + np.arange(n - k + 1)[:, None]).ravel()
            number = pieces.find(eight, start, k).reshape(n - k + 1, -1)
            if (number >= 0).any():
                self.edges.append((k, number, np.take(weights, number, axis=1)))
        self.a = np.zeros((n + 1, self.sets, self.words))
        for j in range(1, n + 1):
            self.a[j] = _add(np.stack([self.a[j - k] + w[:, j - k] for k, _, w in self.edges if k <= j]))

    def expected(self, share: np.ndarray, counts: np.ndarray) -> None:
        """Adds to counts (sets, pieces) the expected numbers of pieces, times share (sets, words)."""
        b = np.zeros_like(self.a)
        for i in range(self.n - 1, -1, -1):
            b[i] = _add(np.stack([b[i + k] + w[:, i] for k, _, w in self.edges if k <= self.n - i]))
        # places in arrays laid flat, of which one index is quicker to follow than three
        a, b, many = self.a.ravel(), b.ravel(), self.words * (self.sets - 1)
        for k, number, w in self.edges:
            at = np.flatnonzero(number.ravel() >= 0)
            row, found, w = at % self.words, number.ravel()[at], w.reshape(self.sets, -1)
            start = at + at // self.words * many
            for c in range(self.sets):
                first = start + c * self.words
                part = np.exp(a[first] + w[c, at] + b[first + k * (many + self.words)] - self.a[self.n, c, row]) * share[c, row]
                counts[c] += np.bincount(found, part, counts.shape[1])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in larger ones, of GATHERED bytes and one batch more at most."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _by_length(column: pa.Array, room: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, rows, data and starts of byte strings of one length, about room bytes together."""
    data, offsets = T.utf8(column)
    size = np.diff(offsets)
    for n in np.unique(size[size > 0]):
        every = np.flatnonzero(size == n)
        step = max(1, room // int(n))
        for rows in np.split(every, range(step, len(every), step)):
            yield int(n), rows, data, offsets[rows]


def likelihoods(column: pa.Array, pieces: Pieces, logp: np.ndarray | None = None) -> np.ndarray:
    """Log likelihood of each byte string over all its segmentations, for each set of weights (sets,
    pieces); by default for the vocabulary's own."""
    logp = pieces.logp[None] if logp is None else logp
    out = np.zeros((len(logp), len(column)))
    for n, rows, data, starts in _by_length(column, ROOM // len(logp)):
        if n > 2048:
            out[:, rows] = np.stack([_forward(data[s : s + n].tobytes(), pieces, logp)[-1] for s in starts], axis=1)
        else:
            out[:, rows] = Lattice(data, starts, n, pieces, logp).a[n]
    return out


class Mixture:
    """Log weights of each class's lattice and, last, of the odd words' one; each class's share of that."""

    def __init__(self, logp: np.ndarray, odd: np.ndarray):
        self.logp, self.odd = logp, odd

    def words(self, lattices: np.ndarray) -> np.ndarray:
        """Log likelihoods of words in each class, by those in each lattice."""
        return np.logaddexp(np.log1p(-self.odd)[:, None] + lattices[:-1], np.log(self.odd)[:, None] + lattices[-1])


def _start(pieces: Pieces, classes: int) -> Mixture:
    single = np.array([len(e) == 1 for e in pieces.entries])
    odd = np.log(0.99 * single / single.sum() + 0.01 * np.exp(pieces.logp))
    return Mixture(np.stack([*[pieces.logp] * classes, odd]), np.full(classes, ODD))


def _learn(words: DataFrame, pieces: Pieces, classes: int) -> Mixture:
    """Fits the lattices to the distinct words of each class's training documents, STEPS times. The
    driver sees a row for each piece and lattice."""
    first = now = _start(pieces, classes)
    for _ in range(STEPS):
        shared = words.sparkSession.sparkContext.broadcast((pieces, now))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, now = shared.value
            counts, odd = np.zeros(now.logp.shape), np.zeros((2, classes))
            for batch in _gathered(batches):
                for k in range(classes):
                    both = now.logp[[k, -1]]
                    own = batch.filter(pc.greater(batch[f"c_{k}"], 0))["word"]
                    before = np.log([1 - now.odd[k], now.odd[k]])[:, None]
                    for n, _, data, starts in _by_length(own, ROOM // 2):
                        made = np.zeros(both.shape)
                        if n > 2048:
                            words = [data[s : s + n].tobytes() for s in starts]
                            share = np.zeros((2, len(words)))
                            for w, word in enumerate(words):
                                a = _forward(word, pieces, both)
                                own_share = before[:, 0] + a[n]
                                share[:, w] = np.exp(own_share - _add(own_share))
                                _backward(word, pieces, both, a, share[:, w], made)
                        else:
                            lattice = Lattice(data, starts, n, pieces, both)
                            share = before + lattice.a[n]
                            share = np.exp(share - _add(share))
                            lattice.expected(share, made)
                        counts[[k, -1]] += made
                        odd[:, k] += share[1].sum(), len(starts)
            lattice, piece = np.nonzero(counts)
            numbers = np.concatenate([piece, np.full(2 * classes, -1)]), np.concatenate([lattice, np.arange(2 * classes)])
            arrays = [*[pa.array(x.astype(np.int32)) for x in numbers], pa.array(np.concatenate([counts[lattice, piece], odd.ravel()]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "lattice", "expected"])

        used = words.where("c > 0").drop("code", "n", "c").mapInArrow(run, "piece int, lattice int, expected double")
        got = used.groupBy("piece", "lattice").agg(F.sum("expected").alias("e")).toArrow()
        shared.destroy()  # or each step's weights stay on the disks of the driver and all executors
        piece, lattice, e = (got[c].to_numpy() for c in ("piece", "lattice", "e"))
        counts, odd = PRIOR * np.exp(first.logp), np.zeros(2 * classes)
        counts[lattice[piece >= 0], piece[piece >= 0]] += e[piece >= 0]
        odd[lattice[piece < 0]] = e[piece < 0]
        share = (odd[:classes] + ODD * ODD_PRIOR) / (odd[classes:] + ODD_PRIOR)
        now = Mixture(np.log(counts / counts.sum(axis=1, keepdims=True)), np.clip(share, 1e-6, 0.5))
    return now


def _classes(docs: DataFrame, by: str | None) -> tuple[DataFrame, list[int]]:
    """docs with class, and the training documents of each class. Class 0 is that of all others;
    the driver sees CLASSES rows at most."""
    if by is None:
        return docs.withColumn("class", F.lit(0)), [docs.where("not held_out").count()]
    counts = docs.where("not held_out").groupBy("by").agg(F.count("*").alias("n"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.where("by is not null").orderBy(F.desc("n"), "by").limit(CLASSES - 1).collect()
    number = F.lit(0)
    for k, r in enumerate(top, 1):
        number = F.when(F.col("by") == r.by, k).otherwise(number)
    return docs.withColumn("class", number), [whole - sum(r.n for r in top), *[r.n for r in top]]


def _count_words(docs: DataFrame, classes: int) -> DataFrame:
    """code, word (lower-cased, behind a space), c (in training documents), n (in all) and c_k (in
    training documents of class k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 4 * T.SLICE_BYTES):
                data, offsets = T.utf8(part["text"])
                starts, ends, bounds = T.words(data, offsets)
                hashes, count = T.word_hashes(data, starts, ends), np.diff(bounds)
                kind = np.repeat(part["class"].to_numpy(), count)
                keys = hashes ^ T.mix(kind.astype(np.uint64) + T._B)
                _, first, which = np.unique(keys, return_index=True, return_inverse=True)
                used = np.repeat(~part["held_out"].to_numpy(zero_copy_only=False), count)
                raw, ranges = T._LOWER[data], zip(starts[first].tolist(), ends[first].tolist(), strict=True)
                words = [b" " + raw[s:e].tobytes() for s, e in ranges]
                counts = [np.bincount(which, used, len(first)), np.bincount(which, minlength=len(first))]
                arrays = [pa.array(hashes[first].view(np.int64)), pa.array(words, pa.binary())]
                arrays += [pa.array(c.astype(np.int64)) for c in counts] + [pa.array(kind[first].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["code", "word", "c", "n", "class"])

    found = docs.mapInArrow(run, "code long, word binary, c long, n long, class int").groupBy("code")
    own = [F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)).alias(f"c_{k}") for k in range(classes)]
    return found.agg(F.first("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n"), *own)


def _totals(words: DataFrame, classes: int) -> Row:
    """Over all words: occurrences and distinct ones in training, in each class too; of each class also
    the words that it has 1 to 4 times, and those it has once that others have."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    asked = [total("c", "c"), F.count_if(F.col("c") > 0).alias("v")]
    for k in range(classes):
        c = F.col(f"c_{k}")
        asked += [total(c, f"c_{k}"), F.count_if(c > 0).alias(f"v_{k}"), F.count_if((c == 1) & (F.col("c") > 1)).alias(f"f_{k}")]
        asked += [F.count_if(c == i).alias(f"n{i}_{k}") for i in range(1, 5)]
    return words.agg(*asked).first()


def _discounts(n: list[int]) -> list[float]:
    """What is taken from words that occur 0, 1, 2 and 3 or more times, by how many occur 1 to 4 times."""
    y = n[0] / max(1, n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / max(1, n[0]), 2 - 3 * y * n[2] / max(1, n[1]), 3 - 4 * y * n[3] / max(1, n[2])]
    return [0.0, *[min(i - 0.05, max(0.1, d)) for i, d in enumerate(raw, 1)]]


class Model:
    """Likelihoods of words given a class, from counts and lattices."""

    def __init__(self, total: Row, sizes: list[int], mixture: Mixture, pieces: Pieces):
        self.pieces, self.sizes = pieces, sizes
        self.ends, classes = sum(sizes), range(len(sizes))
        self.tokens, self.kinds = total.c + self.ends, total.v + (self.ends > 0)
        self.own = [total[f"c_{k}"] + sizes[k] for k in classes]
        counts = [[total[f"n{i}_{k}"] for i in range(1, 5)] for k in classes]
        self.discounts = [np.array(_discounts(n)) for n in counts]
        taken = [d[1] * n[0] + d[2] * n[1] + d[3] * (total[f"v_{k}"] + (sizes[k] > 0) - n[0] - n[1]) for k, (d, n) in enumerate(zip(self.discounts, counts))]
        self.spare = [t / own if own else 1.0 for t, own in zip(taken, self.own)]
        others = [total.c - total[f"c_{k}"] for k in classes]
        self.others = [max(1, x) for x in others]
        foreign = [min(0.99, (total[f"f_{k}"] + 0.01) / (counts[k][0] + 1)) for k in classes]
        self.foreign = [f if x else 0.0 for f, x in zip(foreign, others)]
        self.mixture = mixture

    def given(self, k: int, lattice: np.ndarray, c: np.ndarray, c_k: np.ndarray) -> np.ndarray:
        """log10 likelihood in class k of words that it has c_k times, and all classes c times, by their
        natural logarithm in its lattice. All in logarithms, as the likelihood of a very long word is
        below the least double."""
        with np.errstate(divide="ignore"):
            other = np.log(self.foreign[k] * (c - c_k) / self.others[k])
            rest = math.log(self.spare[k]) + np.logaddexp(other, math.log1p(-self.foreign[k]) + lattice)
            if self.own[k]:
                less = self.discounts[k][np.minimum(c_k, 3)]
                rest = np.logaddexp(np.log(np.maximum(c_k - less, 0) / self.own[k]), rest)
        return rest / LOG10

    def weigh(self, words: pa.Array, c: np.ndarray, c_k: list[np.ndarray]) -> list[np.ndarray]:
        """log10 likelihoods of words in each class, and by the vocabulary's own scores."""
        every = likelihoods(words, self.pieces, np.concatenate([self.mixture.logp, self.pieces.logp[None]]))
        lattices = self.mixture.words(every[:-1])
        word = math.log1p(-self.ends / self.tokens) if self.tokens > self.ends else 0.0
        return [*[self.given(k, x, c, n) for k, (x, n) in enumerate(zip(lattices, c_k))], (word + every[-1]) / LOG10]

    def end_scores(self) -> list[float]:
        """log10 likelihoods of the end, as weigh() gives them for words."""
        if not self.ends:
            return [0.0] * (len(self.sizes) + 1)
        none, ends = np.array([-np.inf]), np.array([self.ends])
        own = [float(self.given(k, none, ends, np.array([n]))[0]) for k, n in enumerate(self.sizes)]
        return [*own, math.log10(self.ends / self.tokens)]

    def priors(self) -> list[float]:
        return [math.log10((n + 1) / (self.ends + len(self.sizes))) for n in self.sizes]


def _weighed(words: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """code, c and n of each word, and its log10 likelihoods."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            for part in T.slices(batch, "word"):
                own = [part[f"c_{k}"].to_numpy() for k in range(len(columns) - 1)]
                made = shared.value.weigh(part["word"], part["c"].to_numpy(), own)
                yield pa.RecordBatch.from_arrays([part["code"], part["c"], part["n"], *map(pa.array, made)], names=["code", "c", "n", *columns])

    return words.mapInArrow(run, "code long, c long, n long, " + ", ".join(f"{c} double" for c in columns))


def _most_frequent(table: DataFrame) -> DataFrame:
    """The most frequent words: whole steps of the count, FREQUENT words at most."""
    step = F.floor(F.log2("n") * 8).cast("int")
    room, least = FREQUENT, None
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    return table.where(step >= least) if least is not None else table.limit(0)


def _local_sums(docs: DataFrame, table: DataFrame, columns: list[str], floor: float) -> DataFrame:
    """Of each document the sums over its frequent words, and codes and times of its other words."""
    top = _most_frequent(table).select("code", "c", *columns).toArrow().combine_chunks().sort_by("code")
    often = (top["code"].to_numpy(), top["c"].to_numpy(), [top[c].to_numpy() for c in columns])
    often = docs.sparkSession.sparkContext.broadcast(often)
    names = ["doc_id", "held_out", "n_words", "known", "base", *columns, "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, c, logps = often.value
        base = np.log10((c + 1) / floor)
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offsets = T.utf8(part["text"])
                starts, ends, bounds = T.words(data, offsets)
                code = T.word_hashes(data, starts, ends).view(np.int64)
                row, n = np.repeat(np.arange(len(part)), np.diff(bounds)), len(part)
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                here = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                at, own = at[here], row[here]
                sums = [np.bincount(own, x[at], n) for x in ((c > 0).astype(float), base, *logps)]
                rest_row, rest = row[~here], code[~here]
                by = np.lexsort((rest, rest_row))
                rest_row, rest = rest_row[by], rest[by]
                new = np.ones(len(rest), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (rest_row[1:] != rest_row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rest))).astype(np.int32)
                to = pa.array(np.searchsorted(rest_row[first], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(to, pa.array(x)) for x in (rest[first], times)]
                arrays = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], *arrays, *lists], names=names)

    to = "doc_id long, held_out boolean, n_words long, known long, base double, "
    to += ", ".join(f"{c} double" for c in columns) + ", codes array<long>, times array<int>"
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, to)


def _sum_exp(x: list) -> F.Column:
    """log10 of the sum of powers of ten."""
    x = F.array(*x)
    return F.array_max(x) + F.log10(F.aggregate(F.transform(x, lambda v: F.pow(F.lit(10.0), v - F.array_max(x))), F.lit(0.0), lambda a, v: a + v))


def score_documents(docs: DataFrame, pieces: Pieces, by: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and vocabulary_score of each
    document.

    Null texts are empty: their only token is the end; very long words are worked on alone. A null id is
    in training. by names the column of the classes, which counts in training documents alone; null
    belongs to class 0. base_score is the add-one unigram; score the model's log10 likelihood,
    vocabulary_score that of the lattice by the vocabulary's own scores. Repeated rows count, and are
    scored, each. Without training documents the lattice's weights are the vocabulary's own and the end
    is certain. An empty table gives no rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD_OUT
    kind = (F.lit(None) if by is None else F.col(by)).cast("string").alias("by")
    docs = scratch.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), kind)
    docs, sizes = _classes(docs, by)
    words = scratch.written(_count_words(docs.select("text", "held_out", "class"), len(sizes)), "words")
    model = Model(_totals(words, len(sizes)), sizes, _learn(words, pieces, len(sizes)), pieces)
    columns = [*[f"logp_{k}" for k in range(len(sizes))], "own_scores"]
    table = scratch.written(_weighed(words, model, columns), "weighed")
    floor = float(model.tokens + model.kinds + 1)
    local = _local_sums(docs, table, columns, floor).withColumn("_row", F.monotonically_increasing_id())
    local = scratch.written(local, "scored")
    each = local.select("_row", F.explode(F.arrays_zip("codes", "times")).alias("x"))
    each = each.select("_row", F.col("x.codes").alias("code"), F.col("x.times").alias("tf")).join(table, "code")
    sums = {c: F.sum(F.col("tf") * F.col(c)).alias(f"_{c}") for c in columns}
    sums["base"] = F.sum(F.col("tf") * F.log10((F.col("c") + 1) / F.lit(floor))).alias("_base")
    sums["known"] = F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("_known")
    out = local.drop("codes", "times").join(each.groupBy("_row").agg(*sums.values()), "_row", "left")
    end = dict(zip([*columns, "base", "known"], [*model.end_scores(), math.log10((model.ends + 1) / floor), int(model.ends > 0)]))
    whole = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) + F.lit(end[c]) for c in sums}
    score = _sum_exp([F.lit(p) + whole[c] for p, c in zip(model.priors(), columns)])
    counts = [(F.col("n_words") + 1).alias("n_tokens"), whole["known"].cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens")]
    scores = [whole["base"].alias("base_score"), score.alias("score"), whole["own_scores"].alias("vocabulary_score")]
    return out.select("doc_id", "held_out", *counts, *scores)


def op8_subword_lattice(spark, sf_dir: str) -> DataFrame:
    """All documents by the 32k vocabulary."""
    import public_tokenizers

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")), "lang")
