"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: the text's content (words and word
ends, hashed) and the page's metadata (language, source, length, layout). In each round both score
all unlabelled documents, and each hands the ones that it is surest of to the other as labelled
rows. Both are then calibrated on labels that neither was fitted on, and their calibrated scores
are combined to score all documents."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import scratch
from meterlake.llm import text as T

#: Labelled documents that fitting uses at most: those with the least seeded id hashes.
LABELLED = 8_000
#: Every fifth labelled row calibrates.
CALIBRATE = 5
#: Rounds, documents of each class that a view hands on in a round at most, and how sure it must be.
ROUNDS, HANDED, SURE = 3, 400, 0.9
#: Steps of the first fit, and of those that go on from earlier weights.
STEPS, MORE_STEPS = 40, 15
TEXT_BITS, META_BITS = 16, 12
#: At most this share of the good calibration rows may be rejected.
LOST = 0.002
#: Features that fitting works on at once.
BLOCK = 200_000


class View:
    """Rows of hashed features: for each entry its row, feature number and value."""

    def __init__(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int, size: int):
        self.row, self.index, self.value, self.rows, self.size = row, index, value, rows, size

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index] * self.value, self.rows) + w[-1]

    def lists(self) -> list[pa.Array]:
        """Feature numbers and values of each row, as two list columns."""
        by = np.argsort(self.row, kind="stable")
        to = pa.array(np.searchsorted(self.row[by], np.arange(self.rows + 1)), pa.int32())
        index, value = self.index[by].astype(np.int32), self.value[by].astype(np.float32)
        return [pa.ListArray.from_arrays(to, pa.array(x)) for x in (index, value)]


class Rows:
    """Rows of one view on the driver, in 32-bit numbers: bounds of each row, features, values."""

    def __init__(self, index: pa.ChunkedArray, value: pa.ChunkedArray, size: int):
        whole = lambda x, kind: np.concatenate([np.zeros(0, kind), *[c.flatten().to_numpy() for c in x.chunks]])
        self.count = np.concatenate([np.zeros(0, np.int32), *[c.value_lengths().to_numpy() for c in index.chunks]])
        self.bounds = np.concatenate([[0], np.cumsum(self.count, dtype=np.int64)])
        self.index, self.value, self.size = whole(index, np.int32), whole(value, np.float32), size
        # whole rows, about BLOCK features together
        cut = np.searchsorted(self.bounds, np.arange(BLOCK, self.bounds[-1], BLOCK))
        self.blocks = np.unique([0, *cut.tolist(), len(self.count)])

    def dot(self, w: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        b = len(self.count) if b is None else b
        part = slice(self.bounds[a], self.bounds[b])
        made = np.concatenate([[0.0], np.cumsum(w[self.index[part]] * self.value[part])])
        to = self.bounds[a : b + 1] - self.bounds[a]
        return made[to[1:]] - made[to[:-1]] + w[-1]

    def gradient(self, w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        g = np.zeros(self.size + 1)
        for a, b in zip(self.blocks[:-1], self.blocks[1:]):
            part = slice(self.bounds[a], self.bounds[b])
            error = (_sigmoid(self.dot(w, a, b)) - y[a:b]) * weight[a:b]
            g += np.bincount(self.index[part], self.value[part] * np.repeat(error, self.count[a:b]), len(g))
            g[-1] += error.sum()
        return g


def _counted(row: np.ndarray, feature: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and counts of the distinct features of each row."""
    key = np.sort(row.astype(np.int64) * size + (feature % np.uint64(size)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] // size, key[first] % size, np.diff(np.append(first, len(key)))


def _view(families: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int, size: int) -> View:
    """Takes logarithms of the counts and scales each row to length 1."""
    row, index, count = (np.concatenate(x) for x in zip(*families, strict=True))
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, rows))
    return View(row, index, value / norm[row], rows, size)


def text_view(column: pa.Array) -> View:
    """Words, the last two and three bytes of words, whether a word repeats the one before, and
    the share of distinct words in steps."""
    data, offsets = T.utf8(column)
    starts, ends, bounds = T.words(data, offsets)
    n, count, size = len(column), np.diff(bounds), 1 << TEXT_BITS
    row = np.repeat(np.arange(n), count)
    whole = T.word_hashes(data, starts, ends)
    words = _counted(row, whole, size)
    tails = [T.mix(T.word_hashes(data, np.maximum(ends - k, starts), ends) + np.uint64(k)) for k in (2, 3)]
    same = np.zeros(len(row), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (row[1:] == row[:-1])
    again = T.mix(np.full(int(same.sum()), 100, np.uint64))
    share = np.bincount(words[0], minlength=n) / np.maximum(count, 1)
    # few words say little about their share of distinct ones
    step = np.where(count >= 20, np.floor(share * 10), 99).astype(np.uint64)
    families = [words, *[_counted(row, t, size) for t in tails], _counted(row[same], again, size)]
    return _view([*families, _counted(np.arange(n), T.mix(step + np.uint64(1000)), size)], n, size)


def meta_view(lang: list, source: list, column: pa.Array) -> View:
    """Language, source, and logarithmic steps of length, lines, words a line and bytes a word."""
    data, offsets = T.utf8(column)
    _, _, bounds = T.words(data, offsets)
    size, words = np.diff(offsets), np.diff(bounds)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    step = lambda x, k: np.round(np.log2(x + 1) * k).astype(int)
    steps = [step(size, 1), step(lines, 2), step(words / lines, 2), step(size / np.maximum(words, 1), 4)]
    numbers = [[f"{k} {x}" for x in s] for k, s in enumerate(steps)]
    names = [[f"lang {x}" for x in lang], [f"source {x}" for x in source], *numbers]
    flat, to = T.utf8(pa.array([x for n in names for x in n], pa.large_string()))
    feature = T.word_hashes(flat, to[:-1], to[1:], lower=False)
    row = np.tile(np.arange(len(column)), len(names))
    return _view([_counted(row, feature, 1 << META_BITS)], len(column), 1 << META_BITS)


def views_of(part: pa.RecordBatch) -> list[View]:
    return [text_view(part["text"]), meta_view(part["lang"].to_pylist(), part["source"].to_pylist(), part["text"])]


class Fitted:
    """A view's training rows, those with a label and what the other view has handed on, and its weights."""

    def __init__(self, size: int):
        self.size, self.parts, self.w = size, [], None

    def add(self, rows: Rows, y: np.ndarray, used: np.ndarray | None = None) -> None:
        """used: which rows to fit on, all by default."""
        self.parts.append((rows, y, np.ones(len(y), bool) if used is None else used))

    def fit(self, ridge: float = 1e-4) -> None:
        """Logistic regression, classes weighing the same, by Adam over all rows; goes on from the
        weights that there are."""
        steps = STEPS if self.w is None else MORE_STEPS
        w = np.zeros(self.size + 1) if self.w is None else self.w
        m, v = np.zeros_like(w), np.zeros_like(w)
        good, bad = (max(1, sum(int((used & (y == k)).sum()) for _, y, used in self.parts)) for k in (1, 0))
        for k in range(1, steps + 1):
            parts = [rows.gradient(w, y, used * np.where(y > 0, 0.5 / good, 0.5 / bad)) for rows, y, used in self.parts]
            g = sum(parts) + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            w = w - 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        self.w = w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A few columns and an intercept, by Newton's method with a light ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w), -5, 5)
    return w


class Model:
    """Weights of both views, their calibration, how they are combined, and the least kept score."""

    def __init__(self, weights: list[np.ndarray], z: np.ndarray, good: np.ndarray):
        """z, good: what the views make of the calibration rows, and those rows' labels."""
        self.weights = weights
        self.single = [_logistic(z[:, [k]], good) for k in (0, 1)]
        own = np.column_stack([z[:, k] * s[0] + s[1] for k, s in enumerate(self.single)])
        self.both = _logistic(own, good)
        p = _sigmoid(own @ self.both[:2] + self.both[2])
        kept = p[good > 0]
        self.least = float(min(0.5, np.quantile(kept, LOST))) if len(kept) else 0.0

    def scores(self, views: list[View]) -> list[np.ndarray]:
        own = [v.dot(w) * s[0] + s[1] for v, w, s in zip(views, self.weights, self.single, strict=True)]
        return [*map(_sigmoid, own), _sigmoid(np.column_stack(own) @ self.both[:2] + self.both[2])]


def _features(docs: DataFrame, wanted: DataFrame) -> tuple[np.ndarray, list[Rows]]:
    """y and both views of wanted (doc_id, y), in order of doc_id. wanted has a bounded number of ids;
    of rows of one id that with the least hash is taken."""
    rows = docs.join(F.broadcast(wanted), "doc_id")
    least = F.min(F.struct(F.xxhash64("lang", "source", "text"), "lang", "source", "text")).alias("r")
    rows = rows.groupBy("doc_id", "y").agg(least).select("doc_id", "y", "r.lang", "r.source", "r.text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                lists = [x for v in views_of(part) for x in v.lists()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], *lists], names=["doc_id", "y", "ti", "tv", "mi", "mv"])

    to = "doc_id long, y int, ti array<int>, tv array<float>, mi array<int>, mv array<float>"
    got = rows.mapInArrow(made, to).orderBy("doc_id", "y").drop("doc_id").toArrow()
    views = [Rows(got["ti"], got["tv"], 1 << TEXT_BITS), Rows(got["mi"], got["mv"], 1 << META_BITS)]
    return got["y"].to_numpy().astype(float), views


def _surest(docs: DataFrame, marks: DataFrame, handed: DataFrame | None, weights: list[np.ndarray], seed: int) -> DataFrame:
    """doc_id, y and to: what either view hands to the other (to), of all documents without a label
    that were not handed on before. HANDED rows of each class and view at most."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                p = [pa.array(_sigmoid(v.dot(w))) for v, w in zip(views_of(part), shared.value, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *p], names=["doc_id", "p0", "p1"])

    sure = docs.mapInArrow(run, "doc_id long, p0 double, p1 double")
    sure = sure.where(f"greatest(p0, p1) >= {SURE} or least(p0, p1) <= {1 - SURE}")
    # rows of one id count once, by their least scores
    sure = sure.groupBy("doc_id").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"))
    sure = sure.join(marks, "doc_id", "left_anti")
    if handed is not None:
        sure = sure.join(F.broadcast(handed), "doc_id", "left_anti")
    sure = scratch.written(sure, "surest")
    chosen = []
    for view in (0, 1):
        p, tie = F.col(f"p{view}"), [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
        for y, rows in ((0, sure.where(p <= 1 - SURE).orderBy(p, *tie)), (1, sure.where(p >= SURE).orderBy(p.desc(), *tie))):
            chosen.append(rows.limit(HANDED).select("doc_id", F.lit(y).alias("y"), F.lit(1 - view).alias("to")))
    return scratch.written(chosen[0].union(chosen[1]).union(chosen[2]).union(chosen[3]), "handed")


def train(docs: DataFrame, labels: DataFrame, seed: int = 2) -> Model | None:
    """Fits on a bounded sample of the labels and co-trains on all other documents; None if the
    labelled rows that have a document lack a class. The driver holds features of LABELLED
    documents and of 4 * HANDED more for each round at most."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("quality").cast("int").alias("y"))
    wanted = marks.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(LABELLED)
    y, known = _features(own, wanted)
    test = np.arange(len(y)) % CALIBRATE == 0
    if len(np.unique(y[~test])) < 2 or len(np.unique(y[test])) < 2:
        return None
    views = [Fitted(rows.size) for rows in known]
    for view, rows in zip(views, known, strict=True):
        view.add(rows, y, ~test)
        view.fit()
    handed = None
    for _ in range(ROUNDS):
        chosen = _surest(own, marks, handed, [v.w for v in views], seed)
        for k, view in enumerate(views):
            more, rows = _features(own, chosen.where(F.col("to") == k).select("doc_id", "y"))
            view.add(rows[k], more)
            view.fit()
        handed = chosen.select("doc_id") if handed is None else handed.union(chosen.select("doc_id"))
    z = np.column_stack([rows.dot(v.w)[test] for v, rows in zip(views, known, strict=True)])
    return Model([v.w for v in views], z, y[test])


def classify(docs: DataFrame, labels: DataFrame, seed: int = 2) -> DataFrame:
    """Adds text_score, meta_score and score, the probabilities of quality 1, and keep.

    Null texts are empty; very long ones are worked on alone. Without labels of both classes every
    score is null and every row is kept. Rows alike in text, lang and source get the same scores;
    rows of one id are scored each by itself, and one of them trains. Columns of these names are
    replaced, others stay as they are. An empty table gives no rows."""
    docs = scratch.in_small_batches(docs.drop("text_score", "meta_score", "score", "keep"))
    model = train(docs, labels, seed)
    if model is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")]
        return docs.select("*", *none, F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["text_score", "meta_score", "score"]
    to = docs.select("*", *[F.lit(0.0).alias(c) for c in names], F.lit(True).alias("keep")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                made = shared.value.scores(views_of(part))
                arrays = [*part.columns, *map(pa.array, made), pa.array(made[2] >= shared.value.least)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *names, "keep"])

    return docs.mapInArrow(run, to)


def op2_co_training(spark, sf_dir: str) -> DataFrame:
    """All documents, fitted on labels.quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "keep")
