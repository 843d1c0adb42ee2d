"""Lexical search, nearest neighbours and fill-in-middle against brute force and round trips."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meterlake.llm import infill, lexical, neighbours
from meterlake.llm.queries import QUERIES

from .conftest import SMALL, rows_of
from .test_contracts import folder, query  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(docs, items, k):
    """(item, [(score, doc)]) by scoring every document."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, t in items:
        wanted = Counter(terms(t))
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in wanted}
        scored = []
        for doc, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(q * weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in wanted.items() if w in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        if scored:
            out[item] = [(-s, d) for s, _, _, d in sorted(scored)[:k]]
    return out


def least_texts(rows):
    by = defaultdict(list)
    for r in rows:
        if r["item_id"] is not None and r["text"] is not None:
            by[r["item_id"]].append(r["text"].encode())
    return [(i, min(t).decode()) for i, t in by.items()]


def test_op11(spark, folder):  # noqa: F811
    docs = [(r["doc_id"], r["text"]) for r in rows_of(folder, "documents")]
    want = ranked(docs, least_texts(rows_of(folder, "benchmark")), 20)
    got = defaultdict(list)
    for r in query(spark, 11, folder):
        got[r.item_id].append((r.rank, r.score, r.doc_id))
    assert {i: [(s, d) for _, s, d in sorted(v)] for i, v in got.items()} == want
    assert all(sorted(x[0] for x in v) == list(range(1, len(v) + 1)) for v in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_maxscore_shards(spark, monkeypatch, seed):
    """Many small shards and blocks, ties, and repeats of whole documents."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(i, " ".join(rng.sample(words, rng.choice([1, 3, 9, 40])))) for i in range(400)] + [(400 + i, "w1 w2 w3") for i in range(60)]
    items = [(i, " ".join(rng.sample(words, rng.choice([1, 2, 12, 30])))) for i in range(30)]
    for name, value in (("SHARD", 17), ("BLOCK_ITEMS", 11)):
        monkeypatch.setattr(lexical, name, value)
    made = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=7)
    got = defaultdict(list)
    for r in made.orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.score, r.doc_id))
    assert got == ranked(docs, items, 7)


def test_maxscore_probes_less():
    """Non-essential lists alone make no document a candidate."""
    n, rare = 1000, 500
    packed = lambda x, kind: np.array(x, kind).tobytes()
    docs = [[0, 1] if i == rare else [0] for i in range(n)]
    shard = lexical._Shard(np.arange(n), np.full(n, 10), [packed(d, "<i4") for d in docs], [packed([1] * len(d), "<i8") for d in docs], n, 10 * n)
    places, scores = shard.best({0: 1, 1: 5000}, int(shard.highest[0]) + 1)
    assert places.tolist() == [rare] and not shard.scores.any()
    assert scores[0] == 5001 * shard.highest[0]


def nearest_of(rows, k, asked):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    sizes = Counter(len(v) for _, v in good)
    d = min(sizes, key=lambda s: (-sizes[s], s))
    good = [(i, v) for i, v in good if len(v) == d]
    return {q: sorted((-float((v * x).sum()), i) for i, x in good if i != q)[:k] for q, v in good if asked(q)}


def test_op12(spark, folder):  # noqa: F811
    rows = [(r["vec_id"], r["embedding"]) for r in rows_of(folder, "embeddings")]
    want = nearest_of(rows, 20, lambda q: q % 20 == 0)
    got = defaultdict(list)
    for r in query(spark, 12, folder):
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in got.items():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(want[q]) + 1))
        assert [x[1:] for x in v] == sorted(x[1:] for x in v) and len({x[2] for x in v}) == len(v)
        if folder != SMALL:
            assert [x[1:] for x in v] == want[q]
    found = sum(len({x[2] for x in got[q]} & {i for _, i in want[q]}) for q in got)
    assert found >= 0.95 * sum(map(len, want.values()))


def test_op12_recall(spark):
    """Clusters, copies beyond k, different norms: recall, exact scores, ties by id."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 48)) * rng.uniform(0.5, 1.5, (4000, 1))
    x[:1200] = x[0] + rng.standard_normal((1200, 48)) * 0.05
    x[1200:1290] = x[1200]
    x = np.round(x, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in neighbours.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    found = 0
    for q in range(0, 4000, 20):
        scores = (x[q] * x).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(4000), -scores)).tolist() if i != q][:20]
        v = sorted(got[q])
        assert [r for r, _, _ in v] == list(range(1, 21)) and all(scores[i] == -s for _, s, i in v)
        assert [y[1:] for y in v] == sorted(y[1:] for y in v)
        found += len({y[2] for y in v} & set(want))
    assert found / 4000 >= 0.95


def test_scan_abandons():
    """Most candidates are abandoned before their last block, and near ones are not."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50] + 0.02 * rng.standard_normal((50, 128))
    limit = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * 0.8
    turn = neighbours.rotation(128, 1)
    i, j = neighbours.survivors(q @ turn.T, x @ turn.T, limit, neighbours.shares(128))
    assert {(k, k) for k in range(50)} <= set(zip(i.tolist(), j.tolist())) and len(i) < 0.05 * 50 * 2000


def test_shares_are_quantiles():
    d = 64
    v = np.random.default_rng(9).standard_normal((50_000, d))
    part = np.cumsum(v**2, axis=1) / (v**2).sum(axis=1, keepdims=True)
    for _, end, limit in neighbours.shares(d)[:-1]:
        assert 0.0002 < (part[:, end - 1] > limit).mean() < 0.003


def infilled(doc_id, t):
    t = t or ""
    u = UNIT.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, out = "plain", t
    elif h4 % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    plain = form == "plain"
    return (doc_id, len(u), form, None if plain else len(p), None if plain else len(m), out)


def test_op13(spark, folder):  # noqa: F811
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in rows_of(folder, "documents"):
        *row, out = infilled(r["doc_id"], r["text"])
        want[(*row, sha(out), sha(r["text"] or ""))] += 1
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(tuple(r[c] for c in names) for r in query(spark, 13, folder)) == want


def test_infill_odd_texts(spark):
    """Marks and parts of marks in texts, spaces at ends, several bytes a code point; other columns stay."""
    rng = random.Random(5)
    bits = ["<", "P>", "<S", "<M>", "a", "é文", " ", "\n\t", "😀", "<P> "]
    texts = ["".join(rng.choices(bits, [9, 3, 3, 0.05, 9, 5, 9, 3, 2, 0.05], k=rng.randrange(0, 400))) for _ in range(300)]
    rows = [(i, t, f"n{i}", f"c{i}") for i, t in enumerate(texts)]
    made = infill.transformed(spark.createDataFrame(rows, "doc_id long, text string, n string, _cut string"), "doc_id", "text", rate=50)
    assert made.columns == ["doc_id", "text", "_cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in made.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect():
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == infilled(r.doc_id, texts[r.doc_id])
        assert r.again == r.text == texts[r.doc_id] and r["_cut"] == f"c{r.doc_id}"


@pytest.mark.parametrize(("every", "window"), [(1, 7), (3, 64), (64, 1 << 20)])
def test_checkpoints(every, window):
    """Every cut of every text, with checkpoints and windows of any size."""
    rng = random.Random(every)
    texts = ["".join(rng.choices(["a", "é文", " ", "\n", "bc"], k=rng.randrange(0, 60))) for _ in range(40)] + ["", "  ", "x"]
    data, offsets = infill.T.utf8(pa.array(texts))
    index, raw = infill.checkpoints(data, offsets, every, window), data.tobytes()
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        assert index.first_unit[i + 1] - index.first_unit[i] == len(units)
        for u in range(len(units) + 1):
            to, chars = infill.place_of(index, raw, int(offsets[i + 1]), int(index.first_unit[i]) + u)
            before = "".join(units[:u])
            assert (to - offsets[i], chars - index.first_char[i]) == (len(before.encode()), len(before))


def test_empty_and_unasked(spark, empty):
    assert all(query(spark, n, empty) == [] for n in (11, 12, 13))
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for where in ("vec_id = 5", "vec_id = 1"):
        assert neighbours.search(rows, "vec_id", "embedding", F.expr(where)).collect() == []
    assert {f"op{n}" for n in (11, 12, 13)} <= {k.split("_")[0] for k in QUERIES}
    assert pq.read_table(f"{SMALL}/benchmark.parquet").num_rows
