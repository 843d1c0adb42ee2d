"""Operators by themselves: rules, round trips, damage, extra columns."""

import glob
import gzip
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import bpe, embeddings, fingerprints, graph, mixing, ngram_join, quality, scratch, sharding, substrings, warc

from .conftest import SMALL, rows_of, text


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 100, 1000, 4097):
        x = sharding.permute(range(n), n, 5)
        assert sorted(x) == list(range(n))
        assert list(sharding.permute(x, n, 5, inverse=True)) == list(range(n))
    assert sharding.row_at(*sharding.locate(123, 1000, 8, 3), 1000, 8, 3) == 123


def test_chunks_shift():
    a = text(3, 2000)
    one, two = fingerprints.digest_sets(pa.array([a, "inserted words " + a]))
    assert fingerprints.containment(one, two) > 0.95
    row, start, end = fingerprints.chunks(np.frombuffer(a.encode(), np.uint8), np.array([0, len(a)]))
    assert start[0] == 0 and end[-1] == len(a) and (start[1:] == end[:-1]).all()
    assert ((end - start)[:-1] >= fingerprints.LEAST).all() and (end - start <= fingerprints.MOST).all()


def test_extra_columns_stay(spark, edge):
    docs = docs_of(spark, edge)
    n = docs.count()
    for made in (fingerprints.fingerprints(docs, "text", "made"), bpe.encode(docs, "text", _ranks(), _pattern(), "made"), quality.classify(docs, spark.read.parquet(f"{edge}/labels.parquet")), substrings.remove_repeats(docs), sharding.shard_rows(docs, "doc_id", ["text"], 4)):
        assert set(docs.columns) <= set(made.columns) and len(set(made.columns)) == len(made.columns)
        assert Counter(r._h for r in made.select("_h").collect()) == Counter(r._h for r in docs.select("_h").collect())
        assert made.count() == n
    assert mixing.mixed_documents(docs).columns == docs.columns and ngram_join.similar_documents(docs).count() == n


def _ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(2000)) and h.get(b"none") == -1 and sorted(h.ids) == list(range(2000))
    assert bpe.PerfectHash([]).get(b"x") == -1


def test_salvage():
    parts = [gzip.compress(warc.record(i, f"http://x/{i}", f"body {i}".encode() * 30, None), mtime=0) for i in range(5)]
    whole = b"".join(parts)
    assert [k for k, *_ in warc.salvage(whole)] == ["record"] * 5
    at = len(parts[0]) + len(parts[1]) + 30
    bad = whole[:at] + bytes(b ^ 0x5A for b in whole[at : at + 20]) + whole[at + 20 :]
    got = list(warc.salvage(bad))
    assert [x[0] for x in got] == ["record", "record", "gap", "record", "record"]
    assert got[0][1] == 0 and got[-1][2] == len(bad) and all(a[2] == b[1] for a, b in zip(got, got[1:]))
    plain = b"".join(warc.record(i, None, b"p", None) for i in range(3))
    cut = plain[:-7]
    assert [x[0] for x in warc.salvage(cut)] == ["record", "record", "gap"]
    assert [x[0] for x in warc.salvage(b"junk" + plain)] == ["gap", "record", "record", "record"]
    assert list(warc.salvage(b"")) == []
    assert zlib.decompress(parts[0], 31).startswith(b"WARC/1.1")


def test_salvage_is_linear():
    """Twice the damage, twice the time at most, and some noise."""
    import time

    def took(n: int) -> float:
        data = b"WARC/1.1\r\nno colon\r\n" * n + b"\x1f\x8b\x08 no member " * n
        began = time.perf_counter()
        assert [x[0] for x in warc.salvage(data)] == ["gap"]
        return time.perf_counter() - began

    took(1000)
    assert min(took(8000) for _ in range(3)) < 3.5 * min(took(4000) for _ in range(3)) + 0.05


def test_archives_of_dead_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "x" * 3_000_000)], "page_id long, url string, html string")
    made = warc.archived(pages, f"file://{tmp_path}")
    (tmp_path / "part-000000-999-00000.warc.gz").write_bytes(gzip.compress(warc.record(9, "u", b"dead", None)))
    got = warc.read_written(made).where("kind = 'record'").select("record_id", "payload_bytes", "record_type").collect()
    assert sorted(map(tuple, got)) == [("urn:x-page:1", 1, "response"), ("urn:x-page:2", 1, "revisit"), ("urn:x-page:3", 3_000_000, "response")]
    assert warc.read_archives(spark, f"file://{tmp_path}").where("kind = 'record'").count() == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 200), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in graph.components(df, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 50, 50: 50, 200: 50}
    assert graph.components(df.limit(0), "a", "b").collect() == []
    parts = graph.components(df.where("a % 3 <> 0"), "a", "b")
    assert {r.id: r.component for r in graph.merged(parts, df.where("a % 3 = 0"), "a", "b").collect()} == got


def test_components_of_random_graphs(spark):
    from .test_contracts import components

    rng = np.random.default_rng(4)
    for n, m in ((60, 40), (60, 70), (200, 150)):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
        want = components({i for e in edges for i in e}, edges)
        df = spark.createDataFrame(edges, "a long, b long")
        assert {r.id: r.component for r in graph.components(df, "a", "b").collect()} == want


def test_targets():
    assert mixing.targets([10, 100, 100], [1, 2, 3], 210, 3) == [30.0, 72.0, 108.0]
    assert mixing.targets([], [], 0, 3) == []
    assert mixing.targets([0, 5], [1, 1], 5, 3) == [0.0, 5.0]


def test_mixed_documents_take_what_op6_says(spark):
    docs = docs_of(spark, SMALL)
    plan = mixing.mix_sources(mixing.with_keys(docs, 6).select("doc_id", "source", "_size", "_key"), "source", "_size", "_key", [1, 2, 3])
    want = {r.doc_id: r.taken for r in plan.collect() if r.taken}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(got) == want


def test_substrings(spark):
    line = "This whole line of text repeats in other documents word for word."
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    own = [f"Own text number {i} says something else entirely here." for i in range(6)]
    rows = [(1, f"{own[0]}\n{line}\n{passage}"), (2, f"{own[1]}\n{line.upper()}\n{own[2]}"), (3, f"{own[3]} {passage[0].upper() + passage[1:]} {own[4]}"), (4, line + "\n" + line), (5, None), (6, ""), (7, own[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert got[1].text == rows[0][1] and got[5].text is None and got[6].text == "" and got[7].text == own[5]
    assert line.upper() not in got[2].text and own[1] in got[2].text and own[2] in got[2].text
    assert "word7 word8" not in got[3].text and own[3] in got[3].text and own[4] in got[3].text
    for i, t in rows:
        if t:
            kept = list(t)
            for s in got[i].removed:
                kept[s.start : s.end] = [""] * (s.end - s.start)
            assert "".join(kept) == got[i].text


def test_substrings_passages_from_mid_sentence(spark):
    """Passages of over 50 words, none ending or beginning with a sentence, in any letter case and script."""
    short = " ".join(f"stück{i} Haus{i} im Wald{i} steht Still{i}{'.' if i % 3 == 2 else ''}" for i in range(14))
    one = " ".join(f"lang{i}" for i in range(60))
    two = " ".join(f"слово{i}" for i in range(26)) + ". " + " ".join(f"Слово{i}" for i in range(26))
    tiny = " ".join(f"No{i} so{i}." for i in range(30))
    far = " ".join(f"far{i}" for i in range(400))
    passages = [short, one, two, tiny, far]
    rows = [(k, f"Own beginning of {k} a {p} and own end of it {k}.\nOther line {k}.") for k, p in enumerate(passages)]
    rows += [(100 + k, f"Quite another start{k} with {p} then something else{k} follows.\nLast words{k} stay here.") for k, p in enumerate(passages)]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(len(passages)):
        assert got[k].text == rows[k][1]
        assert got[100 + k].text == f"Quite another start{k} with then something else{k} follows.\nLast words{k} stay here."


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality.classify(docs_of(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r.doc_id: r for r in scored.select("doc_id", "score", "keep").collect()}
    labels = [(got[r["doc_id"]], r["quality"]) for r in rows_of(folder, "labels") if r["doc_id"] in got]
    good = [g for g, q in labels if q == 1]
    bad = [g for g, q in labels if q == 0]
    assert np.mean([g.keep for g in good]) > 0.97 and np.mean([g.score for g in good]) > np.mean([g.score for g in bad]) + 0.3


def test_quality_rejects_bad(spark):
    """Most bad documents go, by labels that neither fitting nor calibration has seen."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    scored = quality.classify(docs_of(spark, folder), labels.where(~unseen))
    rows = scored.join(labels.where(unseen).select("doc_id", "quality"), "doc_id").select("quality", "keep").collect()
    share = {q: np.mean([r.keep for r in rows if r.quality == q]) for q in (0, 1)}
    print("unseen labels", Counter(r.quality for r in rows), "kept shares", share)
    assert share[0] < 0.1 and share[1] > 0.97


def test_quality_without_labels(spark, edge):
    docs = docs_of(spark, edge)
    none = spark.read.parquet(f"{edge}/labels.parquet").limit(0)
    out = quality.classify(docs, none)
    assert out.where("keep and score is null").count() == docs.count()


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = embeddings.rotation(64, 3)
    got, bound = embeddings.estimate(*embeddings.encode(x, turn), x, turn)
    error = got - x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.01 and (np.abs(error) <= bound[:, None])[off].mean() > 0.999


def test_rounding_stays_within_its_bound():
    """Eight bits a component: what they take from an estimate is less than the bound says; keys
    come out alike for any part of the rows."""
    rng = np.random.default_rng(2)
    for d in (1, 2, 64, 300):
        x = rng.standard_normal((200, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turned = x @ embeddings.rotation(d, 3).T
        codes, factors = embeddings.encode(x, embeddings.rotation(d, 3))
        small, step = embeddings.rounded(turned)
        apart = np.abs(embeddings.compared(codes, factors, small * step[:, None])[0] - embeddings.compared(codes, factors, turned)[0])
        assert (apart <= np.sqrt(d) / 2 * step[None, :] / factors[:, None] + 1e-5).all()
        keys = embeddings._keys(small, 10, 7, 5)
        assert (embeddings._keys(small[::3], 10, 7, 5) == keys[::3]).all()


def test_whole_vectors_move_for_suspects_only(spark):
    """No group of a table sees whole vectors, and few vectors are sent again as such."""
    rng = np.random.default_rng(8)
    n, d = 6_000, 96
    x = rng.standard_normal((n, d))
    x[1::500] = x[::500] + rng.standard_normal((n // 500, d)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = set(glob.glob(scratch.folder(spark).removeprefix("file://") + "/suspects-*"))
    got = embeddings.near_duplicates(df, "vec_id", "embedding").where("n_links > 0")
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id").collect()) == [(i + k, 1, i) for i in range(0, n, 500) for k in (0, 1)]
    (made,) = set(glob.glob(scratch.folder(spark).removeprefix("file://") + "/suspects-*")) - before
    sent = spark.read.parquet(made)
    assert sent.columns == ["no", "block", "table", "bucket", "one", "two", "dims"]
    print("suspects", sent.count(), "of", n * embeddings.plan(n, 0.9)[1])
    assert sent.count() < 0.1 * n * embeddings.plan(n, 0.9)[1]


def test_dense_block(spark):
    """More vectors in one bucket than a block holds."""
    rng = np.random.default_rng(5)
    x = np.ones((1500, 8)) + rng.standard_normal((1500, 8)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df, "vec_id", "embedding").agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.count_if("kept")).first()
    assert tuple(got) == (1499, 1499, 0, 1)


def test_join_with_frequent_shingles(spark):
    """Boilerplate that most documents share, and groups of near copies on top of it."""
    common = text(77, 40)
    rows = [(i, f"{common} {text(i // 4, 60)} extra{i % 4}") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, 3, 90).collect()}
    assert got == {i: i // 4 * 4 for i in range(160)}


def _edited(seed: int, words: list[str], edits: int) -> str:
    out, rng = list(words), np.random.default_rng(seed)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"new{rng.integers(10**9)}"
    return " ".join(out)


def test_join_with_a_cloud_of_near_copies(spark):
    """More copies with edits of their own than a bucket may hold components, by brute force."""
    from .test_contracts import components, jaccard_links, shingle_sets

    base = text(5, 150).split()
    rows = [{"doc_id": i, "text": _edited(i, base, 1 + i % 5)} for i in range(300)]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    sets = shingle_sets(rows, 3)
    want = components(list(sets), jaccard_links(sets, 90))
    assert {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, 3, 90).collect()} == want
    assert len(set(want.values())) > ngram_join.CLOUD


def test_join_with_two_clouds_that_share_a_passage(spark):
    """Near copies of two texts with a long passage in common: no pairs across in the square of the clouds."""
    from .test_contracts import components, jaccard_links, shingle_sets

    common = text(50, 60).split()
    rows = [{"doc_id": i, "text": _edited(i, [*text(51 + i % 2, 140).split(), *common], 1)} for i in range(400)]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    made = []
    grow = ngram_join._Join.grow

    def counted(self, pairs, name):
        made.append((name, pairs.count()))
        grow(self, pairs, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join._Join, "grow", counted)
        got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, 3, 90).collect()}
    sets = shingle_sets(rows, 3)
    assert got == components(list(sets), jaccard_links(sets, 90))
    assert sum(n for _, n in made) < 64 * len(rows), made


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 50, 700, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 2**63, 1 + n // 3, dtype=np.uint64)]))
            most = ngram_join.most_shared(ngram_join.sketch(a), ngram_join.sketch(b))
            assert most is None or most >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("held", [500_000, 40, 0])
def test_crowd_pairs_are_complete(spark, monkeypatch, held):
    """Also where tasks hold only some of the crowd's counts, or none; and only heads make rows."""
    from .test_contracts import jaccard_links, shingle_sets

    monkeypatch.setattr(ngram_join, "FREQUENT", held)

    base = text(6, 120).split()
    rows = [{"doc_id": i, "text": _edited(i, base[: 120 - i % 7], i % 4)} for i in range(120)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    crowd = spark.createDataFrame([(i, i) for i in range(120)], "id long, part long")
    for percent in (80, 90):
        got = {tuple(sorted(r)) for r in ngram_join._crowd_pairs(docs, crowd, 3, percent).collect()}
        links = {tuple(sorted(p)) for p in jaccard_links(shingle_sets(rows, 3), percent)}
        assert links and links <= got
        sets = ngram_join._packed_sets(docs, 3)
        often = ngram_join._frequent(ngram_join._crowd_counts(sets), 2)
        assert often.whole == (held == 500_000)
        for r in ngram_join._crowd_heads(sets, often, percent).collect():
            assert len(r.token) == len(r.at) <= ngram_join.allowed(r.n, percent) + 1


def test_pipeline_stages(spark, edge, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for folder in (SMALL, edge):
        docs = docs_of(spark, folder)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, docs = docs, _kept(spark, stage(spark, docs, folder))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
            if k < 3:
                assert docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").where("doc_id is not null").isEmpty()
    assert corpus_pipeline.run(spark, empty).collect() == []


def _kept(spark, df):
    from meterlake.llm import scratch

    return scratch.written(df, "stage")


def test_pipeline_near_duplicates(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    near = [(i, text(i // 3, 300) + f" tail{i % 3}", "en", "a", 1) for i in range(30)]
    docs = spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 30, 3))


def test_very_long_words_teach_the_lattice(spark):
    from meterlake.llm import lattice as L

    entries = [*[bytes([i]) for i in range(256)], b"ab", b"ba"]
    pieces = L.Pieces(entries, np.log(np.full(len(entries), 1 / len(entries))))
    short = b" abab" * 6
    weights = np.stack([pieces.logp, pieces.logp])
    plain, long = np.zeros(weights.shape), np.zeros(weights.shape)
    lattice = L.Lattice(np.frombuffer(short, np.uint8), np.array([0]), len(short), pieces, weights)
    lattice.expected(np.array([[0.25], [0.75]]), plain)
    a = L._forward(short, pieces, weights)
    L._backward(short, pieces, weights, a, np.array([0.25, 0.75]), long)
    assert np.allclose(a[-1], lattice.a[len(short)][:, 0]) and np.allclose(plain, long)
    words = spark.createDataFrame([(1, bytearray(b" " + b"ab" * 1100), 1, 1, 1)], "code long, word binary, c long, n long, c_0 long")
    made = L._learn(words, pieces, 1)
    assert np.exp(made.logp[0, entries.index(b"ab")]) > 0.3


def test_pieces_are_found_by_their_size():
    """Ranges of one size have the hash of any ranges, and give the piece that stands there, also of those
    that meet another in a table."""
    from meterlake.llm import lattice as L
    from meterlake.llm import text as T

    entries = [bytes([b]) for b in range(256)] + [bytes([97 + i % 26, 97 + i // 26 % 26]) * (1 + i % 9) + bytes([97 + i % 7]) for i in range(3000)]
    entries = [*dict.fromkeys(entries)]
    pieces = L.Pieces(entries, np.zeros(len(entries)))
    data = np.frombuffer(b"".join(entries), np.uint8)
    number = {e: i for i, e in enumerate(entries)}
    for size in range(1, 20):
        starts = np.arange(len(data) - size + 1)
        assert (T.run_hashes(T.eights(data), starts, size) == T.word_hashes(data, starts, starts + size, lower=False)).all()
        assert pieces.find(T.eights(data), starts, size).tolist() == [number.get(data[s : s + size].tobytes(), -1) for s in starts]
