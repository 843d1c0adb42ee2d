import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in old green trees near our quiet river bank".split()


def text(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x % 37))
    return " ".join(out)


def edge_documents() -> pd.DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    base = text(1, 120)
    near = base.replace("fox", "cat", 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", "a"), (4, None, None, None), (5, "", "en", "a"), (6, "  \n\t ", "de", "c"), (7, "one", "en", "a"), (8, "one two", "en", "a"),
        (9, text(9, 30_000), "en", "a"), (10, base + " tail", None, "b"), (None, base, "en", "a"), (None, None, None, None), (11, "Ünïcode 文本 😀 " * 40, "zh", "c"), (12, text(12, 60), "en", None), (13, text(13, 60), "en", None),
        (13, text(13, 60), "en", None), (14, "ONE TWO", "en", "a"), (15, "x" * 5000, "en", "c"),
    ]
    d = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    d["n_chars"] = d["text"].map(lambda t: None if t is None else len(t))
    for k, c in enumerate(("_h", "_rank", "row", "ids", "score", "_part", "_row", "fingerprint", "shard", "size", "_key")):
        d[c] = [f"{c}{i + k}" for i in range(len(d))]
    return d


def write(path, frame: pd.DataFrame, kinds: dict) -> None:
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in frame.columns])
    pq.write_table(pa.Table.from_pandas(frame.astype(object).where(frame.notna(), None), schema, preserve_index=False), path)


LONGS = {c: pa.int64() for c in ("doc_id", "n_chars", "page_id", "vec_id", "item_id")} | {"quality": pa.int32(), "toxic": pa.int32()}


def tables(folder, documents: pd.DataFrame) -> str:
    write(folder / "documents.parquet", documents, LONGS)
    labels = pd.DataFrame([(i, i % 2, 0) for i in range(1, 16)] + [(None, 1, 0), (3, None, None), (999, 1, 0)], columns=["doc_id", "quality", "toxic"])
    write(folder / "labels.parquet", labels, LONGS)
    pages = pd.DataFrame([(1, "http://a/ b", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "u", "other"), (5, "u", "<p>é"), (None, "u", "<p>é"), (7, "u", "WARC/1.1\r\n\r\n" * 50), (8, "u", "<p>long</p> " * 250_000), (9, "u", "<p>long</p> " * 250_000)], columns=["page_id", "url", "html"])
    for c in ("payload", "digest", "payload_digest", "record_type", "refers_to", "first", "offset", "path", "part"):
        pages[c] = [f"{c}{i}" for i in range(len(pages))]
    write(folder / "pages.parquet", pages, LONGS)
    vectors = [[1.0, 0.0], [1.0, 0.01], [2.0, 0.0], None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 1.0], [1.0], []]
    vectors = [*vectors[:-1], [0.5] * 1_500, vectors[0], vectors[-1]]
    ids = [*range(len(vectors) - 2), 20, None]
    extra = {c: pa.array([f"{c}{i}" for i in range(len(vectors))]) for c in ("id", "sum", "list", "part", "score", "rank", "units", "code")}
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array([0] * len(vectors), pa.int32())} | extra), folder / "embeddings.parquet")
    items = [(1, text(1, 8)), (2, "one TWO two"), (3, None), (4, ""), (5, " ;;\x7f"), (6, "文本 Ünïcode, unknownword"), (7, "one"), (7, "birds"), (None, "one"), (8, text(9, 3000)), (9, "one"), (9, "one")]
    benchmark = pd.DataFrame(items, columns=["item_id", "text"])
    for c in ("doc_id", "n", "terms", "score", "rank"):
        benchmark[c] = [f"{c}{i}" for i in range(len(benchmark))]
    write(folder / "benchmark.parquet", benchmark, LONGS | {"doc_id": pa.string()})
    return str(folder)


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("edge"), edge_documents())


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    tables(folder, edge_documents())
    for p in folder.iterdir():
        pq.write_table(pq.read_table(p).slice(0, 0), p)
    return str(folder)


def rows_of(folder: str, table: str) -> list[dict]:
    return pq.read_table(f"{folder}/{table}.parquet").to_pylist()
