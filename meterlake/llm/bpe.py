"""Byte-level BPE encoding and decoding over a two-tier lookup.

A minimal perfect hash maps each pre-token that is a vocabulary entry to its id at once. A
pre-token that is none is merged from its bytes, which are linked, by a heap of ranked pairs."""

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import scratch
from meterlake.llm import text as T

#: Pre-tokens, and bytes of them, that a worker remembers in each of two generations: when the young
#: one is full it becomes the old one, and what is met again comes back from there.
MEMO, MEMO_BYTES = 100_000, 8 << 20
_M = 2**64 - 1


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    found = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in found] != list(range(len(found))):
        raise ValueError(f"{path}: ranks must be 0 to n - 1, each once")
    return [token for _, token in found]


def _place(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _M
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash by displacement: n keys in n slots, one probe, and a check of the key.

    Keys fall in buckets; from the largest down, each bucket gets the first displacement that
    sends its keys to free slots. A bucket of one key names its slot itself, as -1 - slot."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.shift, self.ids, self.keys = np.zeros(self.buckets, np.int64), np.full(n, -1, np.int32), [b""] * n
        free, nxt = set(range(n)), 0
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) > 1:
                d = 0
                while True:
                    slots = {_place(h, d, n) for h, _ in members}
                    if len(slots) == len(members) and slots <= free:
                        break
                    d += 1
                at = [_place(h, d, n) for h, _ in members]
            else:
                while nxt not in free:
                    nxt += 1
                d, at = -1 - nxt, [nxt]
            self.shift[b] = d
            free.difference_update(at)
            for slot, (_, i) in zip(at, members, strict=True):
                self.ids[slot], self.keys[slot] = i, keys[i]
        self.shift, self.ids = self.shift.tolist(), self.ids.tolist()

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -1 - d if d < 0 else _place(h, d, self.n)
        return self.ids[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of the least rank, leftmost among equals, is joined until
    no pair has a rank. Links lead from each part's first byte to its neighbours' first bytes."""
    n, get, push, pop = len(piece), ranks.get, heapq.heappush, heapq.heappop
    nxt, before = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = pop(heap)
        j = nxt[i]
        if j < 0 or j >= n or nxt[j] != end:  # either part has been joined to another meanwhile
            continue
        nxt[i], nxt[j] = end, -1
        if end < n:
            before[end] = i
            if (r := get(piece[i : nxt[end]])) is not None:
                push(heap, (r, i, nxt[end]))
        p = before[i]
        if p >= 0 and (r := get(piece[p:end])) is not None:
            push(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return out


class Encoder(dict):
    """From a pre-token to its ids, packed as unsigned 32-bit integers in the machine's order, which
    must be little-endian. A byte that is no entry is a KeyError."""

    def __init__(self, entries: list[bytes], pattern: str):
        super().__init__()
        self.hash, self.find = PerfectHash(entries), regex.compile(pattern).findall
        self.ranks = {entry: i for i, entry in enumerate(entries)}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, token: str) -> bytes:
        packed = self.old.get(token)
        if packed is None:
            raw = token.encode()
            i = self.hash.get(raw)
            packed = array("I", [i] if i >= 0 else merge(raw, self.ranks)).tobytes()
        if len(self) >= MEMO or self.bytes > MEMO_BYTES:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[token] = packed
        self.bytes += len(token)
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


_made: dict[tuple, object] = {}


def _once(key: tuple, make: Callable[[], object]):
    """One encoder or table for each worker process, whatever the number of its tasks."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _with_columns(df: DataFrame, column: str, names: list[str], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Adds binary columns made from another one, slice by slice; those of these names are replaced."""
    df = scratch.in_small_batches(df.drop(*names))
    to = df.select("*", *[F.lit(b"").alias(c) for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in T.slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part[column])], names=[*part.schema.names, *names])

    return df.mapInArrow(run, to)


def _encoder(ranks: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    encoder = _once((ranks, pattern), lambda: Encoder(read_ranks(ranks), pattern))
    return lambda texts: pa.array([encoder.encode(t) if t else b"" for t in texts.to_pylist()], pa.binary())


def _decoder(ranks: str) -> Callable[[pa.Array], pa.Array]:
    entry = _once((ranks,), lambda: read_ranks(ranks)).__getitem__

    def bytes_of(ids: pa.Scalar) -> bytes:
        return b"".join(map(entry, np.frombuffer(ids.as_buffer(), "<u4").tolist())) if ids.is_valid else b""

    return lambda ids: pa.array(map(bytes_of, ids), pa.binary())


def encode(df: DataFrame, text: str, ranks: str, pattern: str, name: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as packed little-endian unsigned 32-bit integers.

    ranks is the path of a rank file on every executor. No special tokens. A null or empty text
    has no ids; a very long one is worked on alone. Repeated rows get the same ids each, an empty
    table gives no rows. A column of that name is replaced, the others stay."""

    def make():
        encoded = _encoder(ranks, pattern)
        return lambda column: [encoded(column)]

    return _with_columns(df, text, [name], make)


def decode(df: DataFrame, ids: str, ranks: str, name: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for; null and empty give no bytes, repeated rows the
    same each, an empty table no rows. An id that is no rank is an IndexError."""

    def make():
        decoded = _decoder(ranks)
        return lambda column: [decoded(column)]

    return _with_columns(df, ids, [name], make)


def round_trip(df: DataFrame, text: str, ranks: str, pattern: str, name: str = "ids", back: str = "decoded") -> DataFrame:
    """encode, and decode of what it gives, in one pass: a task runs one worker, not two."""

    def make():
        encoded, decoded = _encoder(ranks, pattern), _decoder(ranks)

        def both(column: pa.Array) -> list[pa.Array]:
            ids = encoded(column)
            return [ids, decoded(ids)]

        return both

    return _with_columns(df, text, [name, back], make)


def encoded_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    both = round_trip(docs.select("doc_id", "text"), "text", ranks, pattern)
    n = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents by the 50k byte-level vocabulary."""
    import public_tokenizers

    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
