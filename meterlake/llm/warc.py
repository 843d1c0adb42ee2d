"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

The reader checks each record (gzip member, version line, headers, length, digests, end). Where a
check fails it looks for the next member or version line that begins a valid record, goes on from
there and reports the bytes in between as a quarantined gap."""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import scratch
from meterlake.llm import text as T

#: An archive is closed once it has this many bytes; one record is never split.
ARCHIVE_BYTES = 32 << 20
#: Record ids are urn:x-page: and the page's id, so that one is computed from the other.
URN = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
END = b"\r\n\r\n"
#: Bytes in which the headers of a record must end.
HEAD_BYTES = 64 << 10


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit with headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers (names in lower case), block and end of the record at a place; ValueError says what is wrong."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise ValueError("no version line")
    top = data.find(END, at, at + HEAD_BYTES)
    if top < 0:
        raise ValueError("headers without an end")
    head = {}
    for line in data[at:top].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        head[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isascii() or not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    if "warc-type" not in head or "warc-record-id" not in head:
        raise ValueError("no type or record id")
    start = top + len(END)
    to = start + int(head["content-length"])
    if data[to : to + len(END)] != END:
        raise ValueError("a length that doesn't lead to the record's end")
    block = data[start:to]
    if head.get("warc-block-digest", "").startswith("sha1:") and head["warc-block-digest"][5:] != digest(block):
        raise ValueError("another block digest")
    if head["warc-type"] == "response" and head.get("warc-payload-digest", "").startswith("sha1:") and head["warc-payload-digest"][5:] != digest(payload(block)):
        raise ValueError("another payload digest")
    return head, block, to + len(END)


def payload(block: bytes) -> bytes:
    """What follows the HTTP headers of a block."""
    return block.partition(END)[2]


def _at(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """The record at a place, compressed as a gzip member of its own or plain."""
    if not data.startswith(GZIP, at):
        return parse(data, at)
    unzip, out, fed, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not unzip.eof and fed < len(data):
            out.append(unzip.decompress(view[fed : fed + 65536]))
            fed = min(len(data), fed + 65536)
    except zlib.error as e:
        raise ValueError(f"a damaged member ({e})") from None
    if not unzip.eof:
        raise ValueError("a member that is cut off")
    whole = b"".join(out)
    head, block, end = parse(whole)
    if end != len(whole):
        raise ValueError("a member with more than one record")
    return head, block, fed - len(unzip.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict, bytes]]:
    """("record", start, end, None, headers, block) of each valid record and ("gap", start, end,
    reason, {}, b"") of the bytes between, in order; together they cover the archive."""
    at, bad, why = 0, -1, ""
    next_mark = {GZIP: -1, VERSION: -1}  # the next place of each, looked up again once it is passed
    while at < len(data):
        try:
            head, block, end = _at(data, at)
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            for mark, place in next_mark.items():
                if place <= at:
                    place = data.find(mark, at + 1)
                    next_mark[mark] = place if place >= 0 else len(data)
            at = min(next_mark.values())
            continue
        if bad >= 0:
            yield "gap", bad, at, why, {}, b""
            bad = -1
        yield "record", at, end, None, head, block
        at = end
    if bad >= 0:
        yield "gap", bad, len(data), why, {}, b""


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes records (page_id, url, payload string or binary, refers_to) as gzip members to
    numbered archives in a folder that all executors reach; null payloads are empty.

    Gives a written table of the archives: path, records, bytes. An archive's name tells the attempt that
    wrote it, so the table names those of finished tasks alone. A payload of any length is one record;
    an empty table gives no archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        made, out, name, count, size = [], None, "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                made.append((f"{folder}/{name}", count, size))
                out = None

        for batch in batches:
            for part in T.slices(batch, "payload"):
                for page, url, body, to in zip(*(part[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if out is None:
                        name, count, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = body.encode() if isinstance(body, str) else body or b""
                    data = zipped.compress(record(page, url, raw, to)) + zipped.flush()
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= limit:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    records = scratch.in_small_batches(records)
    return scratch.written(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


READ = "kind string, archive string, start long, end long, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


SCHEMA = pa.schema([(c, pa.binary() if kind == "binary" else pa.int64() if kind == "long" else pa.string()) for c, kind in (x.split() for x in READ.split(", "))])


def _rows(archive: str, data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The rows of READ of one archive."""
    bare = lambda x: x.strip("<>") if x else None
    for kind, start, end, why, head, block in salvage(data):
        kept, size, code = None, None, None
        if kind == "record":
            body = payload(block)
            told = re.search(rb"(?im)^content-length:\s*(\d+)\r?$", block.partition(END)[0])
            size = len(body) if head["warc-type"] == "response" else int(told[1]) if told else None
            code = head.get("warc-payload-digest", "").removeprefix("sha1:") or digest(body)
            kept = body if with_payload and head["warc-type"] == "response" else None
        ids = [bare(head.get(c)) for c in ("warc-record-id", "warc-refers-to")]
        yield kind, archive, start, end, why, head.get("warc-type"), *ids, head.get("warc-target-uri"), code, size, kept


def _batches(archives: Iterator[tuple[str, bytes]], with_payload: bool) -> Iterator[pa.RecordBatch]:
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
    rows, held = [], 0
    for archive, data in archives:
        for row in _rows(archive, data, with_payload):
            rows.append(row)
            held += len(row[-1] or b"")
            if held >= T.SLICE_BYTES or len(rows) >= 4096:
                yield made(rows)
                rows, held = [], 0
    if rows:
        yield made(rows)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all *.warc and *.warc.gz files in a folder, each below 2 GB.

    payload_bytes and payload_digest are of the full payload also where the record is a revisit,
    whose block has none; payload is null there, and everywhere unless with_payload. An empty file
    has neither records nor gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((a.as_py(), c.as_py()) for batch in batches for a, c in zip(batch["path"], batch["content"], strict=True))
        return _batches(pairs, with_payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return files.select("path", "content").mapInArrow(run, READ)


def read_written(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """As read_archives, of the archives that write_archives gave and of no others: each task opens its
    own, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for path in batch["path"].to_pylist():
                    store, place = pafs.FileSystem.from_uri(path)
                    with store.open_input_file(place) as f:
                        yield path, f.read()

        return _batches(opened(), with_payload)

    paths = manifest.select("path")
    return paths.repartition(scratch.partitions(manifest.sparkSession)).mapInArrow(run, READ)


def page_of(record_id) -> F.Column:
    """The page id in a record id; null where there is none."""
    return F.expr(f"try_cast(substring({record_id}, {len(URN) + 1}) as bigint)")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id and refers_to of the pages whose payload, of least bytes or more, an earlier page has.

    Payloads are counted by digest, with partial sums before the shuffle; only digests that
    occur twice or more are joined back. Pages without an id are never revisits."""
    text = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.where("page_id is not null").where(F.octet_length(text) >= least).select("page_id", F.sha1(text).alias("sha1"))
    own = scratch.written(own, "warc-digests")
    first = own.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(first, "sha1").where("page_id > refers_to").select("page_id", "refers_to").distinct()


def archived(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record for each page (page_id, url, html) and gives the table of the archives.

    An id that occurs in several rows: each row is a record; all rows of the smallest id are responses."""
    pages = pages.select("page_id", "url", "html")
    again = revisits(pages, least).withColumnRenamed("page_id", "_id")
    rows = pages.join(again, pages.page_id == again._id, "left")
    small = F.octet_length(F.coalesce("html", F.lit(""))) < least
    return write_archives(rows.select("page_id", "url", F.col("html").alias("payload"), F.when(~small, F.col("refers_to")).alias("refers_to")), folder)


def op4_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    folder = scratch.new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = read_written(archived(pages, folder), with_payload=False).where("kind = 'record'")
    page, to = page_of("record_id").alias("page_id"), page_of("refers_to").alias("refers_to")
    return found.select(page, "payload_bytes", "payload_digest", "record_type", to)


ORACLE_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS least, sha1(h) AS x FROM p GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + CAST(i // 4 AS INTEGER) * 5, 5) AS INTEGER) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM p JOIN f USING (h)
"""
