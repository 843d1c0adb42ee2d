"""Lines of append-only logs with the byte offset of each."""

import fnmatch
import hashlib
import os
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from meterlake.session import stored

if TYPE_CHECKING:  # the process that watches a stream's folder needs neither
    import pandas as pd
    import pyarrow as pa

SCHEMA = "op string, path string, generation long, byte_offset long, line binary"
#: Bytes of a file that one task reads; a line belongs to the task in whose range it begins.
RANGE = 64 << 20
#: Files that one task of the data source reads at most.
PACKED = 1000
#: Bytes at the beginning and before the checkpoint that tell whether a file was written anew.
EDGE = 4096


def files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, content and modified_ms of files below a folder, one row a file; for files of up to some
    hundred MB. A folder that isn't there holds none. Tasks list and read them."""
    top = _url(folder)

    def contents(batches: "Iterator[pa.RecordBatch]") -> "Iterator[pa.RecordBatch]":
        import pyarrow as pa

        store, _ = _open(top)

        def made(rows: list[tuple]) -> "pa.RecordBatch":
            kinds = {"path": pa.string(), "content": pa.binary(), "modified_ms": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.values())], names=list(kinds))

        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(r["path"]) as f:
                    rows.append((r["path"], f.read(), r["modified_ms"]))
                held += len(rows[-1][1])
                if held >= 4 << 20 or len(rows) >= 4096:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    listing = found(spark, folder, [""])
    listing = listing.where(F.regexp_extract("path", "[^/]*$", 0).rlike("^" + fnmatch.translate(pattern).replace(r"\Z", r"\z")))
    return _dealt(listing, "size", RANGE, "path").mapInArrow(contents, "path string, content binary, modified_ms long")


def read(spark: SparkSession, folder: str, suffix: str = ".jsonl", tail: bool = False, listing: DataFrame | None = None) -> DataFrame:
    """path, byte_offset and line of files of any size below a folder, as split() gives them: tasks list
    the files and read ranges of their bytes, many short files by one task. listing: those of the files that
    are to be read, as found() gives them, where it is known already."""
    listing = found(spark, folder, [suffix]) if listing is None else listing
    new = listing.where("size > 0").select("path", F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("start"), F.col("size").alias("upto"))
    return _lines_of(new, folder, RANGE, tail).select("path", "byte_offset", "line")


def listed(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """path and modified_ms of the files that read() takes."""
    return found(spark, folder, [suffix]).select("path", "modified_ms")


def split(found: DataFrame, tail: bool = False) -> DataFrame:
    """path, byte_offset and line (binary, without its end and one CR before it).

    Bytes after the last line end are left for the next run, unless tail asks for them."""
    parts = F.split(F.decode("content", "ISO-8859-1"), "\n")
    rows = found.select("path", F.size(parts).alias("_n"), F.posexplode(parts).alias("_i", "_l"))
    own = Window.partitionBy("path").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("byte_offset", F.coalesce(F.sum(F.length("_l") + 1).over(own), F.lit(0)).cast("long"))
    rows = rows.where((F.col("_i") < F.col("_n") - 1) | (F.lit(tail) & (F.length("_l") > 0)))
    return rows.select("path", "byte_offset", F.encode(F.regexp_replace("_l", r"\r\z", ""), "ISO-8859-1").alias("line"))


def texts(lines: DataFrame) -> DataFrame:
    """Adds text, null where the line isn't UTF-8; empty lines go."""
    rows = lines.where(F.octet_length("line") > 0)
    return rows.withColumn("text", F.when(F.is_valid_utf8(F.col("line").cast("string")), F.col("line").cast("string"))).drop("line")


class _Range(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int, op: str = "line"):
        self.path, self.generation, self.start, self.end, self.op = path, generation, start, end, op


class _Pack(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def _url(folder: str) -> str:
    return folder if ":/" in folder else f"file://{os.path.abspath(folder)}"


def _open(folder: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(_url(folder))


def _sizes(folder: str, suffix: str) -> dict[str, int]:
    import pyarrow.fs as pafs

    store, top = _open(folder)
    found = store.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.is_file and f.path.lower().endswith(suffix)}


def _read(store, part: _Range, tail: bool = False) -> Iterator[tuple]:
    """The lines that begin in the range and are complete, and with tail what stands behind the file's
    last line end. Only whole lines are kept in memory."""
    if part.op != "line":
        yield part.op, part.path, part.generation, None, None
        return
    with store.open_input_file(part.path) as f:
        at = part.start
        f.seek(max(0, at - 1))
        rest = b""
        if at > 0:  # a line that began earlier belongs to the range before
            while chunk := f.read(1 << 20):
                cut = chunk.find(b"\n")
                if cut >= 0:
                    at = f.tell() - len(chunk) + cut + 1
                    rest = chunk[cut + 1 :]
                    break
            else:
                return
        *whole, last = rest.split(b"\n")
        held = [last]  # what is read of the line that goes on, joined once
        while at < part.end:
            for line in whole:
                yield "line", part.path, part.generation, at, line.removesuffix(b"\r")
                at += len(line) + 1
                if at >= part.end:
                    return
            if not (chunk := f.read(1 << 20)):
                if tail and (rest := b"".join(held)):
                    yield "line", part.path, part.generation, at, rest.removesuffix(b"\r")
                return
            first, *whole = chunk.split(b"\n")
            held.append(first)
            if whole:
                whole, held = [b"".join(held), *whole[:-1]], whole[-1:]


def _ranges(path: str, generation: int, start: int, end: int, size: int) -> list[_Range]:
    return [_Range(path, generation, a, min(a + size, end)) for a in range(start, end, size)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix, self.range = options["path"], options.get("suffix", ".jsonl"), int(options.get("range", RANGE))
        self.tail = options.get("tail", "false").lower() == "true"

    def partitions(self):
        packs, held = [], 0
        for path, size in sorted(_sizes(self.folder, self.suffix).items()):
            for r in _ranges(path, 0, 0, size, self.range):
                if not packs or held + r.end - r.start > self.range or len(packs[-1]) >= PACKED:
                    packs.append([])
                    held = 0
                packs[-1].append(r)
                held += r.end - r.start
        return [_Pack(p) for p in packs]

    def read(self, partition):
        # without files Spark still asks for one partition, which is None
        store, _ = _open(self.folder)
        return (row for r in (partition.ranges if partition is not None else []) for row in _read(store, r, self.tail))


class _Ticks(DataSourceStreamReader):
    """A row whenever the files below a folder have changed; the offset is a digest of their names, sizes
    and times, of one length however many there are. No file is opened."""

    def __init__(self, options: dict):
        self.folder, self.suffixes = options["path"], options.get("suffix", ".jsonl").split(",")

    def initialOffset(self):
        return {"digest": ""}

    def latestOffset(self):
        # a sum of digests needs no order, so no list of all files
        whole, (store, top) = 0, _open(self.folder)
        for path, size, at in _walk(store, top, self.suffixes):
            whole += int.from_bytes(hashlib.sha256(f"{path}\0{size}\0{at}".encode()).digest())
        return {"digest": f"{whole % 2**256:064x}"}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(end["digest"])]

    def read(self, partition):
        yield (partition.value,)


class LogTicks(DataSource):
    """format("log-ticks"), options path and suffix (several by commas): tells a stream that there is work."""

    @classmethod
    def name(cls) -> str:
        return "log-ticks"

    def schema(self) -> str:
        return "digest string"

    def streamReader(self, schema):
        return _Ticks(self.options)


class LogLines(DataSource):
    """spark.dataSource.register(LogLines); format("log-lines"), options path, suffix, range and tail. For
    files of any size."""

    @classmethod
    def name(cls) -> str:
        return "log-lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)


#: What is known of a file: the generation that is read, the place behind its last whole line, a digest
#: of its edges up to there, and whether it has gone.
FILES = "path string, generation long, upto long, mark string, gone boolean"
#: What a file has come to: lines from start to upto are new in generation; before is the generation that
#: ends, where the file is gone or was written anew.
CHANGES = f"{FILES}, start long, before long, rewritten boolean, error string"
#: Folders of one level from which on tasks list all that is below each.
SPREAD = 64
LISTED = "path string, size long, modified_ms long"


def _entries(store, folder: str, suffixes: list[str]) -> Iterator[tuple[str, int | None, int]]:
    """path, size and time in ns of what a folder holds: files that end so, and folders, without a size. A
    folder that isn't there has none, a link that leads nowhere is none."""
    import pyarrow.fs as pafs

    for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.type == pafs.FileType.Directory:
            yield f.path, None, 0
        elif f.is_file and f.path.lower().endswith(tuple(suffixes)):
            yield f.path, f.size, f.mtime_ns or 0


def _walk(store, top: str, suffixes: list[str]) -> Iterator[tuple[str, int, int]]:
    """path, size and time in ns of the files below top, one folder after the other."""
    open_ = [top]
    while open_:
        for path, size, at in _entries(store, open_.pop(), suffixes):
            if size is None:
                open_.append(path)
            else:
                yield path, size, at


def found(spark: SparkSession, folder: str, suffixes: list[str], keep: "Callable[[str, DataFrame], DataFrame] | None" = None) -> DataFrame:
    """path, size and modified_ms of files below a folder. Tasks list one level after the other, and from
    SPREAD folders on all that is below each; the driver sees a level's number of folders alone. keep: writes
    a table under a name."""
    keep, url = keep or (lambda name, df: stored(df, name)), _url(folder)
    _, top = _open(folder)

    def listing(deep: bool):
        def run(batches: "Iterator[pd.DataFrame]") -> "Iterator[pd.DataFrame]":
            import pandas as pd

            store, _ = _open(url)
            below = _walk if deep else _entries
            for batch in batches:
                rows = []
                for d in batch["path"]:
                    for path, size, at in below(store, d, suffixes):
                        rows.append((path, size, at // 1_000_000))
                        if len(rows) >= 10_000:
                            yield _listed(pd, rows)
                            rows = []
                yield _listed(pd, rows)

        return run

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, n, parts = spark.createDataFrame([(top,)], "path string"), 1, []
    while n:
        deep = n >= SPREAD
        here = keep(f"listing_{len(parts)}", level.repartition(min(n, tasks)).mapInPandas(listing(deep), LISTED))
        parts.append(here.where("size is not null"))
        level = here.where("size is null").select("path")
        n = 0 if deep else level.count()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _listed(pd, rows: list[tuple]) -> "pd.DataFrame":
    return pd.DataFrame(rows, columns=["path", "size", "modified_ms"]).astype({"size": "Int64"})


def _mark(store, path: str, upto: int) -> str:
    """A digest of a file's first and last bytes up to a place."""
    with store.open_input_file(path) as f:
        head = f.read(min(EDGE, upto))
        f.seek(max(0, upto - EDGE))
        return hashlib.sha256(head + f.read(min(EDGE, upto)) + str(upto).encode()).hexdigest()


def _whole(store, path: str, start: int, size: int) -> int:
    """The place behind the last line end up to size, start at least."""
    with store.open_input_file(path) as f:
        end = size
        while end > start:
            begin = max(start, end - (1 << 20))
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return start


def _changed(store, path: str, size: int | None, generation: int | None, upto: int | None, mark: str | None, gone: bool) -> tuple | None:
    """A row of CHANGES, or None where nothing has changed."""
    if size is None:
        return None if gone else (path, generation, 0, None, True, 0, generation, False, None)
    known = generation is not None
    anew = known and not gone and (size < upto or mark != _mark(store, path, upto))
    start = upto if known and not gone and not anew else 0
    end = _whole(store, path, start, size)
    if known and not gone and not anew and end == upto:
        return None
    now = (generation + (1 if anew or gone else 0)) if known else 0
    return (path, now, end, _mark(store, path, end), False, start, generation if anew else None, anew, None)


def compared(listing: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """What has changed of the files since known (FILES), as CHANGES. Tasks open the files at their edges.
    A file that cannot be read is an error, and stays as it was known."""
    names = [c.split()[0] for c in CHANGES.split(", ")]

    def compare(batches: "Iterator[pd.DataFrame]") -> "Iterator[pd.DataFrame]":
        import pandas as pd

        store, _ = _open(folder)
        for batch in batches:
            rows = []
            for path, *rest in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                size, generation, upto = (None if x is None else int(x) for x in rest[:3])
                mark, gone = rest[3:]
                try:
                    row = _changed(store, path, size, generation, upto, mark, bool(gone))
                except OSError as e:
                    row = (path, generation, upto, mark, bool(gone), upto, None, False, str(e))
                if row is not None:
                    rows.append(row)
            made = pd.DataFrame(rows, columns=names)
            for c in ("generation", "upto", "start", "before"):
                made[c] = made[c].astype("Int64")
            yield made

    both = listing.join(known, "path", "full").select("path", "size", "generation", "upto", "mark", "gone")
    return both.mapInPandas(compare, CHANGES)


def new_lines(changes: DataFrame, folder: str, size: int = RANGE) -> DataFrame:
    """path, generation, byte_offset and line of what is new: tasks read ranges of size bytes, so a long
    file is read by many and many short ones by a few."""
    return _lines_of(changes.where("error is null and start < upto"), folder, size)


def _dealt(rows: DataFrame, size: str | Column, task: int, *by: str) -> DataFrame:
    """Rows over as many tasks as their sizes ask for, at least some for each core and at most one a row."""
    much = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    some = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(much.n, some), -(-much.bytes // task)), *by)


def _lines_of(new: DataFrame, folder: str, size: int, tail: bool = False) -> DataFrame:
    """The lines from start to upto of files (path, generation, start, upto)."""
    url = _url(folder)
    ranges = new.select("path", "generation", "upto", F.explode(F.sequence(F.col("start"), F.col("upto") - 1, F.lit(size))).alias("at"))
    ranges = ranges.select("path", "generation", "at", F.least(F.col("at") + size, F.col("upto")).alias("end"))

    def read(batches: "Iterator[pa.RecordBatch]") -> "Iterator[pa.RecordBatch]":
        store, _ = _open(url)
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for _, *row in _read(store, _Range(r["path"], r["generation"], r["at"], r["end"]), tail):
                    rows.append(row)
                    held += len(row[-1])
                    if held >= 4 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return _dealt(ranges, F.col("end") - F.col("at"), size, "path", "at").mapInArrow(read, "path string, generation long, byte_offset long, line binary")


def _batch(rows: list[list]) -> "pa.RecordBatch":
    import pyarrow as pa

    kinds = {"path": pa.string(), "generation": pa.int64(), "byte_offset": pa.int64(), "line": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.values())], names=list(kinds))
