"""Tables in a folder that driver and executors share, changed together and published at once."""

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table with a key: a change rewrites only those that it touches.
BUCKETS = 64
_WHOLE = "all"
#: Commits of rows that a table gathers before it is written as one.
PARTS = 64


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Store:
    """Each commit is a manifest that names the folders of every table; readers take the highest.

    A writer that dies before its manifest is written leaves folders that nobody reads, whatever it
    had written by then; the next commit takes the same number and writes them anew. keep: commits
    whose folders stay, for readers that began before the last."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        import pyarrow.fs as pafs

        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self.files, self.top = pafs.FileSystem.from_uri(self.folder)

    def _names(self, folder: str) -> list[str]:
        import pyarrow.fs as pafs

        return [f.base_name for f in self.files.get_file_info(pafs.FileSelector(f"{self.top}/{folder}", allow_not_found=True))]

    def versions(self) -> list[int]:
        """Numbers of the commits, in order."""
        return sorted(int(name.removesuffix(".json")) for name in self._names("manifests") if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """For each table the folder of each bucket; empty before the first commit."""
        known = self.versions()
        if not known:
            return {}
        with self.files.open_input_stream(f"{self.top}/manifests/{version or known[-1]}.json") as f:
            return json.loads(f.read())

    def read(self, table: str, schema: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The published table, or those of its buckets; empty before its first commit."""
        return self._load(self.manifest().get(table, {}), schema, buckets)

    def _load(self, parts: dict[str, str], schema: str, buckets: Iterable[int] | None) -> DataFrame:
        wanted = parts if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.folder}/{path}" for b, path in sorted(parts.items()) if b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> "Commit":
        return Commit(self)

    def publish(self, table: str, df: DataFrame) -> int:
        """A commit of one whole table."""
        commit = self.begin()
        commit.write(table, df)
        return commit.publish()


class Commit:
    """Tables to be published together: written one after the other, seen by readers all at once."""

    def __init__(self, store: Store):
        self.store, self.parts = store, store.manifest()
        self.version = (store.versions() or [0])[-1] + 1

    def read(self, table: str, schema: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table as it is in this commit so far."""
        return self.store._load(self.parts.get(table, {}), schema, buckets)

    def write(self, table: str, df: DataFrame) -> None:
        """The table is df from now on."""
        path = f"{table}/v{self.version}"
        df.write.mode("overwrite").parquet(f"{self.store.folder}/{path}")
        self.parts[table] = {_WHOLE: path}

    def write_buckets(self, table: str, df: DataFrame, key: str, buckets: Iterable[int]) -> None:
        """df takes the place of the table's rows in these buckets of key; the others stay. A bucket's rows are
        brought together first, as many tasks as its size asks for, or each task would write a file a bucket."""
        path = f"{table}/v{self.version}"
        rows = df.withColumn("_bucket", bucket_of(key))
        rows.hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.store.folder}/{path}")
        made = {name.removeprefix("_bucket=") for name in self.store._names(path) if name.startswith("_bucket=")}
        kept = {b: p for b, p in self.parts.get(table, {}).items() if b not in {str(b) for b in buckets}}
        self.parts[table] = kept | {b: f"{path}/_bucket={b}" for b in made}

    def append(self, table: str, df: DataFrame, schema: str) -> None:
        """df's rows come to the table's; every PARTS commits the table is written as one again."""
        old = self.parts.get(table, {})
        if len(old) >= PARTS:
            df, old = self.read(table, schema).unionByName(df), {}
        path = f"{table}/v{self.version}"
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.store.folder}/{path}")
        self.parts[table] = old | {f"v{self.version}": path}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table that lasts until the commit is published: what a batch reads more than once."""
        path = f"{self.store.folder}/work/v{self.version}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def publish(self) -> int:
        """Makes the commit visible by one file that appears whole, then drops what no kept commit names.
        A number that another writer has published meanwhile is refused: nothing of this commit counts."""
        store, name = self.store, f"{self.store.top}/manifests/{self.version}"
        if self.version in store.versions():
            raise RuntimeError(f"another writer has published version {self.version}")
        store.files.create_dir(f"{store.top}/manifests", recursive=True)
        with store.files.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(self.parts, sort_keys=True).encode())
        store.files.move(f"{name}.part", f"{name}.json")
        if store._names(f"work/v{self.version}"):
            store.files.delete_dir(f"{store.top}/work/v{self.version}")
        self._clean()
        return self.version

    def _clean(self) -> None:
        store, known = self.store, self.store.versions()
        old, kept = known[: -store.keep], known[-store.keep :]
        folders = lambda v: {path.split("/_bucket=")[0] for parts in store.manifest(v).values() for path in parts.values()}
        used = set().union(*map(folders, kept))
        for version in old:
            for path in folders(version) - used:
                if store._names(path):
                    store.files.delete_dir(f"{store.top}/{path}")
            store.files.delete_file(f"{store.top}/manifests/{version}.json")
