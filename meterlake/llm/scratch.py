"""Intermediate tables and files in the folder that driver and executors share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meterlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: cuts the lineage, so a lost executor costs no earlier stage again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in a struct _rest, where their names clash with nothing."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in needed]
    return df.select(*needed, F.struct(*rest).alias("_rest")) if rest else df


def unpacked(df: DataFrame, needed: list[str], columns: list[str], *added: str) -> DataFrame:
    """Undoes packed: columns in their order, then added ones; those replace others of their name."""
    kept = [F.col(c) if c in needed else F.col(f"_rest.`{c}`").alias(c) for c in columns if c not in added]
    return df.select(*kept, *added)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions; operators size their own exchanges by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of a batch of texts that Spark hands to a worker: Spark's own 10,000 rows and 64 MB
#: would be held several times over by each task, outside the executor's heap and in its workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; the session's Arrow batches are of BATCH at most from now on. Results don't hang on it."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = int(str(conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df
