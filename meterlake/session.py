"""Session settings that the ledger's semantics rest on."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Calendar arithmetic assumes UTC sessions; integer sums must raise on overflow, not wrap.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a session that exists."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(master: str = "local[*]", partitions: int | None = None) -> SparkSession:
    """A new or the current session with SETTINGS."""
    builder = SparkSession.builder.master(master).config(map=SETTINGS)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return configure(builder.getOrCreate())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, for reports that read it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share, spark.checkpoint.dir; a local
    one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meterlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
