"""Versions of rate tables: refreshes keep the ids of rates that stay as they are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.ordered import running
from meterlake.schemas import RATES

#: What makes two rate rows the same.
IDENTITY = ["provider", "model_key", "raw_alias", *RATES, "source_name", "confidence", "effective_at_ms"]
STALE_MS = 24 * 3_600_000


def refreshed(rates: DataFrame, source: DataFrame, source_name: str, snapshot_id: int | None = None) -> DataFrame:
    """The rate table after a source has been read anew: its identical rows are active again under
    their old ids, new ones get the next ids, and rows that the source no longer has stay inactive.

    source has the columns of IDENTITY; repeated rows count once."""
    source = source.select(*IDENTITY).where(F.col("source_name") == source_name).distinct()
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in IDENTITY]
    own = rates.where(F.col("source_name") == source_name)
    oldest = own.groupBy(*IDENTITY).agg(F.min("rate_id").alias("_keep"))
    back = oldest.alias("o").join(source.alias("s"), same("o", "s"), "left_semi").select("_keep")
    kept = rates.join(back, rates.rate_id == back._keep, "left")
    alive = F.when(F.col("source_name") == source_name, F.col("_keep").isNotNull()).otherwise(F.col("is_active"))
    kept = kept.withColumn("is_active", alive).drop("_keep")
    if snapshot_id is not None:
        kept = kept.withColumn("snapshot_id", F.when((F.col("source_name") == source_name) & F.col("is_active"), F.lit(snapshot_id)).otherwise(F.col("snapshot_id")))
    new = source.alias("s").join(oldest.alias("o"), same("o", "s"), "left_anti")
    top = rates.agg(F.coalesce(F.max("rate_id"), F.lit(0)).alias("_top"))
    new = running(new, F.xxhash64("provider", "model_key"), 1 << 58, [F.to_json(F.struct(*IDENTITY))], {}, "_at").crossJoin(top)  # one row
    new = new.withColumns({"rate_id": (F.col("_top") + F.col("_at") + 1).cast("long"), "snapshot_id": F.lit(snapshot_id).cast("long"), "is_active": F.lit(True)})
    return kept.unionByName(new.select(*kept.columns))


def last_good(snapshots: DataFrame) -> DataFrame:
    """The newest valid snapshot of each source.

    snapshots: snapshot_id, source_name, fetched_at_ms, is_valid."""
    best = snapshots.where("is_valid").groupBy("source_name").agg(F.max(F.struct("fetched_at_ms", "snapshot_id")).alias("b"))
    return snapshots.join(best.select(F.col("b.snapshot_id").alias("snapshot_id"), F.lit(True).alias("_g")), "snapshot_id", "left").withColumn("is_last_good", F.coalesce("_g", F.lit(False))).drop("_g")


def refresh_status(attempts: DataFrame, now_ms: int) -> DataFrame:
    """Per provider: not-attempted, failed, partial-failure or succeeded, and whether it is stale.

    attempts: provider, source_name, attempted_at_ms, succeeded_at_ms, error; times may be null."""
    tried, failed = F.col("attempted_at_ms").isNotNull(), F.col("error").isNotNull()
    out = attempts.groupBy("provider").agg(F.count_if(tried).alias("_t"), F.count_if(tried & failed).alias("_f"), F.max("succeeded_at_ms").alias("updated_at_ms"))
    status = F.when(F.col("_t") == 0, "not-attempted").when(F.col("_f") == F.col("_t"), "failed").when(F.col("_f") > 0, "partial-failure").otherwise("succeeded")
    return out.select("provider", status.alias("refresh_status"), "updated_at_ms", F.coalesce(F.lit(now_ms) - F.col("updated_at_ms") > STALE_MS, F.lit(True)).alias("is_stale"))
