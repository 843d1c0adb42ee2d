"""The rate table as it is refreshed from its sources, with every attempt kept."""

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import catalog
from meterlake.operators.status import ATTEMPT
from meterlake.schemas import RATE, RATES
from meterlake.sinks.store import Store

SNAPSHOTS = "snapshot_id long, provider string, source_name string, fetched_at_ms long, is_valid boolean, error string"


class RateBook:
    """Rates and snapshots in a store. A refresh that fails, or that gives nothing or prices that can't
    be, is recorded and leaves every rate as it was; one that succeeds keeps the ids of unchanged rates."""

    def __init__(self, spark: SparkSession, folder: str, given: DataFrame):
        self.spark, self.store, self.given = spark, Store(spark, folder), given

    @property
    def rates(self) -> DataFrame:
        return self.store.read("rates", RATE) if "rates" in self.store.manifest() else self.given

    @property
    def snapshots(self) -> DataFrame:
        return self.store.read("snapshots", SNAPSHOTS)

    @property
    def attempts(self) -> DataFrame:
        """ATTEMPT of each source."""
        at = F.col("fetched_at_ms")
        own = self.snapshots.groupBy("provider", "source_name")
        return own.agg(F.max(at).alias("attempted_at_ms"), F.max(F.when(F.col("is_valid"), at)).alias("succeeded_at_ms"), F.max_by("error", "snapshot_id").alias("error")).select(*[c.split()[0] for c in ATTEMPT.split(", ")])

    def is_due(self, source_name: str, now_ms: int) -> bool:
        """Whether a source has not succeeded for a day."""
        fresh = (F.col("source_name") == source_name) & (now_ms - F.col("succeeded_at_ms") <= catalog.STALE_MS)
        return self.attempts.where(F.coalesce(fresh, F.lit(False))).isEmpty()

    def refresh(self, provider: str, source_name: str, at_ms: int, read: Callable[[], DataFrame]) -> bool:
        """Takes up what read gives: rows of the rate table without ids. Tells whether it did."""
        commit, error, found = self.store.begin(), None, None
        try:
            found = commit.keep("found", read().where(F.col("source_name") == source_name).select(*catalog.IDENTITY))
            wrong = F.greatest(*[F.coalesce(F.col(c) < 0, F.lit(False)) for c in RATES]) | F.col("model_key").isNull()
            n = found.agg(F.count("*").alias("rows"), F.count_if(wrong).alias("wrong")).first()
            error = "no rates" if not n.rows else f"{n.wrong} rates can't be" if n.wrong else None
        except (ValueError, OSError, PySparkException) as e:
            error = str(e).split("\n")[0]
        number = self.snapshots.count() + 1
        row = (number, provider, source_name, at_ms, error is None, error)
        commit.append("snapshots", self.spark.createDataFrame([row], SNAPSHOTS), SNAPSHOTS)
        if error is None:
            commit.write("rates", catalog.refreshed(self.rates, found, source_name, number).select(*[c.split()[0] for c in RATE.split(", ")]))
        commit.publish()
        return error is None
