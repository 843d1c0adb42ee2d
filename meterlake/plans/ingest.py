"""A ledger straight from folders of logs, in one batch; streaming.reconcile keeps one up to date."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import canonical, diagnostics, pricing
from meterlake.plans.dashboard import Ledger
from meterlake.schemas import ACCOUNT_STATE, AGENT, OCCURRENCE, RATE, SESSION
from meterlake.sources import claude, lines, providers
from meterlake.streaming.reconcile import record_usage


def ledger(spark: SparkSession, rates: DataFrame, states: DataFrame, kimi_root: str | None = None, claude_root: str | None = None, previous: DataFrame | None = None, roots: dict[str, str] | None = None) -> Ledger:
    """Canonical, metered and priced calls of the logs below the roots, by provider: those of the two
    families, and of any other that is registered. previous: a ledger whose prices stay."""
    named = {"kimi": kimi_root, "claude": claude_root} | (roots or {})
    parts = [p.parts(spark, named[p.name]) for p in providers.all_providers() if named.get(p.name) and p.parts]
    join = lambda i, schema: reduce(DataFrame.unionByName, [p[i] for p in parts]) if parts else spark.createDataFrame([], schema)
    sessions, agents = join(1, SESSION), join(2, AGENT)
    recorded = [record_usage(p[0].withColumn("generation", F.lit(0).cast("long")), states) for p in parts]
    occurrences = reduce(DataFrame.unionByName, recorded) if recorded else spark.createDataFrame([], OCCURRENCE)
    own = canonical.canonicalize(occurrences, sessions)
    calls = pricing.price(own, rates) if previous is None else pricing.sticky_price(own, previous, rates)
    return Ledger(calls, sessions, agents, rates, canonical.classified(occurrences, own))


def import_totals(made: Ledger) -> DataFrame:
    """One row: what an import holds."""
    seen = made.occurrences.agg(F.count("*").alias("occurrences"), F.countDistinct("source_path").alias("sources"), F.count_if(~F.col("is_canonical") & (F.col("replay_classification") != "superseded-usage")).alias("replays"), F.count_if(F.col("replay_classification") == "superseded-usage").alias("superseded"))
    own = made.calls.agg(F.count("*").alias("calls"), F.count_if("is_metered").alias("metered_calls"), F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced_calls"), F.coalesce(F.sum(F.when(F.col("is_metered"), F.col("total_cost_nano"))), F.lit(0)).alias("total_cost_nano"))
    return seen.crossJoin(own).crossJoin(made.sessions.agg(F.count("*").alias("sessions")))  # one row each


def transcripts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Usage records, and the scan of every line, of claude transcripts for diagnostics."""
    return claude.usage_records(lines.texts(lines.read(spark, root))), claude.scan(lines.texts(lines.read(spark, root, tail=True)))


def diagnose(spark: SparkSession, root: str, what: str, day: str, states: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """sessions (with their chains), hourly, aborts, or the replays of metered calls from day to until."""
    if what == "replays":
        known = spark.createDataFrame([], ACCOUNT_STATE) if states is None else states
        occurrences = ledger(spark, spark.createDataFrame([], RATE), known, claude_root=root).occurrences
        return diagnostics.replay_classes(occurrences, day, until or day)
    records, scan = transcripts(spark, root)
    if what == "hourly":
        return diagnostics.hourly(records, day)
    if what == "aborts":
        return diagnostics.aborts(records, scan.where("kind is not null").select("timestamp_ms", "kind"))
    if what == "sessions":
        bad = scan.groupBy("path").agg(F.count_if("malformed").alias("malformed"))
        return diagnostics.session_integrity(records, scan.where("uuid is not null").select("path", "uuid", "parent_uuid"), bad, day)
    raise ValueError(f"no such diagnosis: {what}")
