"""Queries of what a store tells besides its calls: import counters, agents, rates, health and ordered options."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators import status
from meterlake.plans import dashboard
from meterlake.plans.catalogue import query
from meterlake.plans.testdata import NOW, Data
from meterlake.plans.testlogs import write_transcripts, write_wires
from meterlake.schemas import RATES
from meterlake.session import shared_path
from meterlake.streaming.rates import RateBook
from meterlake.streaming.reconcile import BATCHES, COUNTERS, Reconciler


def _reconciler(d: Data) -> Reconciler:
    return Reconciler(d.spark, shared_path(d.spark, "ledger"), d.sessions, d.bundled, d.states)


@query
def import_counters(d: Data):
    """events as wires, followed by a stream; then every seventh session's log goes, and every fifth plus one
    is written anew with half of its calls. A third look finds nothing and leaves no row."""
    import pyarrow.fs as pafs

    logs, made, session = shared_path(d.spark, "logs"), _reconciler(d), F.col("session_id").cast("long")
    write_wires(d.raw_calls, logs, F.when(session % 7 == 0, "old").otherwise("ws"))
    made.start(logs, shared_path(d.spark, "checkpoint")).awaitTermination()
    store, top = pafs.FileSystem.from_uri(logs)
    if store.get_file_info(f"{top}/sessions/old").type == pafs.FileType.Directory:
        store.delete_dir(f"{top}/sessions/old")
    write_wires(d.raw_calls.where((session % 7 != 0) & (session % 5 == 1) & (F.col("event_id") % 2 == 0)), logs)
    for _ in range(2):
        made.take(logs)
    return made.batches.select("version", "changed", *COUNTERS)


@query
def store_agents(d: Data):
    """Agents that the store knows after the transcripts of all events."""
    logs, made = shared_path(d.spark, "transcripts"), _reconciler(d)
    write_transcripts(d.raw_calls, d.sessions, logs)
    made.take(logs)
    return made.agents.drop("source_path")


def _prices(d: Data) -> DataFrame:
    """A rate for each nation."""
    k = F.col("n_nationkey").cast("long")
    own = [((k + 1) * 1000).alias(c) for c in RATES]
    none = F.lit(None)
    return d.table("nation").select(k.alias("k"), F.lit("moonshotai").alias("provider"), F.concat(F.lit("kimi-n"), k.cast("string")).alias("model_key"), none.cast("string").alias("raw_alias"), *own, F.lit("litellm").alias("source_name"), F.lit("exact").alias("confidence"), none.cast("long").alias("effective_at_ms"))


def _book(d: Data) -> tuple[RateBook, DataFrame]:
    """A rate book after a first reading, one that changes some prices and lacks others, one that fails,
    and one that has nothing; and the ids after the first."""
    book, prices, k = RateBook(d.spark, shared_path(d.spark, "rates"), d.bundled), _prices(d), F.col("k")
    raised = F.col(RATES[0]) + F.when(k % 5 == 0, 500).otherwise(0)

    def failing() -> DataFrame:
        raise OSError("HTTP 503")

    book.refresh("moonshotai", "litellm", NOW - 5, lambda: prices)
    first = book.rates.where("source_name = 'litellm'").select("rate_id", F.col("model_key").alias("_key"), F.lit(True).alias("same_id"))
    first = d.spark.createDataFrame(first.collect(), first.schema)  # the source's rates, one row a model
    book.refresh("moonshotai", "litellm", NOW - 4, lambda: prices.where(k % 7 != 6).withColumn(RATES[0], raised))
    book.refresh("moonshotai", "litellm", NOW - 3, failing)
    book.refresh("anthropic", "anthropic", NOW - 2, lambda: prices)
    return book, first


@query
def rate_refresh(d: Data):
    """Rates after the readings: ids of unchanged ones survive, failed readings change nothing."""
    book, first = _book(d)
    rows = book.rates.where("source_name = 'litellm'").join(first, "rate_id", "left")
    return rows.select("model_key", RATES[0], "is_active", "snapshot_id", F.coalesce("same_id", F.lit(False)).alias("same_id"))


@query
def rate_statuses(d: Data):
    book, _ = _book(d)
    return status.provider_statuses(book.attempts, book.rates, NOW)


def _attempts(d: Data) -> DataFrame:
    """An attempt at a source for each region."""
    k = F.col("r_regionkey").cast("long")
    provider = F.when(k % 2 == 0, "moonshotai").otherwise("anthropic")
    tried = F.when(k != 4, F.lit(NOW) - k * 1000)
    error = F.when(k.isin(1, 2), F.concat(F.lit("HTTP 50"), k.cast("string")))
    return d.table("region").select(provider.alias("provider"), F.concat(F.lit("source-"), k.cast("string")).alias("source_name"), tried.alias("attempted_at_ms"), F.when(error.isNull(), tried).alias("succeeded_at_ms"), error.alias("error"))


@query
def health_report(d: Data):
    """Counts, statuses and warnings as one row; lists as text."""
    attempts = _attempts(d)
    checks = d.spark.createDataFrame([("anthropic", 1, NOW - 1, NOW - 9, "not signed in")], status.ACCOUNT)
    zero = {c: 0 for c in COUNTERS}
    log = [(i, name, 0, True, *(zero | {"errors": n}).values()) for i, (name, n) in enumerate((("a", 5), ("b", 2), ("a", 0)), 1)]
    ingestion = status.ingestion_status(d.spark.createDataFrame(log, BATCHES))
    statuses = status.provider_statuses(attempts, d.bundled, NOW)
    made = status.health_report(dashboard.health(d.ledger), d.sessions, ingestion, status.account_status(checks, d.states), attempts, statuses)
    prices = F.transform("pricing", lambda p: F.concat_ws(" ", p["provider"], p["refresh_status"], p["source_label"], p["description"]))
    lists = [F.array_join(x, "; ").alias(n) for x, n in ((F.col("detected_providers"), "providers"), (prices, "pricing"), (F.col("warnings"), "warnings"))]
    return made.select("calls", "sessions", "unpriced_calls", "data_version", "status", "account_policy", "account_last_success_at_ms", *lists)


@query
def options_in_order(d: Data):
    """Session options with their places in their group and in all."""
    options = dashboard.session_options(d.ledger, NOW)
    return dashboard.ordered_options(options).select("value", "recency_group", "group_position", "position")


@query
def workspaces_in_order(d: Data):
    return dashboard.in_collated_order(dashboard.workspace_options(d.ledger))
