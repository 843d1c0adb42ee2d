"""Rate books, health, and orders that no number leads."""

import pytest
from pyspark.sql import functions as F

from meterlake.operators import status
from meterlake.operators.ordered import numbered
from meterlake.plans import dashboard
from meterlake.schemas import ACCOUNT_STATE, RATES
from meterlake.sources import catalogs
from meterlake.streaming.rates import RateBook
from meterlake.streaming.reconcile import BATCHES, COUNTERS

HOUR = 3_600_000


def test_rate_book(spark, tmp_path):
    """Ids survive a refresh; what fails, is empty or can't be leaves prices and the last good snapshot."""
    base = catalogs.bundled(spark)
    book = RateBook(spark, f"file://{tmp_path}/rates", base)
    own = base.where("provider = 'moonshotai'").withColumn("source_name", F.lit("litellm"))
    assert book.is_due("litellm", 0) and book.refresh("moonshotai", "litellm", 10, lambda: own)
    assert not book.is_due("litellm", 10 + 24 * HOUR) and book.is_due("litellm", 11 + 24 * HOUR) and book.is_due("models.dev", 10)
    good = sorted(map(tuple, book.rates.collect()), key=repr)

    def failing():
        raise OSError("timed out")

    price = RATES[0]
    for read in (failing, lambda: own.limit(0), lambda: own.withColumn(price, F.lit(-1).cast("long")), lambda: own.drop(price)):
        assert not book.refresh("moonshotai", "litellm", 20, read)
        assert sorted(map(tuple, book.rates.collect()), key=repr) == good
    assert book.snapshots.where("is_valid").count() == 1 and book.snapshots.count() == 5
    (last,) = book.attempts.collect()
    assert (last.attempted_at_ms, last.succeeded_at_ms) == (20, 10) and price in last.error
    ids = {r.model_key: r.rate_id for r in book.rates.where("source_name = 'litellm'").collect()}
    assert book.refresh("moonshotai", "litellm", 30, lambda: own.where("model_key <> 'kimi-k3'"))
    assert {r.model_key: r.rate_id for r in book.rates.where("source_name = 'litellm' and is_active").collect()} == {k: v for k, v in ids.items() if k != "kimi-k3"}
    assert book.attempts.first().error is None


def test_health(spark):
    """Nothing amiss is ok; each fault is a warning, in order."""
    counts = lambda unpriced: spark.createDataFrame([(3, 2, unpriced)], "calls long, sessions long, unpriced_calls long")
    sessions = spark.createDataFrame([("moonshotai",), ("anthropic",), ("anthropic",)], "provider string")
    states = spark.createDataFrame([(1, "pro", "pro-fable", 5)], ACCOUNT_STATE)
    rates = catalogs.bundled(spark)

    def report(error, unpriced, account, errors):
        attempts = spark.createDataFrame([("moonshotai", "litellm", 10, 10, error), ("moonshotai", "models.dev", 10, 10, None), ("anthropic", "anthropic", 10, 10, None)], status.ATTEMPT)
        checks = spark.createDataFrame([("anthropic", 1, 9, 8, account)], status.ACCOUNT)
        log = spark.createDataFrame([(4, "a", 0, True, *({c: 0 for c in COUNTERS} | {"errors": errors}).values())], BATCHES)
        prices = status.provider_statuses(attempts, rates, 10 + HOUR)
        return status.health_report(counts(unpriced), sessions, status.ingestion_status(log), status.account_status(checks, states), attempts, prices).first()

    ok = report(None, 0, None, 0)
    assert ok.status == "ok" and ok.warnings == [] and ok.detected_providers == ["anthropic", "moonshotai"]
    assert (ok.account_policy, ok.account_detected_at_ms, ok.data_version, [p.refresh_status for p in ok.pricing]) == ("pro-fable", 5, 4, ["succeeded", "succeeded"])
    bad = report("HTTP 500", 7, "expired", 2)
    assert bad.status == "warning" and bad.warnings == ["2 source(s) could not be read.", "Claude account check: expired", "litellm: HTTP 500", "7 call(s) have no matching price."]
    assert [(p.refresh_status, p.has_warning, p.description) for p in bad.pricing] == [("succeeded", False, ""), ("partial-failure", True, "Pricing refresh failed: litellm: HTTP 500")]
    nothing = status.provider_statuses(spark.createDataFrame([], status.ATTEMPT), rates.where("provider = 'anthropic'"), 0).first()
    assert (nothing.refresh_status, nothing.is_stale, nothing.bundled_date, nothing.has_warning) == ("not-attempted", True, "2026-08-14", True)
    empty = status.health_report(counts(0), sessions.limit(0), status.ingestion_status(spark.createDataFrame([], BATCHES)), spark.createDataFrame([], status.ACCOUNT + ", policy string, subscription_type string, detected_at_ms long"), spark.createDataFrame([], status.ATTEMPT), status.provider_statuses(spark.createDataFrame([], status.ATTEMPT), rates.limit(0), 0)).first()
    assert empty.status == "ok" and empty.detected_providers == [] and empty.pricing == []


def test_collated_order(spark):
    """Mixed case and accents as a collation has them, not by code points."""
    words = ["zebra", "Zoo", "apple", "Äpfel", "Apple", "éclair", "Eclair", "eclair", "", "10", "9"]
    df = spark.createDataFrame([(w,) for w in words], "value string").repartition(4)
    got = [r.value for r in dashboard.in_collated_order(df).orderBy("position").collect()]
    assert got == ["", "10", "9", "Äpfel", "apple", "Apple", "eclair", "Eclair", "éclair", "zebra", "Zoo"] or got == ["", "10", "9", "apple", "Apple", "Äpfel", "eclair", "Eclair", "éclair", "zebra", "Zoo"]
    assert sorted(words) != got


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbered(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 101).alias("a"), "id").repartition(5)
    rows = numbered(df, [F.desc("a"), F.col("id").asc()], "p").collect()
    assert [(r.a, r.id) for r in sorted(rows, key=lambda r: r.p)] == sorted(((r.a, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    assert sorted(r.p for r in rows) == list(range(n))
