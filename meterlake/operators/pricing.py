"""Pricing: the best rate of each call, and prices that stay until usage changes.

A model's rates are gathered into one short array in order of priority, so that each call meets
one row and picks from it: no rows are multiplied and calls are never shuffled to be ranked."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import usage
from meterlake.schemas import COSTS, RATES, TOKENS


def usable(rates: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Active rates that stand alone or belong to a snapshot that is the last good one."""
    rates = rates.where("is_active")
    if snapshots is None:
        return rates
    good = snapshots.where("is_last_good").select("snapshot_id", F.lit(True).alias("_good"))
    return rates.join(good, "snapshot_id", "left").where("snapshot_id is null or _good").drop("_good")


def _gathered(rates: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """One row per key: its rates, the best first."""
    rank = [usage.source_priority(F.col("source_name")).alias("priority"), (-F.coalesce("effective_at_ms", F.lit(0))).alias("newest"), F.col("rate_id")]
    entry = F.struct(*rank, "effective_at_ms", "model_key", "provider", "source_name", "confidence", *RATES)
    return rates.select(*[c.alias(k) for k, c in keys.items()], entry.alias("r")).groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias(name))


def with_rate(calls: DataFrame, rates: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Adds _rate, a struct of the best rate: by alias, or by provider and model key; effective at
    the call's time; by source priority, then the newest, then rate_id. Null where none fits."""
    rates = usable(rates, snapshots)
    alias = _gathered(rates.where("raw_alias is not null"), {"_alias": F.col("raw_alias")}, "_by_alias")
    keyed = _gathered(rates.where("raw_alias is null"), {"_p": F.col("provider"), "_k": F.col("model_key")}, "_by_key")
    model = F.col("raw_model")
    calls = calls.join(alias, model == F.col("_alias"), "left").join(keyed, (usage.provider_of(model) == F.col("_p")) & (usage.model_key(model) == F.col("_k")), "left")
    first = lambda c: F.get(F.filter(F.col(c), lambda r: r["effective_at_ms"].isNull() | (r["effective_at_ms"] <= F.col("timestamp_ms"))), F.lit(0))
    return calls.withColumn("_rate", F.least(first("_by_alias"), first("_by_key"))).drop("_alias", "_by_alias", "_p", "_k", "_by_key")


def _priced(calls: DataFrame) -> dict[str, Column]:
    rate = F.col("_rate")
    return usage.costs(rate) | {
        "rate_id": rate["rate_id"],
        "resolved_model_key": F.concat(usage.provider_of(F.col("raw_model")), F.lit("/"), rate["model_key"]),
        "pricing_confidence": F.coalesce(rate["confidence"], F.lit("unpriced")),
        "pricing_basis": F.coalesce(usage.pricing_basis(rate["source_name"], rate["confidence"]), F.lit("No matching rate")),
    }


def price(calls: DataFrame, rates: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Adds costs, rate_id, resolved_model_key, pricing_confidence and pricing_basis."""
    out = with_rate(calls, rates, snapshots)
    return out.withColumns(_priced(out)).drop("_rate")


def sticky_price(calls: DataFrame, previous: DataFrame, rates: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """price(), but a call whose usage is as in the previous ledger keeps its price, and one whose
    usage has changed is priced anew by the rate that it had, if that still exists."""
    kept = [*COSTS, "rate_id", "resolved_model_key", "pricing_confidence", "pricing_basis"]
    old = previous.select("event_fingerprint", F.struct(*TOKENS, *kept).alias("_old"))
    rows = with_rate(calls.join(old, "event_fingerprint", "left"), rates, snapshots)
    stored = rates.select(F.col("rate_id").alias("_id"), F.struct("rate_id", "provider", "model_key", "source_name", "confidence", *RATES).alias("_stored"))
    rows = rows.join(stored, F.col("_old.rate_id") == F.col("_id"), "left").drop("_id")
    same = F.coalesce(F.struct(*[F.col(f"_old.{c}") for c in TOKENS]) == F.struct(*TOKENS), F.lit(False)) & F.col("_old").isNotNull()
    fresh, own = _priced(rows), F.col("_stored")
    again = usage.costs(own) | {"rate_id": own["rate_id"], "resolved_model_key": F.concat(own["provider"], F.lit("/"), own["model_key"]), "pricing_confidence": own["confidence"], "pricing_basis": usage.pricing_basis(own["source_name"], own["confidence"])}
    return rows.withColumns({c: F.when(same, F.col(f"_old.{c}")).when(own.isNotNull(), again[c]).otherwise(fresh[c]) for c in kept}).drop("_old", "_rate", "_stored")


def price_unpriced(ledger: DataFrame, rates: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Prices again only the calls that have no price."""
    kept = [*COSTS, "rate_id", "resolved_model_key", "pricing_confidence", "pricing_basis"]
    out = with_rate(ledger, rates, snapshots)
    fresh, bare = _priced(out), F.col("total_cost_nano").isNull()
    return out.withColumns({c: F.when(bare, fresh[c]).otherwise(F.col(c)) for c in kept}).drop("_rate")


def rate_columns(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds rate_input_nano, the input rate that a call was priced by; null without a rate."""
    return calls.join(rates.select("rate_id", F.col("input_nano_per_token").alias("rate_input_nano")), "rate_id", "left")
