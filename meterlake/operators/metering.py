"""Metering: the account policy in force at a call's time decides whether it counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import times, usage

#: Account states up to this number go to every task and meet each call there; more are met by day.
STATES = 100


def intervals(states: DataFrame) -> DataFrame:
    """Account states with the end of their validity; the later of two with one beginning wins.

    The window is over the account's states, whose number doesn't grow with the calls."""
    last = states.groupBy("effective_from_ms").agg(F.max(F.struct("account_state_id", "policy")).alias("s"))
    return last.select(F.col("s.account_state_id").alias("state_id"), F.col("s.policy").alias("state_policy"), "effective_from_ms", F.lead("effective_from_ms").over(Window.orderBy("effective_from_ms")).alias("until_ms"))


def as_of(calls: DataFrame, states: DataFrame, limit: int = STATES) -> DataFrame:
    """Adds state_id and state_policy of the latest state at or before timestamp_ms; else null."""
    valid = intervals(states)
    if len(states.take(limit + 1)) <= limit:
        inside = (F.col("timestamp_ms") >= F.col("effective_from_ms")) & (F.col("until_ms").isNull() | (F.col("timestamp_ms") < F.col("until_ms")))
        return calls.join(F.broadcast(valid), inside, "left").drop("effective_from_ms", "until_ms")
    # each day has the state that it begins with, and those that begin in it
    calls = calls.withColumn("_day", F.floor(F.col("timestamp_ms") / times.DAY))
    days = calls.select("_day").distinct()
    starts = valid.select(F.floor(F.col("effective_from_ms") / times.DAY).alias("_day"), F.struct("effective_from_ms", "state_id", "state_policy").alias("_s"))
    per_day = starts.groupBy("_day").agg(F.array_sort(F.collect_list("_s")).alias("_in"), F.max("_s").alias("_last"))
    both = days.join(per_day, "_day", "full")
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_before", before)
    out = calls.join(both, "_day", "left")
    began = F.filter(F.coalesce(F.col("_in"), F.array().cast(both.schema["_in"].dataType)), lambda s: s["effective_from_ms"] <= F.col("timestamp_ms"))
    state = F.coalesce(F.try_element_at(began, F.lit(-1)), F.col("_before"))
    return out.withColumns({"state_id": state["state_id"], "state_policy": state["state_policy"]}).drop("_day", "_in", "_last", "_before")


def meter(calls: DataFrame, states: DataFrame, detected_state_id: int | None = None) -> DataFrame:
    """Sets account_state_id, is_metered and metering_basis of calls by provider and state.

    A call before the first state takes the detected one, if any. Calls of other providers than
    anthropic count and have no state."""
    out = as_of(calls, states)
    found, policy = F.col("state_id"), F.col("state_policy")
    if detected_state_id is not None:
        row = states.where(F.col("account_state_id") == detected_state_id).select("account_state_id", "policy").first()
        if row is not None:
            found, policy = F.coalesce(found, F.lit(row.account_state_id)), F.coalesce(policy, F.lit(row.policy))
    counts, basis = usage.metering(F.col("provider"), F.col("raw_model"), policy)
    own = F.when(F.col("provider") == "anthropic", found)
    return out.withColumns({"account_state_id": own.cast("long"), "is_metered": counts, "metering_basis": basis}).drop("state_id", "state_policy")


def backfill(occurrences: DataFrame, states: DataFrame, detected_state_id: int | None = None) -> DataFrame:
    """Meters only anthropic occurrences that have no state yet; the others keep what they have."""
    open_ = (F.col("provider") == "anthropic") & F.col("account_state_id").isNull()
    names = ["account_state_id", "is_metered", "metering_basis"]
    kept = occurrences.withColumns({f"_{c}": F.col(c) for c in names} | {"_open": F.coalesce(open_, F.lit(False))})
    out = meter(kept, states, detected_state_id)
    return out.withColumns({c: F.when(F.col("_open"), F.col(c)).otherwise(F.col(f"_{c}")) for c in names}).drop("_open", *[f"_{c}" for c in names])


def recorded_state(states: DataFrame, subscription: str, now_ms: int) -> DataFrame:
    """The states after a detection: the current one is confirmed, or a new one begins now; the
    very first reaches back to 0."""
    spark = states.sparkSession
    current = states.orderBy(F.desc("effective_from_ms"), F.desc("account_state_id")).limit(1).collect()
    if current and current[0].subscription_type == subscription:
        return states
    policy = "pro-fable" if subscription == "pro" else "enterprise-api" if subscription == "enterprise" else "subscription-excluded"
    next_id = (states.agg(F.max("account_state_id")).first()[0] or 0) + 1
    new = spark.createDataFrame([(next_id, subscription, policy, now_ms if current else 0)], "account_state_id long, subscription_type string, policy string, effective_from_ms long")
    return states.select(*new.columns).unionByName(new)
