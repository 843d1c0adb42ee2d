"""Statuses of ingestion, account and prices, and the health report that they make up."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import labels, usage
from meterlake.operators import catalog

OVERRIDE = "user-override"
#: Attempts of a source: the last one, the last that succeeded, and the last one's error.
ATTEMPT = "provider string, source_name string, attempted_at_ms long, succeeded_at_ms long, error string"
ACCOUNT = "provider string, account_state_id long, last_attempt_at_ms long, last_success_at_ms long, error string"


def account_status(checks: DataFrame, states: DataFrame) -> DataFrame:
    """The account's last check (ACCOUNT) with the state that it confirmed, if any; a failed check keeps
    the policy of the last good one."""
    known = states.select("account_state_id", "subscription_type", "policy", F.col("effective_from_ms").alias("detected_at_ms"))
    return checks.where("provider = 'anthropic'").join(known, "account_state_id", "left").drop("account_state_id")


def ingestion_status(batches: DataFrame) -> DataFrame:
    """One row: the ledger's version, sources that the last batch of any stream could not read, and why."""
    last = batches.groupBy("stream").agg(F.max_by("errors", "version").alias("errors"), F.max("version").alias("version"))
    out = last.agg(F.coalesce(F.max("version"), F.lit(0)).alias("data_version"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    text = F.concat(F.col("errors").cast("string"), F.lit(" source(s) could not be read."))
    return out.withColumn("error", F.when(F.col("errors") > 0, text))


def _present(*texts: Column) -> Column:
    return F.filter(F.array(*texts), lambda x: x.isNotNull())


def provider_statuses(attempts: DataFrame, rates: DataFrame, now_ms: int) -> DataFrame:
    """Per provider: refresh status, age and source of its prices, and a warning where something is amiss.

    Sources of a provider are few. A provider without active rates has no source, and that is a warning."""
    failed = F.when(F.col("error").isNotNull(), F.concat("source_name", F.lit(": "), "error"))
    errors = attempts.groupBy("provider").agg(F.nullif(F.array_join(F.array_sort(F.collect_list(failed)), "; "), F.lit("")).alias("error"))
    own = F.when(F.col("source_name") != OVERRIDE, F.struct(usage.source_priority(F.col("source_name")).alias("p"), "source_name"))
    priced = rates.where("is_active").groupBy("provider").agg(F.bool_or(F.col("source_name") == OVERRIDE).alias("has_overrides"), F.min(own)["source_name"].alias("source_name"))
    rows = catalog.refresh_status(attempts, now_ms).join(errors, "provider", "full").join(priced, "provider", "full")
    overrides = F.coalesce("has_overrides", F.lit(False))
    status, stale = F.coalesce("refresh_status", F.lit("not-attempted")), F.coalesce("is_stale", F.lit(True))
    said = _present(
        F.when(F.col("source_name").isNull() & ~overrides, "No pricing catalog is available."),
        F.when(stale, "Pricing is stale."),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Pricing refresh failed: "), "error")),
        F.when(overrides, "User overrides are active."),
    )
    amiss = F.col("source_name").isNull() | F.col("error").isNotNull() | stale | status.isin("failed", "partial-failure")
    bundled = F.when(F.col("updated_at_ms").isNull(), labels.bundled_date(F.col("source_name")))
    name = F.when(F.col("source_name") == "anthropic", "Claude Official").when(F.col("source_name") == "models.dev", "Kimi models.dev")
    name = name.when(F.col("source_name") == "litellm", "Kimi LiteLLM").when(F.col("provider") == "anthropic", "Claude Bundled").otherwise("Kimi Bundled")
    return rows.select("provider", status.alias("refresh_status"), stale.alias("is_stale"), overrides.alias("has_overrides"), "source_name", name.alias("source_label"), "updated_at_ms", bundled.alias("bundled_date"), "error", amiss.alias("has_warning"), F.array_join(said, " ").alias("description"))


def health_report(counts: DataFrame, sessions: DataFrame, ingestion: DataFrame, account: DataFrame, attempts: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: counts, detected providers, the three statuses, all warnings in order, and whether it is ok.

    counts has calls, sessions and unpriced_calls; ingestion and account one row at most."""
    found = sessions.agg(F.array_sort(F.collect_set("provider")).alias("detected_providers"))
    failed = attempts.where("error is not null").agg(F.array_sort(F.collect_list(F.concat("source_name", F.lit(": "), "error"))).alias("_failed"))
    prices = statuses.agg(F.array_sort(F.collect_list(F.struct(*statuses.columns))).alias("pricing"))
    check = account.agg(*[F.max(c).alias(f"account_{c}") for c in ("policy", "subscription_type", "detected_at_ms", "last_attempt_at_ms", "last_success_at_ms", "error")])
    state = ingestion.agg(F.max("data_version").alias("data_version"), F.max("error").alias("ingestion_error"))
    rows = counts.select("calls", "sessions", "unpriced_calls")
    for one in (found, failed, prices, check, state):
        rows = rows.crossJoin(one)  # one row each
    unpriced = F.when(F.col("unpriced_calls") > 0, F.concat(F.col("unpriced_calls").cast("string"), F.lit(" call(s) have no matching price.")))
    of_account = F.when(F.col("account_error").isNotNull(), F.concat(F.lit("Claude account check: "), "account_error"))
    warnings = F.concat(_present(F.col("ingestion_error"), of_account), "_failed", _present(unpriced))
    rows = rows.withColumn("warnings", warnings).drop("_failed")
    return rows.withColumn("status", F.when(F.size("warnings") == 0, "ok").otherwise("warning"))
