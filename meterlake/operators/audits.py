"""Audits of the ledger against a usage export and against another tool's report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import times, usage

NANO = 1_000_000_000
MEASURES = ["cost_usd", "request_count", "input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_untyped"]
_COLUMNS = {"input": "input_other_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write_5m": "cache_creation_5m_tokens", "cache_write_1h": "cache_creation_1h_tokens", "cache_write_untyped": "cache_creation_tokens"}


def in_range(calls: DataFrame, start: str, end: str, zone: str, provider: str = "anthropic") -> DataFrame:
    """A provider's calls on the zone's days from start to end, with date and model_key."""
    rows = calls.where(F.col("provider") == provider).withColumns({"date": times.day_key(F.col("timestamp_ms"), zone), "model_key": usage.model_key(F.coalesce("resolved_model_key", "raw_model"))})
    return rows.where(F.col("date").between(start, end))


def ledger_days(calls: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """Metered totals per day and model; costs add up in whole nanodollars before the division."""
    own = in_range(calls, start, end, zone).where("is_metered")
    return own.groupBy("date", "model_key").agg((F.sum(F.coalesce("total_cost_nano", F.lit(0))) / NANO).alias("cost_usd"), F.count("*").alias("request_count"), *[F.sum(c).alias(n) for n, c in _COLUMNS.items()])


def gaps(calls: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """One row: calls in the range that don't count, and counted ones without a price."""
    return in_range(calls, start, end, zone).agg(F.count_if(~F.col("is_metered")).alias("unmetered_calls"), F.count_if(F.col("is_metered") & F.col("total_cost_nano").isNull()).alias("unpriced_calls"))


def compared(calls: DataFrame, export: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """Day, model and for each measure the export's, the ledger's and their difference. A day and
    model of one side only stands against zeros."""
    theirs = export.groupBy("date", "model_key").agg(*[F.sum(m).alias(f"export_{m}") for m in MEASURES[:-1]]).withColumn("export_cache_write_untyped", F.lit(0).cast("long"))
    ours = ledger_days(calls, start, end, zone)
    ours = ours.select("date", "model_key", *[F.col(m).alias(f"ledger_{m}") for m in MEASURES])
    both = ours.join(theirs, ["date", "model_key"], "full").na.fill(0)
    return both.withColumns({f"difference_{m}": F.col(f"ledger_{m}") - F.col(f"export_{m}") for m in MEASURES})


def wide(rows: DataFrame) -> DataFrame:
    """Measures side by side: export, ledger and difference of each in turn."""
    return rows.select("date", "model_key", *[f"{s}_{m}" for m in MEASURES for s in ("export", "ledger", "difference")])


def long(rows: DataFrame) -> DataFrame:
    """Three rows for each day and model: export, ledger and difference."""
    one = lambda s: F.struct(F.lit(s).alias("source"), *[F.col(f"{s}_{m}").cast("double" if m == "cost_usd" else "long").alias(m) for m in MEASURES])
    return rows.select("date", "model_key", F.inline(F.array(*[one(s) for s in ("export", "ledger", "difference")])))


def deviations(rows: DataFrame) -> DataFrame:
    """Costs per model and their difference; largest() orders them."""
    out = rows.groupBy("model_key").agg(F.sum("export_cost_usd").alias("export_usd"), F.sum("ledger_cost_usd").alias("ledger_usd"))
    return out.withColumn("difference_usd", F.col("ledger_usd") - F.col("export_usd"))


def largest(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.abs("difference_usd").desc(), "model_key")


def totals(rows: DataFrame) -> DataFrame:
    """One row of costs, their difference in dollars and percent (null where the export is 0), and request counts."""
    out = rows.agg(*[F.coalesce(F.sum(f"{s}_{m}"), F.lit(0)).alias(n) for n, s, m in (("export_usd", "export", "cost_usd"), ("ledger_usd", "ledger", "cost_usd"), ("export_requests", "export", "request_count"), ("ledger_requests", "ledger", "request_count"))])
    out = out.withColumn("difference_usd", F.col("ledger_usd") - F.col("export_usd"))
    return out.withColumn("difference_percent", usage.percent_difference(F.col("export_usd"), F.col("difference_usd")))


def status(calls: DataFrame) -> DataFrame:
    """One row: not-detected, nothing-metered or compared."""
    own = calls.where("provider = 'anthropic'").agg(F.count("*").alias("calls"), F.count_if("is_metered").alias("metered"))
    return own.select(F.when(F.col("calls") == 0, "not-detected").when(F.col("metered") == 0, "nothing-metered").otherwise("compared").alias("status"))


def metered_totals(calls: DataFrame, provider: str) -> DataFrame:
    """One row: metered calls of a provider, those without a price, and their cost."""
    return calls.where((F.col("provider") == provider) & F.col("is_metered")).agg(F.count("*").alias("calls"), F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced_calls"), F.coalesce(F.sum("total_cost_nano"), F.lit(0)).alias("total_cost_nano"))


def external_split(external: DataFrame, calls: DataFrame) -> DataFrame:
    """Another tool's costs per model (model_key, cost_usd), marked by whether the ledger meters the model."""
    metered = calls.where("provider = 'anthropic' and is_metered").select(usage.model_key(F.col("raw_model")).alias("model_key")).distinct().withColumn("_m", F.lit(True))
    return external.join(metered, "model_key", "left").select("model_key", "cost_usd", F.coalesce("_m", F.lit(False)).alias("is_metered"))


def external_comparison(external: DataFrame, calls: DataFrame, provider: str = "anthropic") -> DataFrame:
    """One row: the tool's cost of metered models against the ledger's, and how many models aren't metered."""
    split = external_split(external, calls) if provider == "anthropic" else external.withColumn("is_metered", F.lit(True))
    theirs = split.agg(F.coalesce(F.sum(F.when(F.col("is_metered"), F.col("cost_usd"))), F.lit(0.0)).alias("external_usd"), F.count_if(~F.col("is_metered")).alias("unmetered_models"))
    ours = metered_totals(calls, provider).select((F.col("total_cost_nano") / NANO).alias("ledger_usd"), "calls", "unpriced_calls")
    out = theirs.crossJoin(ours).withColumn("difference_usd", F.col("ledger_usd") - F.col("external_usd"))  # one row each
    return out.withColumn("difference_percent", usage.percent_difference(F.col("external_usd"), F.col("difference_usd")))
