"""Usage exports and another tool's cost reports, as JSON documents in a column content."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import usage
from meterlake.functions import variants as V

#: What an export must say of itself.
LITERALS = {"currency": "usd", "granularity": "daily", "group_by": "model_tier"}
#: The lists that a report may hold its entries in.
ENTRIES = ["daily", "weekly", "monthly", "sessions", "session", "blocks"]


def usage_days(documents: DataFrame) -> DataFrame:
    """Days of an export: date, model_key, cost_usd, request_count and token counts. Raises on an
    export of another kind; cents become dollars, underscores in model names hyphens."""
    v = F.col("v")
    rows = documents.select(F.parse_json("content").alias("v"))
    good = F.lit(True)
    for name, value in LITERALS.items():
        good = good & F.coalesce(V.text(v, f"$.{name}") == value, F.lit(False))
    series = F.try_variant_get(v, "$.series", "array<variant>")
    checked = F.when(good & series.isNotNull(), series).otherwise(F.raise_error(F.lit("not a daily model-tier usage export in USD")).cast("array<variant>"))
    rows = rows.select(F.explode(checked).alias("e"))
    e = F.col("e")
    number = lambda path, kind: F.variant_get(e, path, kind)
    names = {"input": "input", "output": "output", "cache_read": "cache_read", "cache_write_5m": "cache_write_5m", "cache_write_1h": "cache_write_1h"}
    return rows.select(V.text(e, "$.bucket").alias("date"), F.replace(V.text(e, "$.group_key"), F.lit("_"), F.lit("-")).alias("model_key"), (number("$.cost_minor_units", "double") / 100).alias("cost_usd"), number("$.request_count", "long").alias("request_count"), *[number(f"$.tokens.{k}", "long").alias(n) for n, k in names.items()])


def usage_range(documents: DataFrame) -> DataFrame:
    """One row a document: start_date and end_date."""
    v = F.parse_json("content")
    return documents.select(V.text(v, "$.start_date").alias("start_date"), V.text(v, "$.end_date").alias("end_date"))


def _entries(v):
    lists = [F.when(V.kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))]
    lists += [F.when(V.kind(V.at(v, f"$.{k}")) == "ARRAY", F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in ENTRIES]
    return F.coalesce(*lists)


def report_total(documents: DataFrame) -> DataFrame:
    """total_usd of each report: its totals, its own total, or the sum of its entries; else raises."""
    rows = documents.select(F.parse_json("content").alias("v"))
    v = F.col("v")
    number = lambda x, path: F.when(V.kind(V.at(x, path)).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(x, path, "double"))
    summed = F.aggregate(F.transform(_entries(v), lambda e: F.coalesce(number(e, "$.totalCost"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    total = F.coalesce(number(v, "$.totals.totalCost"), number(v, "$.totalCost"), summed)
    return rows.select(F.when(total.isNotNull(), total).otherwise(F.raise_error(F.lit("the report has no total cost")).cast("double")).alias("total_usd"))


def report_models(documents: DataFrame) -> DataFrame:
    """model_key and cost_usd of a report's model breakdowns."""
    rows = documents.select(F.parse_json("content").alias("v")).select(F.explode(_entries(F.col("v"))).alias("e"))
    rows = rows.select(F.explode(F.try_variant_get("e", "$.modelBreakdowns", "array<variant>")).alias("b"))
    b = F.col("b")
    rows = rows.select(V.text(b, "$.modelName").alias("name"), F.when(V.kind(V.at(b, "$.cost")).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(b, "$.cost", "double")).alias("cost")).where("name is not null and cost is not null")
    return rows.groupBy(usage.model_key(F.col("name")).alias("model_key")).agg(F.sum("cost").alias("cost_usd"))
