"""Diagnostics of logs: replays, chains of records, hours, turns that did not finish."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import times


def replay_classes(occurrences: DataFrame, start: str, end: str, provider: str = "anthropic") -> DataFrame:
    """Metered occurrences per UTC day and model by classification."""
    rows = occurrences.where((F.col("provider") == provider) & F.col("is_metered")).withColumn("utc_day", times.day_key(F.col("timestamp_ms"))).where(F.col("utc_day").between(start, end))
    kinds = {"original": "canonical", "fork-replay": "fork_replay", "possible-replay": "possible_replay", "superseded-usage": "superseded"}
    return rows.groupBy("utc_day", "raw_model").agg(*[F.count_if(F.col("replay_classification") == k).alias(n) for k, n in kinds.items()])


def chains(records: DataFrame) -> DataFrame:
    """roots and dangling per path: records without a parent, and with one that the same file lacks.

    records: path, uuid, parent_uuid. A record without a uuid is nobody's parent but counts."""
    known = records.where("uuid is not null").select("path", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("_there")).distinct()
    rows = records.join(known, ["path", "parent_uuid"], "left")
    return rows.groupBy("path").agg(F.count_if(F.col("parent_uuid").isNull()).alias("roots"), F.count_if(F.col("parent_uuid").isNotNull() & F.col("_there").isNull()).alias("dangling"))


def session_integrity(records: DataFrame, links: DataFrame, malformed: DataFrame, day: str) -> DataFrame:
    """Files with records on a UTC day: first and last time, calls, roots, dangling parents and malformed lines.

    records: path, timestamp_ms; links: path, uuid, parent_uuid; malformed: path, malformed."""
    on = records.where(times.day_key(F.col("timestamp_ms")) == day).groupBy("path").agg(times.time_of_day(F.min("timestamp_ms")).alias("first_utc"), times.time_of_day(F.max("timestamp_ms")).alias("last_utc"), F.count("*").alias("calls_on_day"))
    out = on.join(chains(links), "path", "left").join(malformed, "path", "left")
    return out.select("path", "first_utc", "last_utc", "calls_on_day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("roots", "dangling", "malformed")])


def suspects(integrity: DataFrame) -> DataFrame:
    """One row: files that lost records."""
    return integrity.agg(F.count_if((F.col("dangling") > 0) | (F.col("roots") > 1) | (F.col("malformed") > 0)).alias("suspect_sessions"))


def aborts(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Per UTC day: records, distinct requests, and markers of turns that did not finish.

    records: path, byte_offset, timestamp_ms, provider_request_id; markers: timestamp_ms, kind."""
    day = times.day_key(F.col("timestamp_ms")).alias("utc_day")
    request = F.coalesce("provider_request_id", F.concat("path", F.lit("#"), F.col("byte_offset").cast("string")))
    seen = records.groupBy(day).agg(F.countDistinct(request).alias("distinct_requests"), F.count("*").alias("occurrences"))
    kinds = {"interrupted": "interrupted", "api-error": "api_error", "streaming-snapshot": "streaming_snapshot"}
    marks = markers.groupBy(day).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()])
    return seen.join(marks, "utc_day", "full").na.fill(0)


def hourly(records: DataFrame, day: str) -> DataFrame:
    """Calls in each of a UTC day's 24 hours."""
    on = records.where(times.day_key(F.col("timestamp_ms")) == day)
    counts = on.groupBy(F.hour(F.timestamp_millis("timestamp_ms")).alias("_h")).agg(F.count("*").alias("n"))
    spine = records.sparkSession.range(24).select(F.col("id").cast("int").alias("_h"))
    return spine.join(counts, "_h", "left").select(F.lpad(F.col("_h").cast("string"), 2, "0").alias("utc_hour"), F.coalesce("n", F.lit(0)).alias("calls"))
