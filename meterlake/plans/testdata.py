"""The star schema's tables seen as a usage ledger, so that each operator can run on them."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators import canonical, pricing
from meterlake.operators.ordered import running
from meterlake.plans.dashboard import Ledger
from meterlake.schemas import ACCOUNT_STATE, TOKENS
from meterlake.session import configure
from meterlake.sources import catalogs

#: Account states: id, subscription, policy and beginning.
STATES = [(1, "pro", "pro-fable", 0), (2, "max", "subscription-excluded", 1704844800000), (3, "enterprise", "enterprise-api", 1705708800000)]
#: Models of events, by event_id modulo 4; the last has no rate.
MODELS = ["moonshot-ai/kimi-k3", "moonshot-ai/kimi-k2.6", "claude-fable-5", "claude-unknown"]
NOW = 1706745600000
#: Rates besides the bundled ones, as changes of a bundled row: an alias with a beginning, and a remote price.
OVERRIDE = {"rate_id": 14, "raw_alias": "moonshot-ai/kimi-k2.6", "input_nano_per_token": 700, "source_name": "user-override", "confidence": "override", "effective_at_ms": 820454400000}
REMOTE = {"rate_id": 15, "input_nano_per_token": 650, "source_name": "models.dev", "confidence": "inferred"}


def rate_rows() -> list[dict]:
    rows = catalogs.bundled_rows()
    by = {r["model_key"]: r for r in rows}
    return [*rows, by["kimi-k2.6"] | OVERRIDE, by["kimi-k2.5"] | REMOTE]


class Data:
    """Views over one folder of tables. The timestamps without a zone are read as UTC."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def rates(self) -> DataFrame:
        return catalogs.frame(self.spark, rate_rows())

    @cached_property
    def bundled(self) -> DataFrame:
        return catalogs.bundled(self.spark)

    @cached_property
    def states(self) -> DataFrame:
        return self.spark.createDataFrame(STATES, ACCOUNT_STATE)

    @cached_property
    def events(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select("event_id", "user_id", "event_type", "value", F.unix_millis(ts).alias("timestamp_ms"), F.unix_micros(ts).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))

    @cached_property
    def raw_calls(self) -> DataFrame:
        """events as calls that are neither priced nor metered."""
        e = self.events
        model = F.element_at(F.lit(MODELS), (F.col("event_id") % 4 + 1).cast("int"))
        agent = F.when(F.col("event_type").isin("click", "view"), "main").when(F.col("event_type").isin("purchase", "signup"), F.concat(F.lit("sub-"), (F.col("user_id") % 3).cast("string"))).otherwise("x")
        tokens = [F.col("k") * 10 + 1, F.col("event_id") % 7 * 20, F.col("event_id") % 5 * 10, F.col("event_id") % 3 * 10, F.col("k") * 1000, F.floor(F.col("value") * 100 + 0.5)]
        out = e.select("event_id", "event_type", F.concat(F.lit("request:"), F.col("event_id").cast("string")).alias("event_fingerprint"), "timestamp_ms", model.alias("raw_model"), *[t.cast("long").alias(c) for t, c in zip(tokens, TOKENS, strict=True)], F.col("user_id").cast("string").alias("session_id"), agent.alias("agent_id"))
        return out.withColumn("provider", F.when(F.col("event_id") % 4 < 2, "moonshotai").otherwise("anthropic"))

    @cached_property
    def calls(self) -> DataFrame:
        made = self.raw_calls.withColumn("is_metered", F.col("event_type") != "error").drop("event_id", "event_type")
        return pricing.price(made, self.bundled)

    @cached_property
    def sessions(self) -> DataFrame:
        own = self.events.groupBy("user_id").agg(F.min("timestamp_ms").alias("created_at_ms"), F.max("timestamp_ms").alias("updated_at_ms"))
        u = F.col("user_id")
        title = F.when(u % 5 != 0, F.concat(F.lit("  Session "), u.cast("string"), F.repeat(F.lit("  about costs"), (u % 7).cast("int"))))
        return own.select(u.cast("string").alias("session_id"), F.when(u % 2 == 0, "moonshotai").otherwise("anthropic").alias("provider"), F.concat(F.lit("ws-"), (u % 7).cast("string")).alias("workspace_key"), F.concat(F.lit("/home/ws-"), (u % 7).cast("string")).alias("work_directory"), title.alias("title"), "created_at_ms", "updated_at_ms")

    @cached_property
    def agents(self) -> DataFrame:
        own = self.raw_calls.select("session_id", "agent_id").distinct()
        kind = F.when(F.col("agent_id") == "main", "main").when(F.col("agent_id") == "x", "unknown").otherwise("sub")
        return own.select("session_id", "agent_id", F.col("agent_id").alias("agent_key"), F.concat(F.lit("Agent "), "agent_id").alias("agent_label"), kind.alias("agent_type"))

    @cached_property
    def ledger(self) -> Ledger:
        return Ledger(self.calls, self.sessions, self.agents, self.bundled)

    @cached_property
    def occurrences(self) -> DataFrame:
        """lineitem with orders as occurrences: a part of a supplier is a call, each order repeats it.

        A line's place in its session is its place in its order behind all lines of the session's orders
        before: lines are dealt by order alone, and only orders are summed along a session. Lines that differ in
        l_returnflag or l_linestatus alone, the last of the order, are equal occurrences: neither is sent."""
        lines = self.table("lineitem")
        o = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("_session"), "o_orderdate")
        sized = o.join(lines.groupBy("l_orderkey").agg(F.count("*").alias("_n")), "l_orderkey")
        upto = running(sized, F.col("l_orderkey"), 1 << 20, [], {"_upto": F.col("_n")}, by="_session")
        # places need the lines by order anyway: were they broadcast, the same shuffle would carry wider rows
        rows = lines.hint("merge").join(upto, "l_orderkey")
        session = F.col("_session")
        names = [r["model_key"] if r["provider"] == "anthropic" else f"moonshot-ai/{r['model_key']}" for r in catalogs.bundled_rows()]
        index = F.col("l_partkey") % 13
        own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        place = F.col("_upto") - F.col("_n") + F.row_number().over(own)
        tokens = [F.floor("l_quantity"), F.floor(F.col("l_discount") * 100 + 0.5), F.lit(0), F.lit(0), F.floor("l_extendedprice"), F.floor(F.col("l_tax") * 100 + 0.5)]
        request = F.concat(F.lit("p"), index.cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
        return rows.select(
            session.cast("string").alias("source_path"), F.lit(0).cast("long").alias("generation"), place.cast("long").alias("byte_offset"), F.concat(F.lit("request:"), request).alias("event_fingerprint"),
            F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp_ms"), F.when(index >= 10, "anthropic").otherwise("moonshotai").alias("provider"), F.element_at(F.lit(names), (index + 1).cast("int")).alias("raw_model"),
            *[t.cast("long").alias(c) for t, c in zip(tokens, TOKENS, strict=True)], session.cast("string").alias("session_id"), F.lit("main").alias("agent_id"), F.when(F.col("l_partkey") % 5 != 0, request).alias("provider_request_id"),
            F.lit(None).cast("long").alias("account_state_id"), (F.col("l_partkey") % 11 != 0).alias("is_metered"), F.lit("metered-api").alias("metering_basis"))

    @cached_property
    def occurrence_sessions(self) -> DataFrame:
        ids = self.spark.range(50)
        i = F.col("id")
        created = F.lit(788918400000) + i * 17 % 50 * 86_400_000
        return ids.select(i.cast("string").alias("session_id"), F.when(i % 2 == 0, "moonshotai").otherwise("anthropic").alias("provider"), F.concat(F.lit("ws-"), (i % 7).cast("string")).alias("workspace_key"), F.lit(None).cast("string").alias("work_directory"), F.lit(None).cast("string").alias("title"), created.alias("created_at_ms"), created.alias("updated_at_ms"))

    @cached_property
    def occurrence_agents(self) -> DataFrame:
        return self.occurrence_sessions.select("session_id", F.lit("main").alias("agent_id"), F.lit("main").alias("agent_key"), F.lit("Main").alias("agent_label"), F.lit("main").alias("agent_type"))

    def canonical_with(self, *keep: str) -> DataFrame:
        """Calls with these columns of their attribution. A line without part or supplier is no call."""
        rows = self.occurrences.where("event_fingerprint is not null")
        return canonical.canonicalize(rows, self.occurrence_sessions, known=True, keep=list(keep))

    @cached_property
    def canonical(self) -> DataFrame:
        return self.canonical_with(*canonical.PAYLOAD)

    @cached_property
    def unpriced(self) -> DataFrame:
        """Calls with what a price asks for."""
        return self.canonical_with("timestamp_ms", "raw_model")

    @cached_property
    def classified(self) -> DataFrame:
        return canonical.classified(self.occurrences, canonical.attributed(self.occurrences, self.occurrence_sessions, known=True))

    @cached_property
    def previous(self) -> DataFrame:
        """A ledger of before: two thirds of the calls, some with other usage, at bundled rates. They are
        told by fingerprint and time, which each call has, so both ledgers come from one aggregation."""
        part = F.when(F.col("timestamp_ms").isNotNull(), F.split("event_fingerprint", "[:-]")[2].cast("long"))
        rows = self.unpriced.where(part % 3 != 0)
        return pricing.price(rows.withColumn("output_tokens", F.col("output_tokens") + F.when(part % 4 == 0, 1).otherwise(0)), self.bundled)

    @cached_property
    def cache_calls(self) -> DataFrame:
        e = self.events.select("event_id", "user_id", "k", F.expr("us div 12000").alias("request_ms"))
        fp = F.concat(F.lit("request:"), F.col("event_id").cast("string"))
        gap = F.col("request_ms") - F.lag("request_ms").over(Window.partitionBy("user_id").orderBy("request_ms", fp))
        cold = F.coalesce(gap > 3_600_000, F.lit(False)) | (F.col("event_id") % 101 == 0)
        return e.select(F.col("user_id").cast("string").alias("session_id"), F.lit("main").alias("agent_id"), F.lit(MODELS[0]).alias("model"), "request_ms", F.col("request_ms").alias("usage_ms"), fp.alias("event_fingerprint"), F.when(cold, 18_000).otherwise(100_000 + F.col("k") * 10).cast("long").alias("cache_read_tokens"), F.when(cold, 83_000 + F.col("k") * 10).otherwise(500).cast("long").alias("input_other_tokens"), F.lit(None).cast("long").alias("message_count"), F.when(F.col("event_id") % 97 == 0, "sys-b").otherwise("sys-a").alias("system_prompt_hash"), F.lit("tools").alias("tools_hash"))

    @cached_property
    def turns(self) -> DataFrame:
        c = self.table("conversations")
        uuid = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
        t = F.col("turn")
        rows = c.where((F.col("conv_id") * 31 + t) % 17 != 0)
        return rows.select(F.col("conv_id").cast("string").alias("path"), t.cast("long").alias("byte_offset"), "role", uuid(t).alias("uuid"), F.when(t > 0, uuid(t - 1)).alias("parent_uuid"), (F.length("text") % 5 != 0).alias("accepted"), (F.lit(1704067200000) + F.col("conv_id") * 60_000 + t * 1000).alias("timestamp_ms"))

    @cached_property
    def export(self) -> DataFrame:
        """A usage export that differs from the ledger by the day, lacks one model and has another."""
        from meterlake.functions import times, usage

        own = self.calls.where("provider = 'anthropic' and is_metered").withColumns({"date": times.day_key(F.col("timestamp_ms")), "model_key": usage.model_key(F.col("raw_model"))})
        own = own.where("model_key = 'claude-fable-5' and date between '2024-01-03' and '2024-01-20'")
        off = F.dayofmonth(F.to_date("date")) % 3
        days = own.groupBy("date", "model_key").agg(F.sum("total_cost_nano").alias("c"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in TOKENS])
        made = days.select("date", "model_key", ((F.floor(F.col("c") / 10_000_000) + off * 25) / 100).alias("cost_usd"), (F.col("n") + off).alias("request_count"), (F.col("input_other_tokens") + off).alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read_tokens").alias("cache_read"), F.col("cache_creation_5m_tokens").alias("cache_write_5m"), (F.col("cache_creation_1h_tokens") + off).alias("cache_write_1h"))
        return made.unionByName(made.withColumn("model_key", F.lit("claude-haiku-4-5-20251001")))

    @cached_property
    def external(self) -> DataFrame:
        rows = [("claude-fable-5", 1250.5), ("claude-opus-5", 10.25), ("claude-unknown", 3.75)]
        return self.spark.createDataFrame(rows, "model_key string, cost_usd double")
