"""Queries that read logs, state files, catalogs and exports: files made from the test tables, by the parsers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import times
from meterlake.operators import reconcile
from meterlake.plans.catalogue import query
from meterlake.plans.testdata import Data
from meterlake.plans.testlogs import write_requests, write_states, write_transcripts
from meterlake.schemas import RATES, TOKENS
from meterlake.session import shared_path
from meterlake.sources import catalogs, claude, exports, kimi, lines
from meterlake.streaming.reconcile import Reconciler

_RATE = ["provider", "model_key", "raw_alias", *RATES, "source_name", "confidence", "effective_at_ms"]


def _transcripts(d: Data) -> str:
    folder = shared_path(d.spark, "transcripts")
    write_transcripts(d.raw_calls, d.sessions, folder)
    return folder


def _text(d: Data, folder: str, tail: bool = False) -> DataFrame:
    return lines.texts(lines.read(d.spark, folder, tail=tail))


@query
def claude_usage(d: Data):
    found = claude.placed(claude.usage_records(_text(d, _transcripts(d))))
    return found.select("project", "session_id", "agent_id", "model", "provider_request_id", "step_uuid", "request_metadata", "timestamp_ms", *TOKENS)


@query
def claude_malformed(d: Data):
    found = claude.placed(claude.malformed(_text(d, _transcripts(d))))
    return found.select("session_id", "agent_id", "malformed")


@query
def claude_sessions(d: Data):
    return claude.session_rows(d.spark, _transcripts(d))


@query
def claude_agents(d: Data):
    return claude.agents(_text(d, _transcripts(d)))


@query
def claude_scan(d: Data):
    """Markers of every line, counted by file."""
    rows = claude.scan(_text(d, _transcripts(d), tail=True))
    by_path = rows.groupBy("path", "kind").agg(F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"), F.max("timestamp_ms").alias("last_ms"))
    return claude.placed(by_path).groupBy("session_id", "agent_id", "kind").agg(F.sum("lines").alias("lines"), F.sum("malformed").alias("malformed"), F.max("last_ms").alias("last_ms"))


@query
def stream_reconcile_claude(d: Data):
    """events as transcripts, read as a stream into a store of canonical, priced calls."""
    made = Reconciler(d.spark, shared_path(d.spark, "ledger"), d.sessions, d.bundled, d.states)
    made.start(_transcripts(d), shared_path(d.spark, "checkpoint")).awaitTermination()
    return made.calls.select("event_fingerprint", "session_id", "agent_id", "timestamp_ms", "raw_model", *TOKENS, "total_cost_nano", "is_metered", "metering_basis")


def _states(d: Data) -> DataFrame:
    folder = shared_path(d.spark, "states")
    write_states(d.sessions, d.agents, folder)
    return lines.files(d.spark, folder, "state.json")


@query
def kimi_states(d: Data):
    return kimi.states(_states(d))


@query
def kimi_state_agents(d: Data):
    """Agents of state files with those that have a log: here main, and the first subagent."""
    found = d.agents.where("agent_id in ('main', 'sub-0')").select("session_id", "agent_id", F.lit("log").alias("source_path"))
    return reconcile.merged_agents(kimi.state_agents(_states(d)), found)


@query
def kimi_requests(d: Data):
    """Usage records with the request that they answer."""
    folder = shared_path(d.spark, "wires")
    write_requests(d.raw_calls, folder)
    text = lines.texts(lines.read(d.spark, folder, "wire.jsonl"))
    used = kimi.placed(kimi.usage_records(text)).select("path", "byte_offset", "session_id", "model", "timestamp_ms", "output_tokens")
    return used.join(kimi.requests(text), ["path", "byte_offset"], "left").drop("path", "byte_offset")


def _nations(d: Data) -> DataFrame:
    """A price of its own for each of the 25 nations."""
    k = F.col("n_nationkey").cast("long")
    return d.table("nation").select(k.alias("k"), ((k + 1) * 0.25).alias("given"), (k * 1.5).alias("out"), F.when(k % 2 == 0, k * 0.125).alias("read"), F.when(k % 3 == 0, k * 0.5).alias("write"))


def _document(entries: DataFrame, value, wrap) -> DataFrame:
    """One row with content: entries (name, ...) as an object of value by name."""
    made = entries.agg(F.map_from_entries(F.collect_list(F.struct("name", value))).alias("m"))
    return made.select(F.to_json(wrap(F.col("m"))).alias("content"))


@query
def catalog_models_dev(d: Data):
    n = _nations(d).withColumn("name", F.concat(F.lit("kimi-n"), F.col("k").cast("string")))
    cost = F.struct(F.col("given").alias("input"), F.when(F.col("k") % 5 != 4, F.col("out")).alias("output"), F.col("read").alias("cache_read"), F.col("write").alias("cache_write"))
    models = lambda m: F.struct(F.struct(m.alias("models")).alias("moonshotai"), F.struct(m.alias("models")).alias("other"))
    return catalogs.models_dev(_document(n, F.struct(cost.alias("cost")), models)).select(*_RATE)


@query
def catalog_litellm(d: Data):
    k = F.col("k")
    name = F.concat(F.when(k % 4 == 3, "other/").otherwise("moonshot/"), F.lit("kimi-n"), k.cast("string"))
    million = lambda c: F.col(c) / 1_000_000
    cost = F.struct(million("given").alias("input_cost_per_token"), million("out").alias("output_cost_per_token"), million("read").alias("cache_read_input_token_cost"), million("write").alias("cache_creation_input_token_cost"))
    return catalogs.litellm(_document(_nations(d).withColumn("name", name), cost, lambda m: m)).select(*_RATE)


@query
def catalog_overrides(d: Data):
    """An overrides file of 25 aliases, under pricingOverrides."""
    k = F.col("k")
    prefix = F.when(k % 3 == 0, "moonshot-ai/kimi-n").when(k % 3 == 1, "claude-n").otherwise("plain-n")
    million = lambda c: F.col(c) / 1_000_000
    entry = F.struct(million("given").alias("inputCostPerToken"), million("out").alias("outputCostPerToken"), million("read").alias("cacheReadInputTokenCost"), million("write").alias("cacheCreation5mInputTokenCost"), F.when(k % 4 == 0, k * 86_400_000).alias("effectiveAt"))
    text = _document(_nations(d).withColumn("name", F.concat(prefix, k.cast("string"))), entry, lambda m: F.struct(m.alias("pricingOverrides"))).first().content
    return catalogs.overrides(d.spark, text).select(*_RATE)


@query
def catalog_vendor(d: Data):
    """A price table of the models that have a key, each at the prices of a nation."""
    names = sorted(catalogs.VENDOR_MODELS)
    rows = {r.k: r for r in _nations(d).collect()}
    cell = lambda x: f"${x:g} / MTok"
    table = [catalogs.VENDOR_COLUMNS, ["---"] * 6]
    table += [[f"[{name}](/models)", *map(cell, (rows[i].given, rows[i].given * 1.25, rows[i].given * 2, rows[i].given / 8, rows[i].out))] for i, name in enumerate(names)]
    text = "# Prices\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in table) + "\n\nEnd.\n"
    made = catalogs.vendor_markdown(d.spark, text)
    return made.select("rate_id", "provider", *RATES, "source_name", "confidence")


def _days(d: Data) -> DataFrame:
    own = d.events.groupBy(times.day_key(F.col("timestamp_ms")).alias("date"), "event_type")
    return own.agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query
def export_days(d: Data):
    """A usage export for each type of event, a row for each of its days."""
    tokens = F.struct(F.col("k").alias("input"), (F.col("k") * 2).alias("output"), (F.col("k") * 3).alias("cache_read"), F.col("n").alias("cache_write_5m"), (F.col("n") * 2).alias("cache_write_1h"))
    day = F.struct(F.col("date").alias("bucket"), F.concat(F.lit("claude_"), "event_type").alias("group_key"), (F.col("k") * 25).alias("cost_minor_units"), F.col("n").alias("request_count"), tokens.alias("tokens"))
    head = [F.lit(v).alias(k) for k, v in exports.LITERALS.items()]
    made = _days(d).groupBy("event_type").agg(F.collect_list(day).alias("series"))
    return exports.usage_days(made.select(F.to_json(F.struct(*head, "series")).alias("content")))


def _reports(d: Data) -> DataFrame:
    cost = F.struct(F.concat(F.lit("vendor/claude-"), "event_type").alias("modelName"), (F.col("k") * 0.25).alias("cost"))
    day = F.struct("date", (F.col("k") * 0.25).alias("totalCost"), F.array(cost).alias("modelBreakdowns"))
    made = _days(d).groupBy("event_type").agg(F.collect_list(day).alias("daily"))
    return made.select(F.to_json(F.struct("daily")).alias("content"))


@query
def report_models(d: Data):
    return exports.report_models(_reports(d))


@query
def report_totals(d: Data):
    return exports.report_total(_reports(d))
