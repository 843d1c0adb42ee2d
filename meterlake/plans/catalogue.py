"""The queries of the ledger by name; each takes (spark, folder of tables)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import times, usage, variants
from meterlake.operators import audits, cache_window, canonical, diagnostics, metering, pricing, reconcile
from meterlake.operators.carry import carried
from meterlake.operators.filters import Filters
from meterlake.plans import dashboard
from meterlake.plans.testdata import NOW, Data
from meterlake.plans.testlogs import write_wires
from meterlake.schemas import COSTS, TOKENS
from meterlake.session import shared_path
from meterlake.sources import lines
from meterlake.streaming.reconcile import Reconciler

NY = "America/New_York"
FILTERED = Filters(from_ms=1704400000000, to_ms=1706000000000, provider="moonshotai", agent_type="main", time_zone=NY)
ONE = Filters(session_id="7")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AUDIT = ("2024-01-03", "2024-01-20", NY)


def query(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Data(spark, folder))
    return f


def _six(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, so that the order of additions doesn't show."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def summary(d: Data):
    return _six(dashboard.summary(d.ledger, Filters(time_zone=NY), NOW - 4 * times.DAY))


@query
def summary_filtered(d: Data):
    return _six(dashboard.summary(d.ledger, FILTERED, NOW - 14 * times.DAY))


@query
def timeseries_minute(d: Data):
    return dashboard.series(d.ledger, Filters(), "minute")


@query
def timeseries_hour(d: Data):
    return dashboard.series(d.ledger, Filters(), "hour")


@query
def timeseries_day_ny(d: Data):
    return dashboard.series(d.ledger, Filters(time_zone=NY), "day")


@query
def timeseries_week_ny(d: Data):
    return dashboard.series(d.ledger, FILTERED, "week")


@query
def timeseries_call(d: Data):
    return dashboard.series(d.ledger, ONE, "call")


@query
def auto_bucket(d: Data):
    return dashboard.time_range(d.ledger, FILTERED)


@query
def chart_rows_trailing(d: Data):
    return _six(dashboard.chart_rows(dashboard.series(d.ledger, ONE, "call", end=True), "call"))


@query
def chart_rows_hour(d: Data):
    return _six(dashboard.chart_rows(dashboard.series(d.ledger, Filters(), "hour", end=True), "hour"))


@query
def sessions_by_cost(d: Data):
    return dashboard.sorted_sessions(dashboard.sessions(d.ledger, Filters()), "cost")


@query
def sessions_recent(d: Data):
    return dashboard.sorted_sessions(dashboard.sessions(d.ledger, FILTERED), "recent")


@query
def sessions_start(d: Data):
    return dashboard.sorted_sessions(dashboard.sessions(d.ledger, Filters(workspace="ws-3")), "start")


@query
def sessions_private(d: Data):
    return dashboard.sessions(d.ledger, Filters(), private=True)


@query
def agents_in_session(d: Data):
    return dashboard.sorted_agents(dashboard.agents_of(d.ledger, "7", FILTERED_AGENTS))


FILTERED_AGENTS = Filters(from_ms=1704400000000, workspace="ignored", provider="ignored")


@query
def models(d: Data):
    return _six(dashboard.models(d.ledger, Filters()))


@query
def options_workspaces(d: Data):
    return dashboard.private_workspaces(dashboard.workspace_options(d.ledger))


@query
def options_models(d: Data):
    return dashboard.model_options(d.ledger, "moonshotai")


@query
def options_providers(d: Data):
    return dashboard.provider_options(d.ledger)


@query
def options_agents(d: Data):
    return dashboard.agent_options(d.ledger, "anthropic")


@query
def options_sessions(d: Data):
    return dashboard.session_options(d.ledger, NOW)


@query
def options_grouped(d: Data):
    return dashboard.grouped_options(dashboard.session_options(d.ledger, NOW, "moonshotai"))


@query
def archive_split(d: Data):
    return dashboard.archive_split_day(d.sessions, NOW)


@query
def health_counts(d: Data):
    return dashboard.health(d.ledger)


@query
def canonical_calls(d: Data):
    own = ["timestamp_ms", "provider", "raw_model", "session_id", "is_metered"]
    return d.canonical_with(*own).select("event_fingerprint", "canonical_source_path", "canonical_byte_offset", *own, *TOKENS)


@query
def replay_classification(d: Data):
    return diagnostics.replay_classes(d.classified, "1993-01-01", "1997-12-31")


@query
def replay_count(d: Data):
    return canonical.replays(d.classified, d.canonical).agg(F.count("*").alias("replays"))


def _with_replays(d: Data) -> dashboard.Ledger:
    calls = pricing.price(d.canonical, d.bundled)
    return dashboard.Ledger(calls, d.occurrence_sessions, d.occurrence_agents, d.bundled, d.classified)


@query
def summary_with_replays(d: Data):
    return dashboard.summary(_with_replays(d), Filters(), NOW).select("call_count", "input_tokens", "output_tokens", "replays_excluded")


@query
def sessions_with_replays(d: Data):
    return dashboard.sessions(_with_replays(d), Filters()).select("session_id", "call_count", "agent_count", "inherited_occurrences")


@query
def replay_by_session(d: Data):
    ledger = dashboard.Ledger(d.canonical, d.occurrence_sessions, d.occurrence_agents, d.rates, d.classified)
    return ledger.replays(Filters(provider="anthropic")).groupBy("session_id").agg(F.count("*").alias("replays"))


@query
def rate_best_match(d: Data):
    out = pricing.with_rate(d.occurrences.select("raw_model", "timestamp_ms"), d.rates)
    return out.groupBy("raw_model", F.col("_rate.rate_id").alias("rate_id")).agg(F.count("*").alias("occurrences"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


@query
def priced_calls(d: Data):
    return pricing.price(d.unpriced, d.rates).select("event_fingerprint", *COSTS, "rate_id", "resolved_model_key", "pricing_confidence", "pricing_basis")


@query
def reprice_totals(d: Data):
    new = pricing.price(d.unpriced, d.rates)
    return new.agg(F.count("*").alias("calls"), F.count_if(F.col("total_cost_nano").isNotNull()).alias("priced_calls"), F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced_calls"), F.coalesce(F.sum("total_cost_nano"), F.lit(0)).alias("total_cost_nano"))


@query
def sticky_price(d: Data):
    return pricing.sticky_price(d.unpriced, d.previous, d.rates).select("event_fingerprint", "total_cost_nano", "rate_id", "pricing_confidence")


@query
def metering_asof(d: Data):
    return metering.meter(d.raw_calls, d.states).select("event_fingerprint", "account_state_id", "is_metered", "metering_basis")


def _compared(d: Data):
    return audits.compared(d.calls, d.export, *AUDIT)


@query
def audit_usage_wide(d: Data):
    return _six(audits.wide(_compared(d)))


@query
def audit_usage_long(d: Data):
    return _six(audits.long(_compared(d)))


@query
def audit_model_deviation(d: Data):
    return _six(audits.largest(audits.deviations(_compared(d))))


@query
def audit_totals(d: Data):
    return _six(audits.totals(_compared(d)))


@query
def audit_gaps(d: Data):
    return audits.gaps(d.calls, *AUDIT)


@query
def audit_external_split(d: Data):
    return audits.external_split(d.external, d.calls)


@query
def audit_external(d: Data):
    return _six(audits.external_comparison(d.external, d.calls))


@query
def diag_hourly(d: Data):
    return diagnostics.hourly(d.calls, "2024-01-10")


@query
def diag_aborts(d: Data):
    c = d.raw_calls
    records = c.where("event_type <> 'error'").select(F.col("session_id").alias("path"), F.col("event_id").alias("byte_offset"), "timestamp_ms", F.when(F.col("event_id") % 10 != 0, (F.col("event_id") % 500).cast("string")).alias("provider_request_id"))
    kind = F.element_at(F.lit(["interrupted", "api-error", "streaming-snapshot"]), (F.col("event_id") % 3 + 1).cast("int"))
    return diagnostics.aborts(records, c.where("event_type = 'error'").select("timestamp_ms", kind.alias("kind")))


def _integrity(d: Data):
    bad = d.turns.where("not accepted").groupBy("path").agg(F.count("*").alias("malformed"))
    return diagnostics.session_integrity(d.turns.where("role = 'assistant'"), d.turns, bad, "2024-01-01")


@query
def diag_sessions(d: Data):
    return _integrity(d)


@query
def diag_suspects(d: Data):
    return diagnostics.suspects(_integrity(d))


@query
def chain_dangling(d: Data):
    return diagnostics.chains(d.turns)


@query
def cache_transitions(d: Data):
    return _six(cache_window.transitions(d.cache_calls).select("event_fingerprint", "session_id", "gap_ms", "kind", "reason", "cache_read_tokens", "previous_cache_read_tokens", "prompt_size_ratio", "intervening_global", "intervening_session"))


@query
def cache_exclusions(d: Data):
    return cache_window.exclusions(cache_window.transitions(d.cache_calls))


@query
def cache_gap_bands(d: Data):
    return cache_window.gap_bands(cache_window.transitions(d.cache_calls))


@query
def cache_change_point(d: Data):
    return cache_window.change_point(cache_window.transitions(d.cache_calls))


@query
def cache_hit_run(d: Data):
    return cache_window.longest_hit_run(cache_window.transitions(d.cache_calls))


@query
def cache_median(d: Data):
    return cache_window.miss_median(cache_window.transitions(d.cache_calls))


@query
def cache_sensitivity(d: Data):
    return cache_window.sensitivity(d.cache_calls)


@query
def carry_forward_identity(d: Data):
    """Usage lines with the step that precedes them and the request that they answer."""
    of = lambda role: F.when(F.col("role") == role, F.col("uuid"))
    turn = F.col("role") == "assistant"
    rows = carried(d.turns, of("system"), turn & F.col("accepted"), "step_uuid")
    return carried(rows, of("user"), turn, "request_uuid").where(turn & F.col("accepted")).select("path", "byte_offset", "step_uuid", "request_uuid")


@query
def missing_sources(d: Data):
    found = d.occurrence_sessions.where(F.col("session_id").cast("int") % 7 != 0).select(F.col("session_id").alias("source_path"))
    return reconcile.missing_sources(d.occurrences, found)


@query
def provider_and_model_key(d: Data):
    model = F.concat(F.element_at(F.lit(["moonshot-ai/", "Moonshot/", "claude-", "Other/a/", ""]), (F.col("event_id") % 5 + 1).cast("int")), F.lit("m"), (F.col("event_id") % 3).cast("string"))
    rows = d.events.select("event_id", model.alias("raw_model"))
    return rows.groupBy("raw_model", usage.provider_of(F.col("raw_model")).alias("provider"), usage.model_key(F.col("raw_model")).alias("model_key")).agg(F.count("*").alias("calls"))


@query
def fingerprint(d: Data):
    c = d.raw_calls
    id_, step = F.col("event_id").cast("string"), F.concat(F.lit("s"), F.col("event_id").cast("string"))
    made = usage.event_fingerprint(F.col("provider"), F.when(F.col("event_id") % 3 == 0, id_), F.when(F.col("event_id") % 3 == 1, step), F.col("raw_model"), F.when(F.col("event_id") % 2 == 0, F.lit("meta")), F.col("timestamp_ms"))
    return c.select("event_id", made.alias("event_fingerprint"))


@query
def hourly_activity(d: Data):
    """Calls per UTC day and hour, over all calls."""
    day = times.day_key(F.col("timestamp_ms")).alias("utc_day")
    return d.calls.groupBy(day, F.hour(F.timestamp_millis("timestamp_ms")).alias("utc_hour")).agg(F.count("*").alias("calls"))


@query
def jsonl_byte_offsets(d: Data):
    """Each conversation as a file of one line a turn and a tail without an end."""
    c = d.table("conversations").select("conv_id", F.struct("turn", F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]", " ").alias("t")).alias("s"))
    whole = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), F.lit("tail"))
    files = c.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.encode(whole, "UTF-8").alias("content"))
    return lines.split(files).select("path", "byte_offset", F.octet_length("line").cast("long").alias("bytes"))


#: Values of n in a record, whether they are a token count, and whether they are present.
TYPED = ["10", '"10"', "10.0", "10.5", "-1", "9007199254740992", "1e3", "true", "null", "[1]"]


@query
def variant_typing(d: Data):
    """What a JSON value counts for: numbers that are whole, safe and not negative."""
    n = F.element_at(F.lit([f'{{"n":{x}}}' for x in TYPED] + ["{}", "{bad"]), (F.col("event_id") % 12 + 1).cast("int"))
    v = variants.json(n)
    rows = d.events.select("event_id", variants.count(v, "$.n").alias("tokens"), F.coalesce(variants.present(v, "$.n"), F.lit(False)).alias("present"), variants.is_object(v).alias("readable"))
    return rows.groupBy((F.col("event_id") % 12).alias("kind"), "tokens", "present", "readable").agg(F.count("*").alias("events"))


@query
def stream_reconcile(d: Data):
    """events as wire logs, one a user, read as a stream into a store of canonical, priced calls."""
    logs = shared_path(d.spark, "logs")
    write_wires(d.raw_calls, logs)
    made = Reconciler(d.spark, shared_path(d.spark, "ledger"), d.sessions, d.bundled, d.states)
    made.start(logs, shared_path(d.spark, "checkpoint")).awaitTermination()
    return made.calls.select("event_fingerprint", "session_id", "timestamp_ms", "raw_model", *TOKENS, "total_cost_nano", "is_metered", "metering_basis")
