"""The dashboard's queries over a ledger. Each gives a DataFrame; nothing is collected here but
the two bounds that choose a resolution."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import labels, times, usage
from meterlake.operators import canonical
from meterlake.operators.filters import Filters, described, matching, visible
from meterlake.operators.ordered import numbered, running
from meterlake.operators.pricing import rate_columns
from meterlake.schemas import COSTS, TOKENS

PARTS = COSTS[:4]
#: Observations of a trailing average, and of a block that one task sorts.
TRAILING, BLOCK = 20, 1 << 16
#: A context is rebuilt if a prompt has this many tokens and this share of them isn't cached.
REBUILD_TOKENS, REBUILD_FRESH = 20_000, 0.5
#: Share of archived sessions that the newer group should hold.
NEWER_SHARE = 0.3


@dataclass(frozen=True)
class Ledger:
    """calls, sessions, agents and rates as in schemas; occurrences with is_canonical and
    replay_classification, where replays are asked for."""

    calls: DataFrame
    sessions: DataFrame
    agents: DataFrame
    rates: DataFrame
    occurrences: DataFrame | None = None

    def visible(self, filters: Filters) -> DataFrame:
        return visible(self.calls, self.sessions, self.agents, filters)

    def replays(self, filters: Filters) -> DataFrame:
        """Excluded replays that the filters let through, by the occurrence's own session and agent."""
        rows = canonical.replays(self.occurrences, self.calls)
        return matching(described(rows, self.sessions, self.agents), filters.conditions())


def _total(name: str, when=None):
    column = F.col(name) if when is None else F.when(when, F.col(name))
    return F.coalesce(F.sum(column), F.lit(0))


def summary(ledger: Ledger, filters: Filters, now_ms: int) -> DataFrame:
    """One row of totals. Today begins at the zone's midnight and has no end of its own; the
    active session is that updated last, of equal ones that of the latest call. On an empty
    ledger unpriced_calls is null and the rest 0."""
    rows = ledger.visible(filters)
    today = F.col("timestamp_ms") >= times.midnight_ms(now_ms, filters.time_zone)
    # sessions are few against calls: the active one is found among their sums, in the same pass
    per = rows.groupBy("session_id").agg(
        F.max(F.struct("updated_at_ms", "timestamp_ms")).alias("recency"), F.count("*").alias("n"), F.sum("total_cost_nano").alias("cost"), F.sum(F.when(today, F.col("total_cost_nano"))).alias("today"),
        F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced"), *[F.sum(c).alias(c) for c in [*TOKENS, *PARTS]])
    # unpriced: a sum over no rows is null, a count would be 0
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("call_count"), _total("cost").alias("total_cost_nano"), _total("today").alias("cost_today_nano"), F.sum("unpriced").alias("unpriced_calls"),
        F.coalesce(F.max_by("cost", F.struct("recency", "session_id")), F.lit(0)).alias("active_session_cost_nano"), *[_total(c).alias(c) for c in [*TOKENS, *PARTS]])
    out = out.withColumn("input_tokens", usage.prompt_tokens()).withColumn("cache_hit_ratio", usage.ratio(F.col("cache_read_tokens"), F.col("input_tokens")))
    out = out.select("call_count", "total_cost_nano", *PARTS, "cost_today_nano", "active_session_cost_nano", "unpriced_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_hit_ratio")
    if ledger.occurrences is None:
        return out
    return out.crossJoin(ledger.replays(filters).agg(F.count("*").alias("replays_excluded")))  # one row


def time_range(ledger: Ledger, filters: Filters) -> DataFrame:
    """One row: first and last call, and the resolution that fits them."""
    out = ledger.visible(filters).agg(F.min("timestamp_ms").alias("from_ms"), F.max("timestamp_ms").alias("to_ms"))
    return out.withColumn("resolution", times.automatic_bucket_column(F.col("from_ms"), F.col("to_ms")))


def resolution(ledger: Ledger, filters: Filters, now_ms: int) -> str:
    """call where a session is chosen, else the bucket asked for, else what fits the range."""
    if filters.session_id is not None:
        return "call"
    if filters.bucket != "auto":
        return filters.bucket
    low, high = filters.from_ms, filters.to_ms
    if low is None or high is None:
        found = time_range(ledger, filters).first()
        high = high if high is not None else found.to_ms if found.to_ms is not None else now_ms
        low = low if low is not None else found.from_ms if found.from_ms is not None else high - times.DAY
    return times.automatic_bucket(low, high)


def _measured(ledger: Ledger, filters: Filters) -> DataFrame:
    rows = rate_columns(ledger.visible(filters), ledger.rates)
    return rows.select("event_fingerprint", "timestamp_ms", *COSTS, "cache_read_tokens", usage.prompt_tokens().alias("prompt_tokens"), usage.main_prompt_tokens().alias("main"), usage.subagent_prompt_tokens().alias("sub"), usage.no_cache_extra_nano().alias("no_cache_extra_cost_nano"))


def series(ledger: Ledger, filters: Filters, bucket: str, end: bool = False) -> DataFrame:
    """A point per bucket, or per call, with costs, tokens, peaks and running sums; with end also
    the last total, end_total_cost_nano.

    bucket: minute, hour, day, week or call. Buckets without calls have no point."""
    rows = _measured(ledger, filters)
    zero = F.lit(0)
    if bucket == "call":
        points = rows.select("event_fingerprint", F.col("timestamp_ms").alias("bucket_start_ms"), F.lit(1).cast("long").alias("call_count"), *[F.coalesce(c, zero).alias(c) for c in [*COSTS, "no_cache_extra_cost_nano"]], "cache_read_tokens", "prompt_tokens", F.coalesce("main", zero).alias("peak_main_prompt_tokens"), F.coalesce("sub", zero).alias("peak_subagent_prompt_tokens"), F.when(F.col("total_cost_nano").isNull(), 1).otherwise(0).cast("long").alias("unpriced_calls"))
        return cumulative(points, ["event_fingerprint"], times.HOUR, end)
    points = rows.groupBy(times.bucket_start_ms(F.col("timestamp_ms"), bucket, filters.time_zone).alias("bucket_start_ms")).agg(
        F.count("*").alias("call_count"), *[_total(c).alias(c) for c in [*COSTS, "no_cache_extra_cost_nano", "cache_read_tokens", "prompt_tokens"]],
        F.coalesce(F.max("main"), zero).alias("peak_main_prompt_tokens"), F.coalesce(F.max("sub"), zero).alias("peak_subagent_prompt_tokens"), F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced_calls"))
    return cumulative(points, [], None, end)


def cumulative(points: DataFrame, ties: list[str], chunk: int | None, end: bool = False) -> DataFrame:
    """Adds observation (from 0) and the running costs; the total is the sum of its parts.

    chunk: milliseconds that are summed up by themselves; None where the points are sums over time
    already, whose number grows with the span of time and not with the calls: these are one task's."""
    sums = {f"cumulative_{c}": F.col(c) for c in [*PARTS, "no_cache_extra_cost_nano"]}
    total = sum((F.col(c) for c in PARTS[1:]), F.col(PARTS[0]))
    if chunk is None:
        order = Window.orderBy("bucket_start_ms", *ties).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.orderBy("bucket_start_ms", *ties).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = points.withColumns({k: F.sum(x).over(order) for k, x in sums.items()} | {"observation": F.row_number().over(Window.orderBy("bucket_start_ms", *ties)).cast("long") - 1} | ({"end_total_cost_nano": F.sum(total).over(whole)} if end else {}))
    else:
        out = running(points, F.col("bucket_start_ms"), chunk, ties, sums, "observation", {"end_total_cost_nano": total} if end else None)
    out = out.withColumn("cumulative_total_cost_nano", sum((F.col(f"cumulative_{c}") for c in PARTS[1:]), F.col(f"cumulative_{PARTS[0]}")))
    return out.withColumn("cumulative_no_cache_cost_nano", F.col("cumulative_total_cost_nano") + F.col("cumulative_no_cache_extra_cost_nano")).drop("cumulative_no_cache_extra_cost_nano")


def timeseries(ledger: Ledger, filters: Filters, now_ms: int) -> DataFrame:
    return series(ledger, filters, resolution(ledger, filters, now_ms)).orderBy("bucket_start_ms", "observation")


def chart_rows(points: DataFrame, resolution: str) -> DataFrame:
    """Points (with their end) with trailing average cost and hit ratio, idle gaps, rebuilt contexts
    and what remains to the end.

    Blocks of observations are sorted by themselves; each also gets the last rows of the block
    before it, so that no task holds the whole series and none is computed twice."""
    block, place = F.floor(F.col("observation") / BLOCK), F.pmod("observation", F.lit(BLOCK))
    ghost = place >= BLOCK - TRAILING + 1
    rows = points.withColumn("_in", F.explode(F.when(ghost, F.array(F.struct(block.alias("b"), F.lit(False).alias("g")), F.struct((block + 1).alias("b"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("g"))))))
    order = Window.partitionBy("_in.b").orderBy("observation")
    trail = order.rowsBetween(1 - TRAILING, 0)
    idle = F.greatest(F.col("bucket_start_ms") - F.col("_before_ms") - times.SPACING.get(resolution, 0), F.lit(0))
    rows = rows.withColumns({"_total": F.sum("total_cost_nano").over(trail), "_read": F.sum("cache_read_tokens").over(trail), "_prompt": F.sum("prompt_tokens").over(trail), "_before_ms": F.lag("bucket_start_ms").over(order)}).where("not _in.g")
    fresh = usage.ratio(F.col("prompt_tokens") - F.col("cache_read_tokens"), F.col("prompt_tokens"))
    rebuilt = (F.lit(resolution == "call")) & (F.col("peak_main_prompt_tokens") > 0) & (F.col("prompt_tokens") >= REBUILD_TOKENS) & (fresh >= REBUILD_FRESH)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return rows.select(
        "observation", "bucket_start_ms", "total_cost_nano", (F.col("_total") / F.least(F.col("observation") + 1, F.lit(TRAILING))).alias("trailing_average_nano"), usage.ratio(F.col("_read"), F.col("_prompt")).alias("trailing_hit_ratio"),
        usage.ratio(F.col("cache_read_tokens"), F.col("prompt_tokens")).alias("hit_ratio"), F.when(idle >= times.HOUR, idle).otherwise(0).alias("idle_gap_ms"), rebuilt.cast("int").alias("context_rebuild"),
        positive("peak_main_prompt_tokens").alias("context_main"), positive("peak_subagent_prompt_tokens").alias("context_subagent"), (F.col("end_total_cost_nano") - F.col("cumulative_total_cost_nano")).alias("remaining_nano"))


def sessions(ledger: Ledger, filters: Filters, private: bool = False) -> DataFrame:
    """A row per session with calls; agent_count is of all its agents, whatever the filters."""
    rows = ledger.visible(filters)
    own = rows.groupBy("session_id").agg(F.max("timestamp_ms").alias("last_call_at_ms"), F.count("*").alias("call_count"), _total("total_cost_nano").alias("total_cost_nano"), F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced_calls"))
    agents = ledger.agents.groupBy("session_id").agg(F.count("*").alias("agent_count"))
    out = own.join(ledger.sessions.select("session_id", "workspace_key", "work_directory", "title", "created_at_ms"), "session_id").join(agents, "session_id", "left")
    again = F.lit(0).cast("long")
    if ledger.occurrences is not None:
        out = out.join(ledger.replays(filters).groupBy("session_id").agg(F.count("*").alias("_replays")), "session_id", "left")
        again = F.coalesce("_replays", F.lit(0))
    hide = lambda text, c: F.lit(text) if private else F.col(c)
    return out.select("session_id", hide("Hidden workspace", "workspace_key").alias("workspace_key"), hide(None, "work_directory").cast("string").alias("work_directory"), hide("Hidden session", "title").alias("title"), "created_at_ms", "last_call_at_ms", "call_count", "total_cost_nano", "unpriced_calls", F.coalesce("agent_count", F.lit(0)).alias("agent_count"), again.alias("inherited_occurrences"))


def sorted_sessions(rows: DataFrame, sort: str) -> DataFrame:
    by = {"cost": "total_cost_nano", "recent": "last_call_at_ms", "start": "created_at_ms"}[sort]
    return rows.orderBy(F.desc(by), "session_id")


def agents_of(ledger: Ledger, session_id: str, filters: Filters) -> DataFrame:
    """A session's agents by role, with their metered calls."""
    own = ledger.agents.where(F.col("session_id") == session_id)
    calls = ledger.calls.where((F.col("session_id") == session_id) & F.col("is_metered"))
    rows = matching(calls.join(own, ["session_id", "agent_id"]), filters.drilldown())
    return rows.groupBy("session_id", "agent_key", "agent_type").agg(F.min("agent_label").alias("agent_label"), F.count("*").alias("call_count"), _total("total_cost_nano").alias("total_cost_nano"), F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced_calls"))


def sorted_agents(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.when(F.col("agent_type") == "main", 0).when(F.col("agent_type") == "sub", 1).otherwise(2), "agent_label", "agent_key")


def models(ledger: Ledger, filters: Filters) -> DataFrame:
    """Per model, resolved key, confidence and basis: calls, tokens, cost and rates in dollars a million."""
    names = {"input_nano_per_token": "input_usd_per_million", "cache_creation_nano_per_token": "cache_creation_usd_per_million", "cache_creation_5m_nano_per_token": "cache_creation_5m_usd_per_million", "cache_creation_1h_nano_per_token": "cache_creation_1h_usd_per_million", "cache_read_nano_per_token": "cache_read_usd_per_million", "output_nano_per_token": "output_usd_per_million"}
    rows = ledger.visible(filters).groupBy("raw_model", "resolved_model_key", "pricing_confidence", "pricing_basis", "rate_id").agg(F.count("*").alias("n"), F.sum("total_cost_nano").alias("cost"), F.sum(usage.all_tokens()).alias("tokens"), F.count_if(F.col("total_cost_nano").isNull()).alias("unpriced"))
    rows = rows.join(ledger.rates.select("rate_id", *names), "rate_id", "left")
    return rows.groupBy("raw_model", "resolved_model_key", "pricing_confidence", "pricing_basis").agg(F.sum("n").alias("call_count"), _total("cost").alias("total_cost_nano"), F.sum("tokens").alias("total_tokens"), F.sum("unpriced").alias("unpriced_calls"), *[usage.nano_to_usd_per_million(F.max(c)).alias(n) for c, n in names.items()])


def _metered(ledger: Ledger, provider: str | None) -> DataFrame:
    own = ledger.sessions.select("session_id", "workspace_key", F.col("provider").alias("session_provider"))
    rows = ledger.calls.where("is_metered").join(own, "session_id")
    return rows if provider is None else rows.where(F.col("session_provider") == provider)


def workspace_options(ledger: Ledger, provider: str | None = None) -> DataFrame:
    return _metered(ledger, provider).select(F.col("workspace_key").alias("value")).distinct()


def private_workspaces(options: DataFrame) -> DataFrame:
    """Workspace 1, Workspace 2 and so on instead of names; the options are one row a workspace."""
    spread = running(options, F.xxhash64(F.lit(0)), 1, ["value"], {}, "_n")
    return spread.select(F.concat(F.lit("Workspace "), (F.col("_n") + 1).cast("string")).alias("label"), "value")


def model_options(ledger: Ledger, provider: str | None = None) -> DataFrame:
    return _metered(ledger, provider).select(F.col("raw_model").alias("value")).distinct()


def provider_options(ledger: Ledger) -> DataFrame:
    """Providers of calls, whatever provider is chosen."""
    found = ledger.calls.where("is_metered").select(F.col("provider").alias("value")).distinct()
    return found.select("value", labels.provider_label(F.col("value")).alias("label"))


def agent_options(ledger: Ledger, provider: str | None = None) -> DataFrame:
    rows = _metered(ledger, provider).select("session_id", "agent_id").distinct().join(ledger.agents, ["session_id", "agent_id"])
    return rows.groupBy(F.col("agent_key").alias("value")).agg(F.min("agent_label").alias("label"))


def archive_split_day(spending: DataFrame, now_ms: int) -> DataFrame:
    """One row: the age in days that puts nearest to NEWER_SHARE of the archived sessions in the
    newer group. The greatest age is no candidate unless it is the only one; without any: 1.

    Ages are counted first: the window is over distinct days."""
    ages = spending.select(times.age_days(F.col("updated_at_ms"), now_ms).alias("age")).where("age >= 1").groupBy("age").agg(F.count("*").alias("n"))
    counted = running(ages, F.col("age"), 1 << 12, [], {"upto": F.col("n")})
    whole = ages.agg(F.sum("n").alias("total"), F.max("age").alias("oldest"), F.count("*").alias("kinds"))
    near = counted.crossJoin(whole).where("age < oldest or kinds = 1")  # one row
    best = near.agg(F.min_by("age", F.struct(F.abs(F.col("upto") / F.col("total") - NEWER_SHARE), "age")).alias("d"))
    return best.select(F.coalesce("d", F.lit(1)).alias("split_day"))


def session_options(ledger: Ledger, now_ms: int, provider: str | None = None, private: bool = False) -> DataFrame:
    """Sessions that cost anything, with label, recency group and rank; in_option_order() sorts them."""
    own = ledger.sessions if provider is None else ledger.sessions.where(F.col("provider") == provider)
    cost = ledger.calls.where("is_metered").groupBy("session_id").agg(F.sum("total_cost_nano").alias("total_cost_nano"))
    spending = own.join(cost, "session_id").where("total_cost_nano > 0")
    rows = spending.crossJoin(archive_split_day(spending, now_ms))  # one row
    rows = rows.withColumn("age_days", times.age_days(F.col("updated_at_ms"), now_ms))
    rows = rows.withColumns({"recency_rank": labels.recency_rank(F.col("age_days"), F.col("split_day")), "recency_group": labels.recency_group(F.col("age_days"), F.col("split_day"))})
    title, project = F.coalesce("title", "session_id"), F.col("workspace_key")
    if private:
        order = [F.desc("total_cost_nano"), F.desc("updated_at_ms"), "session_id"]
        rows = running(rows, F.col("recency_rank"), 1, order, {}, "_n")
        title, project = F.concat(F.lit("Session "), (F.col("_n") + 1).cast("string")), F.lit("Hidden project")
    label = labels.session_option(F.col("updated_at_ms"), F.col("total_cost_nano"), title, project, now_ms)
    return rows.select(F.col("session_id").alias("value"), label.alias("label"), "provider", F.col("workspace_key").alias("workspace"), "recency_group", "recency_rank", "total_cost_nano", "updated_at_ms")


def in_option_order(options: DataFrame) -> DataFrame:
    return options.orderBy("recency_rank", F.desc("total_cost_nano"), F.desc("updated_at_ms"), "value")


def grouped_options(options: DataFrame) -> DataFrame:
    """Counts and first option of each recency group, in order."""
    order = F.struct(-F.col("total_cost_nano"), -F.col("updated_at_ms"), "value")
    return options.groupBy("recency_rank", "recency_group").agg(F.count("*").alias("options"), F.min_by("value", order).alias("first_option"))


def ordered_options(options: DataFrame) -> DataFrame:
    """All options with their place in their recency group and in the whole list, both from 0."""
    order = [F.col("recency_rank").asc(), F.desc("total_cost_nano"), F.desc("updated_at_ms"), F.col("value").asc()]
    rows = numbered(options, order, "position")
    first = rows.groupBy("recency_rank").agg(F.min("position").alias("_first"))
    return rows.join(first, "recency_rank").withColumn("group_position", F.col("position") - F.col("_first")).drop("_first")


def in_collated_order(options: DataFrame, column: str = "value", collation: str = "UNICODE") -> DataFrame:
    """Options with their position by the rules of a collation; texts that it takes for equal by code points."""
    return numbered(options, [F.collate(F.col(column), collation).asc(), F.col(column).asc()], "position")


def health(ledger: Ledger) -> DataFrame:
    """One row of counts: of calls and sessions those that are metered, as the dashboard shows them."""
    metered, cost = F.col("is_metered"), F.col("total_cost_nano")
    own = ledger.calls.agg(
        F.count_if(metered).alias("calls"),
        F.count_distinct(F.when(metered, F.col("session_id"))).alias("sessions"),
        F.count("*").alias("all_calls"),
        F.count_if(metered & cost.isNull()).alias("unpriced_calls"),
        F.min(F.when(metered, F.col("timestamp_ms"))).alias("first_call_ms"),
        F.max(F.when(metered, F.col("timestamp_ms"))).alias("last_call_ms"),
    )
    agents = ledger.agents.agg(F.count("*").alias("agents"), F.count_if(F.col("agent_type") == "sub").alias("subagents"))
    return own.crossJoin(agents)  # one row each
