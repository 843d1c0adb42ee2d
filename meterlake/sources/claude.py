"""Transcripts of the claude family."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import labels
from meterlake.functions import variants as V
from meterlake.schemas import AGENT, SESSION, TOKENS
from meterlake.sources import lines

#: <root>/projects/<project>/<session>.jsonl, and <session>/subagents/agent-<id>.jsonl below it
MAIN = r"(?i)/projects/([^/]+)/([^/]+)\.jsonl$"
SUB = r"(?i)/projects/([^/]+)/([^/]+)/subagents/(?:agent-)?([^/]+)\.jsonl$"
#: Bytes of a subagent's file that tell who it is.
IDENTITY_BYTES = 262_144


def placed(df: DataFrame) -> DataFrame:
    """Adds project, session_id and agent_id by path; other paths go."""
    sub = F.col("path").rlike(SUB)
    part = lambda i: F.when(sub, F.regexp_extract("path", SUB, i)).otherwise(F.regexp_extract("path", MAIN, i))
    rows = df.where(sub | F.col("path").rlike(MAIN))
    return rows.withColumns({"project": part(1), "session_id": F.concat(F.lit("anthropic:"), part(2)), "agent_id": F.when(sub, F.regexp_extract("path", SUB, 3)).otherwise("main")})


def of_sessions(path: Column) -> Column:
    """Whether a path is that of a session's own transcript; sessions() takes nothing from others."""
    return path.rlike(MAIN) & ~path.rlike(SUB)


def _relevant(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.col("text").isNull() | F.col("text").contains('"assistant"') & F.col("text").contains('"usage"'))
    return V.once(V.once(rows, v=V.json(F.col("text"))), bad=~V.is_object(F.col("v")))


def malformed(lines: DataFrame) -> DataFrame:
    """Unreadable lines per path, and those that are no object; lines about something else don't count."""
    return _relevant(lines).groupBy("path").agg(F.count_if("bad").alias("malformed"))


def usage_records(lines: DataFrame) -> DataFrame:
    """Usage of assistant messages. Counts of cache writes with a lifetime may not exceed the total;
    what they leave is untyped. A lifetime that is absent is 0, one that is no count drops the row."""
    v = F.col("v")
    rows = _relevant(lines).where(~F.col("bad"))
    use = "$.message.usage"
    optional = lambda path: F.when(V.present(v, path), V.count(v, path)).otherwise(F.lit(0).cast("long"))
    typed = V.is_object(V.at(v, f"{use}.cache_creation"))
    hour, short = (F.when(typed, optional(f"{use}.cache_creation.ephemeral_{k}_input_tokens")).otherwise(F.lit(0).cast("long")) for k in ("1h", "5m"))
    message = V.filled(v, "$.message.id")
    rows = V.once(rows, **{"request_metadata": message, "provider_request_id": F.coalesce(V.filled(v, "$.requestId"), message), "step_uuid": V.filled(v, "$.uuid"), "_type": V.text(v, "$.type"), "model": V.filled(v, "$.message.model"), "timestamp_ms": V.time_ms(v, "$.timestamp"), "_total": V.count(v, f"{use}.cache_creation_input_tokens"), "cache_creation_1h_tokens": hour, "cache_creation_5m_tokens": short, "input_other_tokens": V.count(v, f"{use}.input_tokens"), "cache_read_tokens": V.count(v, f"{use}.cache_read_input_tokens"), "output_tokens": V.count(v, f"{use}.output_tokens")})
    rows = rows.withColumn("cache_creation_tokens", F.col("_total") - F.col("cache_creation_1h_tokens") - F.col("cache_creation_5m_tokens"))
    total = sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))
    rows = rows.where((F.col("_type") == "assistant") & F.col("model").isNotNull() & (F.col("model") != "<synthetic>") & F.col("timestamp_ms").isNotNull() & (F.col("cache_creation_tokens") >= 0) & (total > 0))
    return rows.select("path", "byte_offset", "model", "provider_request_id", "step_uuid", "request_metadata", "timestamp_ms", *TOKENS)


def sessions(lines: DataFrame, modified: DataFrame) -> DataFrame:
    """A row per transcript: first and last time, last title and directory. Without any time the
    file's own counts (modified: path, modified_ms)."""
    v = F.col("v")
    rows = lines.where(of_sessions(F.col("path"))).withColumn("v", V.json(F.col("text")))
    rows = rows.select("path", "byte_offset", V.is_object(v).alias("_good"), V.time_ms(v, "$.timestamp").alias("_ms"), F.when(V.text(v, "$.type") == "ai-title", V.filled(v, "$.aiTitle")).alias("_title"), V.filled(v, "$.cwd").alias("_cwd"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("byte_offset")))
    # a value that is no object has no part, so it adds nothing to a path that has objects
    own = rows.groupBy("path").agg(F.count_if("_good").alias("_objects"), F.min("_ms").alias("a"), F.max("_ms").alias("b"), last("_title").alias("title"), last("_cwd").alias("work_directory"))
    own = placed(own.where("_objects > 0")).join(modified.select("path", "modified_ms"), "path", "left")
    workspace = F.coalesce(F.nullif(labels.workspace_of(F.col("work_directory")), F.lit("")), F.col("project"))
    return own.select("session_id", F.lit("anthropic").alias("provider"), workspace.alias("workspace_key"), "work_directory", "title", F.coalesce("a", "modified_ms").alias("created_at_ms"), F.coalesce("b", "modified_ms").alias("updated_at_ms"))


def agents(lines: DataFrame) -> DataFrame:
    """Agents by file. A subagent is known by the first agent that its beginning names, else by the
    first skill, else not at all."""
    rows = placed(lines)
    v = F.col("v")
    rows = V.once(rows, v=F.when(F.col("path").rlike(SUB) & (F.col("byte_offset") < IDENTITY_BYTES), V.json(F.col("text"))))
    name = lambda path: F.nullif(F.trim(V.text(v, path)), F.lit(""))
    rows = rows.withColumns({"_agent": name("$.attributionAgent"), "_skill": name("$.attributionSkill")})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("byte_offset")))
    own = rows.groupBy("session_id", "agent_id").agg(first("_agent").alias("a"), first("_skill").alias("s"))
    main, a, s = F.col("agent_id") == "main", F.col("a"), F.col("s")
    key = F.when(main, "main").when(a.isNotNull(), F.concat(F.lit("agent:"), a)).when(s.isNotNull(), F.concat(F.lit("skill:"), s)).otherwise("subagent")
    label = F.when(main, "Main").when(a.isNotNull(), a).when(s.isNotNull(), F.concat(s, F.lit(" (skill)"))).otherwise("Other subagent")
    return own.select("session_id", "agent_id", key.alias("agent_key"), label.alias("agent_label"), F.when(main, "main").otherwise("sub").alias("agent_type"))


def marker(v: Column) -> Column:
    """interrupted before api-error before streaming-snapshot; null for finished turns."""
    content = V.text(v, "$.message.content")
    interrupted = V.present(v, "$.interruptedMessageId") | F.coalesce(content.contains("[Request interrupted"), F.lit(False))
    flag = V.at(v, "$.isApiErrorMessage")
    failed = F.coalesce((V.kind(flag) == "BOOLEAN") & F.try_variant_get(flag, "$", "boolean"), F.lit(False)) | V.present(v, "$.apiErrorStatus")
    partial = F.coalesce(V.text(v, "$.type") == "assistant", F.lit(False)) & V.present_null(v, "$.message.stop_reason")
    return F.when(interrupted, "interrupted").when(failed, "api-error").when(partial, "streaming-snapshot")


def scan(lines: DataFrame) -> DataFrame:
    """Every line that isn't blank, for diagnostics: path, byte_offset, malformed, uuid,
    parent_uuid, timestamp_ms (of strings alone) and kind. lines are split with their tail."""
    v, good = F.col("v"), F.col("_good")
    rows = lines.where(F.col("text").isNull() | (F.trim("text") != "")).withColumn("v", V.json(F.col("text"))).withColumn("_good", V.is_object(v))
    at = F.unix_millis(F.try_to_timestamp(V.text(v, "$.timestamp")))
    return rows.select("path", "byte_offset", (~good).alias("malformed"), F.when(good, V.text(v, "$.uuid")).alias("uuid"), F.when(good, V.text(v, "$.parentUuid")).alias("parent_uuid"), F.when(good, at).alias("timestamp_ms"), F.when(good & at.isNotNull(), marker(v)).alias("kind"))


def session_rows(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """sessions() of the transcripts below a folder, of which only the sessions' own are opened."""
    listing = lines.found(spark, root, [".jsonl"]) if listing is None else listing
    own = listing.where(of_sessions(F.col("path")))
    return sessions(lines.texts(lines.read(spark, root, listing=own)), own.select("path", "modified_ms"))


def parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usage records, sessions and agents below <root>/projects."""
    listing = lines.found(spark, root, [".jsonl"])
    text = lines.texts(lines.read(spark, root, listing=listing))
    return placed(usage_records(text)), session_rows(spark, root, listing).select(*[c.split()[0] for c in SESSION.split(", ")]), agents(text).select(*[c.split()[0] for c in AGENT.split(", ")])
