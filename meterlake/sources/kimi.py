"""Wire logs and state files of the kimi family."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import variants as V
from meterlake.operators import reconcile
from meterlake.operators.carry import carried, carried_on
from meterlake.schemas import SESSION, TOKENS
from meterlake.sources import lines

#: <root>/sessions/<workspace>/<session>/wire.jsonl, or .../agents/<agent>/wire.jsonl
WIRE = r"/sessions/([^/]+)/([^/]+)/(?:agents/([^/]+)/)?wire\.jsonl$"
_TOKENS = dict(zip(TOKENS, ["inputOther", "inputCacheCreation", None, None, "inputCacheRead", "output"], strict=True))


def placed(df: DataFrame) -> DataFrame:
    """Adds workspace_key, session_id and agent_id by path; other paths go. A wire file of the session itself is main's."""
    part = lambda i: F.regexp_extract("path", WIRE, i)
    return df.where(F.col("path").rlike(WIRE)).withColumns({"workspace_key": part(1), "session_id": part(2), "agent_id": F.coalesce(F.nullif(part(3), F.lit("")), F.lit("main"))})


def _parsed(lines: DataFrame, *words: str) -> DataFrame:
    """Lines that hold one of the words, or aren't UTF-8, with v; bad marks what can't be read."""
    has = F.col("text").contains(words[0])
    for w in words[1:]:
        has = has | F.col("text").contains(w)
    rows = V.once(lines.where(F.col("text").isNull() | has), v=V.json(F.col("text")))
    return V.once(rows, bad=F.col("v").isNull(), type=F.when(V.is_object(F.col("v")), V.text(F.col("v"), "$.type")))


def malformed(lines: DataFrame) -> DataFrame:
    """Unreadable lines per path; lines about something else don't count."""
    return _parsed(lines, "usage.record", "context.append_loop_event").groupBy("path").agg(F.count_if("bad").alias("malformed"))


def _label(v: Column, path: str):
    """A string, or a number as JSON writes it."""
    return F.when(V.kind(V.at(v, path)).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, path, "string"))


def _turns(lines: DataFrame) -> DataFrame:
    """Lines with what a step's end tells (_step) and whether a usage record counts (_used).

    In many small steps, so that the JVM compiles the code of each (V.counts)."""
    v, u, s = F.col("v"), F.col("_u"), F.col("_s")
    rows = _parsed(lines, "usage.record", "context.append_loop_event")
    event = F.when(F.col("type") == "context.append_loop_event", V.at(v, "$.event"))
    rows = V.once(rows, _u=F.when(F.col("type") == "usage.record", v), _e=event)
    rows = V.once(rows, _s=F.when(V.text(F.col("_e"), "$.type") == "step.end", F.col("_e")))

    def quoted(path: str, x: Column) -> Column:
        text = F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
        return F.when(x.isNull(), F.lit("null")).when(V.kind(V.at(s, path)) == "STRING", text).otherwise(x)

    labels = {"_label_step": "$.step", "_label_turn": "$.turnId"}
    rows = V.once(rows, **{c: _label(s, path) for c, path in labels.items()})
    step, turn = (F.when(F.coalesce(*labels).isNotNull(), quoted(path, F.col(c))) for c, path in labels.items())
    rows = V.once(rows, _metadata=F.concat(F.lit('{"step":'), step, F.lit(',"turnId":'), turn, F.lit("}")))
    identity = F.struct(V.filled(s, "$.messageId").alias("request"), F.col("_metadata").alias("metadata"), V.filled(s, "$.uuid").alias("uuid"))
    rows = V.once(rows, _step=F.when(s.isNotNull(), identity))
    rows = V.counts(rows, **{c: (u, f"$.usage.{k}") for c, k in _TOKENS.items() if k}, _time=(u, "$.time"))
    nothing = {c: F.lit(0).cast("long") for c, k in _TOKENS.items() if not k}
    rows = V.once(rows, **nothing, model=V.filled(u, "$.model"), timestamp_ms=V.time_ms(u, "$.time", F.col("_time")))
    used = (V.text(u, "$.usageScope") == "turn") & F.col("model").isNotNull() & F.col("timestamp_ms").isNotNull()
    used &= sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0])) > 0
    return V.once(rows, _used=F.coalesce(used, F.lit(False))).select(*lines.columns, "model", "timestamp_ms", *TOKENS, "_step", "_used")


def usage_records(lines: DataFrame) -> DataFrame:
    """Usage records of turns with the identity of the step before them.

    lines: path, byte_offset, text, perhaps with step, an identity from before the first line. A
    step's identity is spent by the next record that counts, not by records that don't."""

    def made(lines: DataFrame) -> DataFrame:
        rows = _turns(lines)
        return rows.withColumn("_step", F.coalesce("step", "_step")) if "step" in lines.columns else rows

    rows = carried(made(lines), F.col("_step"), F.col("_used"), "_identity", raw=lines, made=made).where("_used")
    identity = [F.col(f"_identity.{a}").alias(b) for a, b in (("request", "provider_request_id"), ("uuid", "step_uuid"), ("metadata", "request_metadata"))]
    return rows.select("path", "byte_offset", "model", *identity, "timestamp_ms", *TOKENS)


def open_steps(lines: DataFrame) -> DataFrame:
    """The end of each path's last step that no usage record has spent: a stream's context."""
    own = F.when(F.col("_step").isNotNull(), F.struct("byte_offset", "text"))
    return carried_on(_turns(lines), own, F.col("_used"), "s").select("path", "s.byte_offset", "s.text")


def _asked(lines: DataFrame) -> DataFrame:
    """Lines with their request (_request) and whether they are a turn's usage (_turn)."""
    v, q = F.col("v"), F.col("_q")
    rows = _parsed(lines, "llm.request", "usage.record")
    turn = F.coalesce((F.col("type") == "usage.record") & (V.text(v, "$.usageScope") == "turn"), F.lit(False))
    rows = V.once(rows, _q=F.when(F.col("type") == "llm.request", v), _turn=turn)
    rows = V.counts(rows, _time=(q, "$.time"), _messages=(q, "$.messageCount"))
    request = F.struct(V.time_ms(q, "$.time", F.col("_time")).alias("requested_ms"), F.col("_messages").alias("message_count"), V.filled(q, "$.systemPromptHash").alias("system_prompt_hash"), V.filled(q, "$.toolsHash").alias("tools_hash"))
    return V.once(rows, _request=F.when(q.isNotNull(), request))


def requests(lines: DataFrame) -> DataFrame:
    """Turn usages with the latest request before them: path, byte_offset, requested_ms,
    message_count, system_prompt_hash, tools_hash. Every turn usage spends a request; a request
    without a time answers nothing.

    As many as usages, though Spark takes what tasks read for as little as the listing of their files: hence
    the hint, or a join would send them all to the driver to be broadcast."""
    rows = carried(_asked(lines), F.col("_request"), F.col("_turn"), "r", raw=lines, made=_asked).where("_turn and r.requested_ms is not null")
    return rows.select("path", "byte_offset", "r.requested_ms", "r.message_count", "r.system_prompt_hash", "r.tools_hash").hint("merge")


def cache_calls(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Canonical calls of moonshotai as cache_window takes them: by their request's time, else by
    that of their usage (timing_source tells)."""
    own = found.withColumnsRenamed({"path": "canonical_source_path", "byte_offset": "canonical_byte_offset"})
    rows = calls.where("provider = 'moonshotai'").join(own, ["canonical_source_path", "canonical_byte_offset"], "left")
    return rows.select("session_id", "agent_id", F.col("raw_model").alias("model"), F.coalesce("requested_ms", "timestamp_ms").alias("request_ms"), F.col("timestamp_ms").alias("usage_ms"), "event_fingerprint", "cache_read_tokens", "input_other_tokens", "message_count", "system_prompt_hash", "tools_hash", F.when(F.col("requested_ms").isNull(), "usage-record").otherwise("llm-request").alias("timing_source"))


def timing_coverage(calls: DataFrame) -> DataFrame:
    """One row: first and last request, and how many calls have a request's time."""
    return calls.agg(F.min("request_ms").alias("first_request_ms"), F.max("request_ms").alias("last_request_ms"), F.count_if(F.col("timing_source") == "llm-request").alias("matched"), F.count_if(F.col("timing_source") == "usage-record").alias("fallbacks"))


def states(files: DataFrame) -> DataFrame:
    """Sessions of state.json files (path, content, modified_ms): session_id, workspace_key, title, times."""
    part = lambda i: F.regexp_extract("path", r"/sessions/([^/]+)/([^/]+)/state\.json$", i)
    rows = files.where(part(2) != "").withColumn("v", F.parse_json(F.col("content").cast("string")))
    v = F.col("v")
    created = F.coalesce(V.time_ms(v, "$.createdAt"), F.col("modified_ms"))
    return rows.select(part(2).alias("session_id"), F.lit("moonshotai").alias("provider"), part(1).alias("workspace_key"), V.filled(v, "$.workDir").alias("work_directory"), V.filled(v, "$.title").alias("title"), created.alias("created_at_ms"), F.coalesce(V.time_ms(v, "$.updatedAt"), created).alias("updated_at_ms"))


def state_agents(files: DataFrame) -> DataFrame:
    """Agents that state.json files name: session_id, agent_id, agent_type, parent_agent_id, source_path."""
    session = F.regexp_extract("path", r"/sessions/[^/]+/([^/]+)/state\.json$", 1)
    rows = files.where(session != "").select(session.alias("session_id"), F.explode(F.try_variant_get(F.parse_json(F.col("content").cast("string")), "$.agents", "map<string,variant>")).alias("agent_id", "a"))
    a = F.col("a")
    kind = V.text(a, "$.type")
    return rows.where(V.is_object(a)).select("session_id", "agent_id", F.when(kind.isin("main", "sub"), kind).otherwise("unknown").alias("agent_type"), V.filled(a, "$.parentAgentId").alias("parent_agent_id"), V.filled(a, "$.homedir").alias("source_path"))


def parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usage records, sessions and agents below <root>/sessions. A session without a state file
    begins and ends with the times of its logs."""
    files = lines.files(spark, root, "state.json")
    records = placed(usage_records(lines.texts(lines.read(spark, root, "wire.jsonl"))))
    logs = placed(lines.listed(spark, root, "wire.jsonl"))
    known = states(files)
    bare = logs.join(known, "session_id", "left_anti").groupBy("session_id")
    times = [F.min("modified_ms").alias("created_at_ms"), F.max("modified_ms").alias("updated_at_ms")]
    bare = bare.agg(F.min("workspace_key").alias("workspace_key"), *times)
    none = F.lit(None).cast("string")
    bare = bare.select("session_id", F.lit("moonshotai").alias("provider"), "workspace_key", none.alias("work_directory"), none.alias("title"), "created_at_ms", "updated_at_ms")
    agents = reconcile.merged_agents(state_agents(files), logs.select("session_id", "agent_id", F.col("path").alias("source_path")))
    label = F.when(F.col("agent_id") == "main", "Main").otherwise(F.col("agent_id"))
    return records, known.unionByName(bare).select(*[c.split()[0] for c in SESSION.split(", ")]), agents.select("session_id", "agent_id", F.col("agent_id").alias("agent_key"), label.alias("agent_label"), "agent_type")
