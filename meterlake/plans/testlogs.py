"""The ledger view of the test tables, written as the logs and documents that it would have come from."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (path below folder, at, tie, text) as lines of files, by at and tie; gives the number
    of files. A task that runs again writes the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by path, so one file is open at a time. Its lines are written 1 MB at once."""
        import pyarrow.fs as pafs

        store, top = pafs.FileSystem.from_uri(folder)
        out, current, files, inside, held, size = None, None, 0, None, [], 0
        for batch in batches:
            for path, text in zip(batch["path"].tolist(), batch["text"].tolist(), strict=True):
                if path != current:
                    if out is not None:
                        out.write("".join(held).encode())
                        out.close()
                    if inside != (inside := f"{top}/{path}".rsplit("/", 1)[0]):
                        store.create_dir(inside, recursive=True)
                    out, current, files, held, size = store.open_output_stream(f"{top}/{path}"), path, files + 1, [], 0
                held.append(f"{text}\n")
                size += len(held[-1])
                if size >= 1 << 20:
                    out.write("".join(held).encode())
                    held, size = [], 0
        if out is not None:
            out.write("".join(held).encode())
            out.close()
        yield pd.DataFrame({"files": [files]})

    dealt = rows.repartition("path").sortWithinPartitions("path", "at", "tie").select("path", "text")
    return dealt.mapInPandas(write, "files long").agg(F.sum("files")).first()[0] or 0


def _text(x: Column) -> Column:
    return x.cast("string")


def _usage_record() -> Column:
    names = {"input_other_tokens": "inputOther", "cache_creation_tokens": "inputCacheCreation", "cache_read_tokens": "inputCacheRead", "output_tokens": "output"}
    used = F.struct(*[F.col(c).alias(k) for c, k in names.items()])
    return F.to_json(F.struct(F.lit("usage.record").alias("type"), F.col("timestamp_ms").alias("time"), F.col("raw_model").alias("model"), F.lit("turn").alias("usageScope"), used.alias("usage")))


def write_wires(calls: DataFrame, folder: str, workspace: str | Column = "ws") -> int:
    """sessions/<workspace>/<session>/wire.jsonl for each session: a step end and a usage record a call, in time order."""
    step = F.to_json(F.struct(F.lit("context.append_loop_event").alias("type"), F.struct(F.lit("step.end").alias("type"), _text(F.col("event_id")).alias("uuid")).alias("event")))
    where = F.lit(workspace) if isinstance(workspace, str) else workspace
    path = F.concat(F.lit("sessions/"), where, F.lit("/"), "session_id", F.lit("/wire.jsonl"))
    both = F.concat(step, F.lit("\n"), _usage_record())
    return write_files(calls.select(path.alias("path"), F.col("timestamp_ms").alias("at"), F.col("event_id").alias("tie"), both.alias("text")), folder)


def write_requests(calls: DataFrame, folder: str) -> int:
    """Wires with a request before each usage record, which every third call lacks."""
    request = F.to_json(F.struct(F.lit("llm.request").alias("type"), (F.col("timestamp_ms") - 5000).alias("time"), (F.col("event_id") % 9).alias("messageCount"), F.lit("sys").alias("systemPromptHash"), F.lit("tools").alias("toolsHash")))
    path = F.concat(F.lit("sessions/ws/"), "session_id", F.lit("/wire.jsonl"))
    both = F.concat(F.when(F.col("event_id") % 3 != 0, F.concat(request, F.lit("\n"))).otherwise(""), _usage_record())
    return write_files(calls.select(path.alias("path"), F.col("timestamp_ms").alias("at"), F.col("event_id").alias("tie"), both.alias("text")), folder)


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_transcripts(calls: DataFrame, sessions: DataFrame, folder: str) -> int:
    """projects/proj-<n>/<session>.jsonl of each session, and the subagents' files below it: assistant
    messages, of which every tenth is malformed and every tenth synthetic; titles stand in the session's file."""
    e, session = F.col("event_id"), F.col("session_id")
    project = lambda: F.concat(F.lit("projects/proj-"), _text(session.cast("long") % 5), F.lit("/"), session)
    agent = F.col("agent_id")
    path = F.when(agent == "main", F.concat(project(), F.lit(".jsonl"))).otherwise(F.concat(project(), F.lit("/subagents/agent-"), agent, F.lit(".jsonl")))
    written = F.col("cache_creation_tokens") + F.col("cache_creation_5m_tokens") + F.col("cache_creation_1h_tokens")
    lifetimes = F.struct(F.col("cache_creation_1h_tokens").alias("ephemeral_1h_input_tokens"), F.col("cache_creation_5m_tokens").alias("ephemeral_5m_input_tokens"))
    used = F.struct(F.col("input_other_tokens").alias("input_tokens"), written.alias("cache_creation_input_tokens"), lifetimes.alias("cache_creation"), F.col("cache_read_tokens").alias("cache_read_input_tokens"), "output_tokens")
    extra = F.when(e % 11 == 0, ',"interruptedMessageId":"i"').when(e % 11 == 1, ',"isApiErrorMessage":true').otherwise("")
    extra = F.concat(extra, F.when(agent == "sub-0", ',"attributionAgent":"planner"').when(agent == "sub-1", ',"attributionSkill":"review"').otherwise(""))
    extra = F.concat(extra, F.when(e % 3 == 0, F.concat(F.lit(',"requestId":"r'), _text(e), F.lit('"'))).otherwise(""))
    model = F.when(e % 10 == 8, "<synthetic>").otherwise(F.col("raw_model"))
    stop = F.when(e % 11 == 2, "null").otherwise('"end_turn"')
    line = F.concat(F.lit('{"type":"assistant","timestamp":"'), iso(F.col("timestamp_ms")), F.lit('","uuid":"u'), _text(e), F.lit('"'), extra, F.lit(',"message":{"id":"m'), _text(e), F.lit('","model":"'), model, F.lit('","stop_reason":'), stop, F.lit(',"usage":'), F.to_json(used), F.lit("}}"))
    line = F.when(e % 10 == 9, '{"type":"assistant","usage"').otherwise(line)
    turns = calls.select(path.alias("path"), F.col("timestamp_ms").alias("at"), e.alias("tie"), line.alias("text"))
    n = session.cast("long")
    cwd = F.when(n % 3 != 0, F.concat(F.lit(',"cwd":"'), "work_directory", F.lit('"'))).otherwise("")
    title = lambda word: F.concat(F.lit('{"type":"ai-title","timestamp":"'), iso(F.col("created_at_ms")), F.lit(f'","aiTitle":"{word} '), session, F.lit('"'), cwd, F.lit("}"))
    own = F.concat(project(), F.lit(".jsonl")).alias("path")
    first = sessions.select(own, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("tie"), title("Title").alias("text"))
    last = sessions.where(n % 4 == 0).select(own, F.lit(2**62).alias("at"), F.lit(0).cast("long").alias("tie"), title("Renamed").alias("text"))
    return write_files(turns.unionByName(first).unionByName(last), folder)


def write_states(sessions: DataFrame, agents: DataFrame, folder: str) -> int:
    """sessions/<workspace>/<session>/state.json: times as numbers or as text, and all agents but main."""
    kind = F.struct(F.when(F.col("agent_type") == "sub", "sub").otherwise("odd").alias("type"), F.when(F.col("agent_type") == "sub", "main").alias("parentAgentId"))
    named = agents.where("agent_id <> 'main'").groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("agent_id", kind))).alias("agents"))
    rows = sessions.join(named, "session_id", "left")
    even = F.col("session_id").cast("long") % 2 == 0
    created = F.when(even, _text(F.col("created_at_ms"))).otherwise(F.concat(F.lit('"'), iso(F.col("created_at_ms")), F.lit('"')))
    rest = F.to_json(F.struct(F.col("updated_at_ms").alias("updatedAt"), F.trim("title").alias("title"), F.col("work_directory").alias("workDir"), "agents"))
    text = F.concat(F.lit('{"createdAt":'), created, F.lit(","), F.substring(rest, 2, 1 << 30))
    path = F.concat(F.lit("sessions/"), "workspace_key", F.lit("/"), "session_id", F.lit("/state.json"))
    zero = F.lit(0).cast("long")
    return write_files(rows.select(path.alias("path"), zero.alias("at"), zero.alias("tie"), text.alias("text")), folder)
