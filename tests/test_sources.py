"""Log lines, the two families' parsers, exports and catalogs, on files in a temporary folder."""

import json
import re

import pytest
from pyspark.sql import functions as F

from meterlake.operators import catalog, reconcile
from meterlake.schemas import ACCOUNT_STATE, SESSION
from meterlake.sources import catalogs, claude, exports, kimi, lines
from meterlake.streaming.reconcile import Reconciler


def usage(time=1785585600000, model="moonshot-ai/kimi-k3", scope="turn", out=40, **tokens):
    return json.dumps({"type": "usage.record", "time": time, "model": model, "usageScope": scope, "usage": {"inputOther": 100, "inputCacheCreation": 20, "inputCacheRead": 300, "output": out} | tokens})


def step(uuid, **more):
    return json.dumps({"type": "context.append_loop_event", "event": {"type": "step.end", "uuid": uuid} | more})


def put(path, *texts, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n".join(texts).encode() + end.encode())
    return path


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def read(spark, folder, tail=False):
    return lines.texts(lines.split(lines.files(spark, str(folder)), tail))


def test_byte_offsets(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("é\r\n\n".encode() + b"\xff\xfe\nlast\nno end")
    got = rows(lines.split(lines.files(spark, str(tmp_path))), "byte_offset")
    assert [(r["byte_offset"], bytes(r["line"])) for r in got] == [(0, "é".encode()), (4, b""), (5, b"\xff\xfe"), (8, b"last")]
    assert [r["text"] for r in rows(read(spark, tmp_path, True), "byte_offset")] == ["é", None, "last", "no end"]
    spark.dataSource.register(lines.LogLines)
    for size in (1, 3, 5, 1000):
        same = spark.read.format("log-lines").option("path", f"file://{tmp_path}").option("range", str(size)).load()
        assert [(r["byte_offset"], bytes(r["line"])) for r in rows(same, "byte_offset")] == [(0, "é".encode()), (4, b""), (5, b"\xff\xfe"), (8, b"last")]


def test_kimi_usage(spark, tmp_path):
    wire = tmp_path / "sessions/ws/s1/wire.jsonl"
    put(wire, "{bad usage.record", "{bad other", usage(scope="session"), step("u1", messageId="m1", turnId=3, step="a"), usage(inputOther="10"), usage(), usage(out=0, inputOther=0, inputCacheCreation=0, inputCacheRead=0), step("u2"), usage(time="2026-08-01T12:00:00Z", inputOther=10.0), usage(inputOther=2**53), usage(inputOther=1.5), usage(inputOther=-1))
    got = rows(kimi.placed(kimi.usage_records(read(spark, tmp_path))), "byte_offset")
    assert [(r["provider_request_id"], r["step_uuid"], r["request_metadata"], r["input_other_tokens"]) for r in got] == [("m1", "u1", '{"step":"a","turnId":3}', 100), (None, "u2", None, 10)]
    assert got[0]["session_id"] == "s1" and got[0]["agent_id"] == "main" and got[1]["timestamp_ms"] == 1785585600000
    assert rows(kimi.malformed(read(spark, tmp_path)), "path")[0]["malformed"] == 1


def test_kimi_requests(spark, tmp_path):
    request = lambda **x: json.dumps({"type": "llm.request"} | x)
    put(tmp_path / "sessions/ws/s/agents/sub/wire.jsonl", request(time=5, messageCount=2, systemPromptHash="h", toolsHash=""), usage(), usage(), request(time=7), request(time="never"), usage(), request(time=9), usage(scope="session"), usage(model=""))
    got = rows(kimi.requests(read(spark, tmp_path)), "byte_offset")
    assert [(r["requested_ms"], r["message_count"], r["system_prompt_hash"], r["tools_hash"]) for r in got] == [(5, 2, "h", None), (9, None, None, None)]


def test_requests_are_not_broadcast(spark, tmp_path):
    """They are as many as usages, but count as little as the listing of the files that they stand in."""
    request = json.dumps({"type": "llm.request", "time": 5, "messageCount": 2})
    put(tmp_path / "sessions/ws/s/wire.jsonl", usage(), request, usage(), usage())
    text = lines.texts(lines.read(spark, f"file://{tmp_path}", "wire.jsonl"))
    own = kimi.usage_records(text).select("path", "byte_offset", "timestamp_ms")
    both = own.join(kimi.requests(text), ["path", "byte_offset"], "left")
    calls = own.select(F.lit("moonshotai").alias("provider"), F.lit("s").alias("session_id"), F.lit("main").alias("agent_id"), F.lit("m").alias("raw_model"), "timestamp_ms", F.lit("f").alias("event_fingerprint"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("input_other_tokens"), F.col("path").alias("canonical_source_path"), F.col("byte_offset").alias("canonical_byte_offset"))
    for made in (both, kimi.cache_calls(calls, kimi.requests(text))):
        assert [r["message_count"] for r in rows(made, F.col("message_count").asc_nulls_last())] == [2, None, None]
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "byte_offset" in x]


def test_kimi_state(spark, tmp_path):
    put(tmp_path / "sessions/ws/s1/state.json", json.dumps({"createdAt": "2026-08-01T00:00:00Z", "title": "", "workDir": "/w", "agents": {"main": {"type": "main"}, "x": {"type": "odd", "parentAgentId": "main"}, "bad": 3}}), end="")
    files = lines.files(spark, str(tmp_path), "state.json")
    s = rows(kimi.states(files), "session_id")[0]
    assert (s["session_id"], s["created_at_ms"], s["updated_at_ms"], s["title"], s["work_directory"]) == ("s1", 1785542400000, 1785542400000, None, "/w")
    named = kimi.state_agents(files)
    assert [(r["agent_id"], r["agent_type"], r["parent_agent_id"]) for r in rows(named, "agent_id")] == [("main", "main", None), ("x", "unknown", "main")]
    found = spark.createDataFrame([("s1", "x", "/log"), ("s1", "new", "/n")], "session_id string, agent_id string, source_path string")
    assert [(r["agent_id"], r["agent_type"], r["source_path"]) for r in rows(reconcile.merged_agents(named, found), "agent_id")] == [("main", "main", None), ("new", "unknown", "/n"), ("x", "unknown", "/log")]


def assistant(**x):
    message = {"id": "msg", "model": "claude-fable-5", "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 10} | x.pop("usage", {})} | x.pop("message", {})
    return json.dumps({"type": "assistant", "uuid": "u", "timestamp": "2026-08-01T00:00:00.5Z", "message": message} | x)


def test_claude_usage(spark, tmp_path):
    ttl = lambda **x: {"cache_creation": {f"ephemeral_{k}_input_tokens": v for k, v in x.items()}}
    put(tmp_path / "projects/p/s.jsonl", assistant(usage=ttl(**{"1h": 4, "5m": 1}), requestId="r"), assistant(usage=ttl(**{"1h": 11})), assistant(usage=ttl(**{"1h": None})), assistant(message={"model": "<synthetic>"}), '["assistant", "usage"]', '{"assistant" "usage"', "{", assistant(usage={"cache_creation": 7}))
    got = rows(claude.placed(claude.usage_records(read(spark, tmp_path))), "byte_offset")
    assert [(r["provider_request_id"], r["cache_creation_tokens"], r["cache_creation_1h_tokens"], r["cache_creation_5m_tokens"]) for r in got] == [("r", 5, 4, 1), ("msg", 10, 0, 0)]
    assert got[0]["session_id"] == "anthropic:s" and got[0]["timestamp_ms"] == 1785542400500
    assert rows(claude.malformed(read(spark, tmp_path)), "path")[0]["malformed"] == 2


def test_claude_sessions_and_agents(spark, tmp_path):
    put(tmp_path / "projects/p/s.jsonl", '{"type":"ai-title","aiTitle":"one"}', '{"timestamp":"2026-08-02T00:00:00Z","cwd":"C:\\\\work\\\\project"}', '{"timestamp":"2026-08-01T00:00:00Z"}', '{"type":"ai-title","aiTitle":"two"}', '{"type":"ai-title","aiTitle":""}')
    put(tmp_path / "projects/p/s/subagents/agent-7.jsonl", '{"attributionSkill":" sk "}', '{"attributionAgent":"ag"}')
    put(tmp_path / "projects/p/s/subagents/agent-8.jsonl", '{"attributionSkill":"sk"}')
    text = read(spark, tmp_path)
    s = rows(claude.sessions(text, lines.files(spark, str(tmp_path))), "session_id")
    assert [(r["title"], r["workspace_key"], r["created_at_ms"], r["updated_at_ms"]) for r in s] == [("two", "project", 1785542400000, 1785628800000)]
    assert [(r["agent_id"], r["agent_key"], r["agent_label"], r["agent_type"]) for r in rows(claude.agents(text), "agent_id")] == [("7", "agent:ag", "ag", "sub"), ("8", "skill:sk", "sk (skill)", "sub"), ("main", "main", "Main", "main")]


def test_claude_scan(spark, tmp_path):
    put(tmp_path / "t.jsonl", '{"uuid":"a","timestamp":"2026-08-01T00:00:00Z","interruptedMessageId":null}', '{"uuid":"b","parentUuid":"zz","timestamp":"2026-08-01T00:00:00Z","apiErrorStatus":5}', " ", "[]", '{"type":"assistant","timestamp":"2026-08-01T00:00:00Z","message":{"stop_reason":null}}', '{"type":"assistant","timestamp":"2026-08-01T00:00:00Z","message":{}}', '{"timestamp":5,"isApiErrorMessage":true}', '{"un', end="")
    got = rows(claude.scan(read(spark, tmp_path, True)), "byte_offset")
    assert [r["kind"] for r in got] == ["interrupted", "api-error", None, "streaming-snapshot", None, None, None]
    assert [r["malformed"] for r in got] == [False, False, True, False, False, False, True]


def test_exports(spark):
    doc = {"currency": "usd", "granularity": "daily", "group_by": "model_tier", "start_date": "2026-08-01", "end_date": "2026-08-02", "series": [{"bucket": "2026-08-01", "group_key": "claude_opus_4_8", "cost_minor_units": 250, "request_count": 2, "tokens": {"input": 1, "output": 2, "cache_read": 3, "cache_write_5m": 4, "cache_write_1h": 5}}]}
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "content string")
    r = rows(exports.usage_days(one(doc)), "date")[0]
    assert (r["model_key"], r["cost_usd"], r["request_count"], r["cache_write_1h"]) == ("claude-opus-4-8", 2.5, 2, 5)
    with pytest.raises(Exception, match="not a daily"):
        exports.usage_days(one(doc | {"currency": "eur"})).collect()
    entries = [{"totalCost": 1.5, "modelBreakdowns": [{"modelName": "x/m", "cost": 1}, {"modelName": "m", "cost": 0.5}]}, {"totalCost": 2}]
    for shape in (entries, {"daily": entries}, {"totals": {"totalCost": 3.5}, "daily": entries}):
        assert exports.report_total(one(shape)).first().total_usd == 3.5
    assert rows(exports.report_models(one({"daily": entries})), "model_key") == [{"model_key": "m", "cost_usd": 1.5}]
    with pytest.raises(Exception, match="no total"):
        exports.report_total(one({"a": 1})).collect()


def test_catalogs(spark):
    table = "x\n| Model | Base Input Tokens | 5m Cache Writes | 1h Cache Writes | Cache Hits & Refreshes | Output Tokens |\n|---|---|---|---|---|---|\n| Claude Fable 5 | $10 / MTok | $12.50 / MTok | $20 / MTok | $1 / MTok | $50 / MTok |\n"
    r = catalogs.vendor_markdown(spark, table).first()
    assert (r.model_key, r.input_nano_per_token, r.cache_creation_5m_nano_per_token, r.cache_read_nano_per_token) == ("claude-fable-5", 10000, 12500, 1000)
    for bad in (table.replace("Fable 5", "New 9"), table.replace("$50", "free"), "no table"):
        with pytest.raises(ValueError):
            catalogs.vendor_markdown(spark, bad)
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "content string")
    dev = rows(catalogs.models_dev(one({"moonshotai": {"models": {"kimi-k3": {"cost": {"input": 3, "output": 15, "cache_read": 0.3}}, "none": {}}}, "other": {}})), "model_key")
    assert [(r["model_key"], r["input_nano_per_token"], r["cache_read_nano_per_token"], r["confidence"]) for r in dev] == [("kimi-k3", 3000, 300, "inferred")]
    lite = rows(catalogs.litellm(one({"moonshot/kimi-k3": {"input_cost_per_token": 3e-6, "output_cost_per_token": 1.5e-5, "cache_creation_input_token_cost": 4e-6}, "gpt": {"input_cost_per_token": 1}})), "model_key")
    assert [(r["model_key"], r["input_nano_per_token"], r["cache_creation_nano_per_token"], r["confidence"]) for r in lite] == [("kimi-k3", 3000, 4000, "exact")]
    own = catalogs.overrides(spark, json.dumps({"pricingOverrides": {"kimi-x": {"inputCostPerToken": 1e-6, "outputCostPerToken": 2e-6, "effectiveAt": "2026-08-01T00:00:00Z"}}}), 5).first()
    assert (own.rate_id, own.provider, own.cache_creation_1h_nano_per_token, own.effective_at_ms) == (5, "moonshotai", 1000, 1785542400000)
    with pytest.raises(ValueError):
        catalogs.overrides(spark, '{"m": {"inputCostPerToken": "1", "outputCostPerToken": 1}}')


def test_refresh_keeps_ids(spark):
    base = catalogs.bundled(spark)
    own = base.where("provider = 'anthropic'")
    same = catalog.refreshed(base, own, catalogs.CLAUDE)
    assert same.exceptAll(base).isEmpty() and same.count() == 13
    changed = own.withColumn("input_nano_per_token", own.input_nano_per_token + 1).where("model_key <> 'claude-opus-5'")
    next_ = catalog.refreshed(base, changed, catalogs.CLAUDE, 9)
    assert next_.where("source_name = 'bundled-claude-2026-08-14' and is_active").count() == 2 and next_.count() == 15
    assert {r.rate_id for r in next_.where("rate_id > 13").collect()} == {14, 15}
    back = catalog.refreshed(next_, own, catalogs.CLAUDE, 10)
    assert {r.rate_id for r in back.where("source_name = 'bundled-claude-2026-08-14' and is_active").collect()} == {11, 12, 13}


def test_stream_reconcile(spark, tmp_path):
    """Append, incomplete tail, carried step, rewrite, deletion, redelivery."""
    wire, other = tmp_path / "logs/sessions/ws/s1/wire.jsonl", tmp_path / "logs/sessions/ws/s2/wire.jsonl"
    sessions = spark.createDataFrame([("s1", 20), ("s2", 10)], "session_id string, created_at_ms long")
    states = spark.createDataFrame([], ACCOUNT_STATE)
    made = Reconciler(spark, f"file://{tmp_path}/store", sessions, catalogs.bundled(spark), states)

    def run():
        made.start(f"file://{tmp_path}/logs", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r.event_fingerprint, r.session_id, r.output_tokens, r.total_cost_nano) for r in made.calls.collect())

    put(wire, step("u1"), usage(), step("u2"), '{"type":"usage.rec', end="")
    first = ("step:moonshotai:u1", "s1", 40, 100 * 3000 + 20 * 3000 + 300 * 300 + 40 * 15000)
    assert run() == [first]
    assert run() == [first]
    put(wire, step("u1"), usage(), step("u2"), usage(out=1))
    assert [r[:3] for r in run()] == [("step:moonshotai:u1", "s1", 40), ("step:moonshotai:u2", "s1", 1)]
    put(other, step("u1"), usage())
    assert [r[:3] for r in run()] == [("step:moonshotai:u1", "s2", 40), ("step:moonshotai:u2", "s1", 1)]
    other.unlink()
    assert [r[:3] for r in run()] == [("step:moonshotai:u1", "s1", 40), ("step:moonshotai:u2", "s1", 1)]
    put(wire, step("u9"), usage(out=7))
    assert [r[:3] for r in run()] == [("step:moonshotai:u9", "s1", 7)]


@pytest.mark.parametrize("at", ["calls", "publish"])
def test_reconcile_survives_crashes(spark, tmp_path, at):
    """A failure after the occurrences are written, or before a batch is published, leaves the store as it
    was; the batch again gives all of it."""
    from meterlake.sinks.store import Commit

    put(tmp_path / "logs/sessions/ws/s1/wire.jsonl", step("u1"), usage(), step("u2"), usage(out=1))
    zero = {"input_tokens": 0, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}
    put(tmp_path / "logs/projects/p/a.jsonl", assistant(usage=zero | {"output_tokens": 5}, requestId="r1"))
    sessions = spark.createDataFrame([("s1", "moonshotai", "ws", None, None, 5, 5)], SESSION)
    states = spark.createDataFrame([(1, "pro", "pro-fable", 0)], ACCOUNT_STATE)
    batch = texts_of(spark, f"file://{tmp_path}/logs")
    made = Reconciler(spark, f"file://{tmp_path}/store", sessions, catalogs.bundled(spark), states)
    counts = lambda: (made.occurrences.count(), made.calls.count())
    whole, publish = Commit.write_buckets, Commit.publish

    def write_buckets(self, table, *args):
        if table == at:
            raise OSError
        whole(self, table, *args)

    def failing(self):
        raise OSError

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Commit, "write_buckets", write_buckets)
        patch.setattr(Commit, "publish", failing if at == "publish" else publish)
        with pytest.raises(OSError):
            made.batch(batch, 0)
    assert counts() == (0, 0)
    made.batch(batch, 0)
    assert counts() == (3, 3)
    if at == "calls":
        made.batch(batch, 1)
        assert counts() == (3, 3) and [r.changed for r in made.batches.orderBy("version").collect()] == [True, False]


def texts_of(spark, folder):
    spark.dataSource.register(lines.LogLines)
    return spark.read.format("log-lines").option("path", folder).load()


def test_reconcile_takes_up_sessions_and_states(spark, tmp_path):
    put(tmp_path / "logs/sessions/ws/s1/wire.jsonl", step("u1"), usage())
    put(tmp_path / "logs/sessions/ws/s2/wire.jsonl", step("u1"), usage())
    zero = {"input_tokens": 0, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}
    put(tmp_path / "logs/projects/p/a.jsonl", assistant(usage=zero | {"output_tokens": 5}, requestId="r1"))
    session = lambda i, at: (i, "moonshotai", "ws", None, None, at, at)
    sessions = spark.createDataFrame([session("s1", 5), session("s2", 9)], SESSION)
    none = spark.createDataFrame([], ACCOUNT_STATE)
    made = Reconciler(spark, f"file://{tmp_path}/store", sessions, catalogs.bundled(spark), none)
    made.batch(texts_of(spark, f"file://{tmp_path}/logs"), 0)
    got = lambda: {r.session_id: r.metering_basis for r in made.calls.collect()}
    before = got()
    assert set(before) == {"s1", "anthropic:a"} and made.calls.where("account_state_id is not null").isEmpty()
    made.refresh_sessions(spark.createDataFrame([session("s2", 1)], SESSION))
    assert set(got()) == {"s2", "anthropic:a"} and made.sessions.count() == 2
    made.states = spark.createDataFrame([(1, "enterprise", "enterprise-api", 0)], ACCOUNT_STATE)
    made.classify()
    assert got()["anthropic:a"] == "enterprise-api"


def test_many_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / "p" / f"d{i % 70}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.jsonl").write_bytes(f"a{i}\nb{i}\nrest".encode())
    (tmp_path / "p" / "empty.jsonl").write_bytes(b"")
    for tail, n in ((False, 2), (True, 3)):
        made = lines.read(spark, str(tmp_path), tail=tail)
        assert made.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = {(r.path.rsplit("/", 1)[1], r.byte_offset, bytes(r.line)) for r in made.collect()}
        kinds = lambda i: [(0, f"a{i}".encode()), (len(f"a{i}") + 1, f"b{i}".encode()), (2 * len(f"a{i}") + 2, b"rest")][:n]
        assert got == {(f"{i}.jsonl", at, text) for i in range(300) for at, text in kinds(i)}
    spark.dataSource.register(lines.LogLines)
    packed = spark.read.format("log-lines").option("path", f"file://{tmp_path}").load()
    assert packed.count() == 600 and packed.rdd.getNumPartitions() == 1
    assert lines.listed(spark, str(tmp_path)).count() == 301
    assert lines.files(spark, str(tmp_path), "1?.jsonl").count() == 10
    assert lines.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("of", [claude.usage_records, claude.malformed, claude.scan, kimi.usage_records, kimi.requests], ids=lambda f: f"{f.__module__}.{f.__name__}")
def test_lines_are_parsed_once(spark, of):
    """However many filters ask for a line's fields, no plan parses it more often than it reads it."""
    lines = spark.createDataFrame([("p", 0, "{}")], "path string, byte_offset long, text string")
    plan = of(lines.repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("parseJson") <= plan.count("LogicalRDD") + plan.count("LocalRelation")


@pytest.mark.parametrize("of", [kimi.usage_records, kimi.open_steps, kimi.requests], ids=lambda f: f.__name__)
def test_parsers_are_compiled(spark, of):
    """The JVM compiles no method of more than 8,000 bytes; lines took five times as long by such."""
    lines = spark.createDataFrame([("p", 0, "{}")], "path string, byte_offset long, text string")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else nothing is compiled before it runs
    try:
        code = debug.codegenString(of(lines.repartition(2))._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_short_files_are_parsed_once(spark, tmp_path):
    """Chunks are summed up of files that have several; others' lines aren't made for it. A long file's step
    is carried from chunk to chunk all the same."""
    text = [("short", 0, step("u1")), ("short", 9, usage()), ("long", 0, step("u2")), ("long", 5 << 24, usage()), ("long", 6 << 24, usage())]
    schema = "path string, byte_offset long, text string"
    spark.createDataFrame(text, schema).write.parquet(f"{tmp_path}/all")
    got = lambda df: {(r.path, r.byte_offset): r.step_uuid for r in df.collect()}
    assert got(kimi.usage_records(spark.read.parquet(f"{tmp_path}/all"))) == {("short", 9): "u1", ("long", 5 << 24): "u2", ("long", 6 << 24): None}
    spark.read.parquet(f"{tmp_path}/all").where("path = 'short'").write.parquet(f"{tmp_path}/short")
    made = kimi.usage_records(spark.read.parquet(f"{tmp_path}/short"))
    assert got(made) == {("short", 9): "u1"}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and plan.count("Join LeftSemi") == 1 and "parseJson" not in plan.split("Join LeftSemi")[1]


def test_sessions_open_their_own_transcripts_alone(spark, tmp_path):
    """A subagent's file that has gone since it was listed is not asked for; a value that is no object counts
    for nothing, and a transcript without an object is no session."""
    p = tmp_path / "projects" / "p"
    (p / "s1" / "subagents").mkdir(parents=True)
    (p / "s1.jsonl").write_text('[1]\n{"timestamp":"2026-07-01T00:00:00Z","cwd":"/x/y"}\n"2026"\n')
    (p / "s2.jsonl").write_text('[{"timestamp":"2026-07-01T00:00:00Z"}]\n{bad\n')
    (p / "s1" / "subagents" / "agent-a.jsonl").write_text("{}\n")
    listing = lines.found(spark, str(tmp_path), [".jsonl"])
    (p / "s1" / "subagents" / "agent-a.jsonl").unlink()
    (own,) = claude.session_rows(spark, str(tmp_path), listing).collect()
    assert (own.session_id, own.workspace_key, own.created_at_ms) == ("anthropic:s1", "y", 1782864000000)


def test_lines_across_chunks_and_ranges(spark, tmp_path):
    """Lines shorter and longer than what is read at once, by one range and by many."""
    text = [b"x" * n for n in (3, 0, (1 << 20) - 5, 1, 3 << 20, 7, 2)]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(text[:3]) + b"\r\n" + b"\n".join(text[3:]))
    whole, at = [], 0
    for i, line in enumerate(text):
        whole.append((at, len(line)))
        at += len(line) + 1 + (i == 2)
    for size in (1 << 26, 1 << 20, 300_000):
        for tail in (False, True):
            new = lines.found(spark, str(tmp_path), [".jsonl"]).selectExpr("path", "0L generation", "0L start", "size upto")
            got = lines._lines_of(new, str(tmp_path), size, tail).selectExpr("byte_offset", "octet_length(line)").collect()
            assert sorted(map(tuple, got)) == (whole if tail else whole[:-1])
