"""Several folders followed into one store: progress by file, counters, agents, and a provider of one's own."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from meterlake.functions import variants as V
from meterlake.schemas import ACCOUNT_STATE, SESSION, TOKENS
from meterlake.sources import catalogs, lines, providers
from meterlake.streaming.reconcile import Reconciler

from .test_sources import assistant, put, step, usage

ZERO = {"input_tokens": 0, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}


def reconciler(spark, tmp_path):
    sessions = spark.createDataFrame([], SESSION)
    return Reconciler(spark, f"file://{tmp_path}/store", sessions, catalogs.bundled(spark), spark.createDataFrame([], ACCOUNT_STATE))


def last(made):
    r = made.batches.orderBy(F.desc("version")).first()
    return {c: r[c] for c in ("changed", "discovered_sessions", "discovered_sources", "lines", "malformed", "inserted", "removed", "rewritten", "errors")}


def test_two_streams_one_store(spark, tmp_path):
    """Each folder has its own stream and checkpoint; batches that come again, and lost checkpoints, lose
    and repeat nothing. The log has all counters; agents follow appends, rewrites and deletions."""
    made = reconciler(spark, tmp_path)
    kimi, claude = f"file://{tmp_path}/kimi", f"file://{tmp_path}/claude"
    wire = tmp_path / "kimi/sessions/ws/s1/wire.jsonl"
    put(wire, step("u1"), usage(), '{"type":"usage.record', step("u2"))
    sub = tmp_path / "claude/projects/p/a/subagents/agent-9.jsonl"
    put(tmp_path / "claude/projects/p/a.jsonl", assistant(usage=ZERO | {"output_tokens": 5}, requestId="r1"), '{"type":"assistant","usage"', "")
    put(sub, assistant(usage=ZERO | {"output_tokens": 1}, requestId="r2"))
    follow = lambda root, name: made.start(root, f"{tmp_path}/{name}").awaitTermination()
    count = lambda: (made.occurrences.count(), made.calls.count())

    follow(kimi, "c1")
    assert count() == (1, 1) and last(made) == dict(changed=True, discovered_sessions=1, discovered_sources=1, lines=4, malformed=1, inserted=1, removed=0, rewritten=0, errors=0)
    follow(claude, "c2")
    assert count() == (3, 3) and last(made) == dict(changed=True, discovered_sessions=1, discovered_sources=2, lines=4, malformed=1, inserted=2, removed=0, rewritten=0, errors=0)
    assert made.batches.where("bytes > 0").count() == 2 and [r.stream for r in made.batches.orderBy("version").collect()] == [kimi, claude]
    version = made.store.versions()[-1]
    shutil.rmtree(tmp_path / "c1")
    for root, name in ((kimi, "c1"), (claude, "c2"), (claude, "c3")):
        follow(root, name)
    made.take(kimi, 0)
    made.take(claude)
    assert count() == (3, 3) and made.store.versions()[-1] == version and made.changes_since(version).isEmpty()

    offset = [f for f in os.listdir(tmp_path / "c2/offsets") if not f.startswith(".")]
    assert all(len((tmp_path / "c2/offsets" / f).read_text()) < 2000 and "agent-9" not in (tmp_path / "c2/offsets" / f).read_text() for f in offset)
    agents = lambda: {(r.session_id, r.agent_id): (r.agent_key, r.agent_label) for r in made.agents.collect()}
    assert agents() == {("s1", "main"): ("main", "Main"), ("anthropic:a", "main"): ("main", "Main"), ("anthropic:a", "9"): ("subagent", "Other subagent")}
    # an append names the subagent, and spends the step that the first batch left open
    put(sub, assistant(usage=ZERO | {"output_tokens": 1}, requestId="r2"), assistant(usage=ZERO | {"output_tokens": 2}, requestId="r3", attributionAgent="planner"))
    made.take(claude)
    assert agents()["anthropic:a", "9"] == ("agent:planner", "planner") and last(made)["rewritten"] == 0 and last(made)["inserted"] == 1
    with open(wire, "a", encoding="utf-8") as f:
        f.write(usage(out=3) + "\n")
    made.take(kimi)
    assert made.calls.where("event_fingerprint = 'step:moonshotai:u2'").count() == 1
    # written anew without a name, and another file gone
    put(sub, assistant(usage=ZERO | {"output_tokens": 7}, requestId="r9", pad="x" * 300))
    (tmp_path / "claude/projects/p/a.jsonl").unlink()
    made.take(claude)
    assert last(made) == dict(changed=True, discovered_sessions=1, discovered_sources=1, lines=1, malformed=0, inserted=1, removed=1, rewritten=1, errors=0)
    assert agents() == {("s1", "main"): ("main", "Main"), ("anthropic:a", "9"): ("subagent", "Other subagent")}
    assert sorted(r.output_tokens for r in made.calls.where("provider = 'anthropic'").collect()) == [7]
    assert not os.path.exists(tmp_path / "store/work") or not os.listdir(tmp_path / "store/work")


def test_batches_of_other_streams(spark, tmp_path):
    """Batch 0 of a second stream is not batch 0 of the first."""
    put(tmp_path / "one/sessions/ws/s1/wire.jsonl", step("u1"), usage())
    put(tmp_path / "two/projects/p/a.jsonl", assistant(usage=ZERO | {"output_tokens": 5}, requestId="r1"))
    spark.dataSource.register(lines.LogLines)
    made = reconciler(spark, tmp_path)
    for name in ("one", "two", "one", "two"):
        made.batch(spark.read.format("log-lines").option("path", f"file://{tmp_path}/{name}").load(), 0, name)
    assert made.calls.count() == 2 and made.batches.count() == 2


def test_third_provider(spark, tmp_path):
    """A family that is registered is followed without a change to the reconciler."""
    pattern = r"/plain/([^/]+)\.log$"

    def records(rows):
        v = V.json(F.col("text"))
        n = {c: F.lit(0).cast("long") for c in TOKENS} | {"output_tokens": V.count(v, "$.n")}
        none = F.lit(None).cast("string")
        names = {"model": F.lit("claude-x"), "provider_request_id": V.text(v, "$.id"), "step_uuid": none, "request_metadata": none, "timestamp_ms": F.lit(5).cast("long")}
        return rows.withColumns(names | n).select("path", "byte_offset", *names, *TOKENS)

    def placed(rows):
        return rows.where(F.col("path").rlike(pattern)).withColumns({"session_id": F.regexp_extract("path", pattern, 1), "agent_id": F.lit("main")})

    malformed = lambda rows: rows.groupBy("path").agg(F.count_if(V.json(F.col("text")).isNull()).alias("malformed"))
    own = providers.Provider("plain", ".log", pattern, placed, records, malformed, lambda rows: providers.named_agents(placed(rows)))
    put(tmp_path / "logs/plain/x.log", json.dumps({"id": "a", "n": 3}), json.dumps({"id": "b", "n": 4}))
    put(tmp_path / "logs/sessions/ws/s1/wire.jsonl", step("u1"), usage())
    providers.register(own)
    try:
        made = reconciler(spark, tmp_path)
        made.take(f"file://{tmp_path}/logs")
    finally:
        providers.unregister("plain")
    assert {(r.session_id, r.output_tokens) for r in made.calls.collect()} == {("x", 3), ("x", 4), ("s1", 40)}
    assert {r.session_id for r in made.agents.collect()} == {"x", "s1"}


def test_many_files(spark, tmp_path):
    """10,000 files: listed and compared in tasks, an offset of fixed length; one that can't be read is an error."""
    for i in range(10_000):
        d = tmp_path / f"logs/sessions/w{i % 100}/s{i}"
        d.mkdir(parents=True)
        (d / "wire.jsonl").write_bytes(b"{}\n" if i % 2 else b"{}\n{")
    root = f"file://{tmp_path}/logs"
    listing = lines.found(spark, root, ["wire.jsonl"])
    none = spark.createDataFrame([], lines.FILES)
    lines.compared(listing, none, root).write.parquet(f"{tmp_path}/first")
    first = spark.read.parquet(f"{tmp_path}/first")
    assert first.count() == 10_000 and first.where("upto = 3 and start = 0 and generation = 0").count() == 10_000
    read = lines.new_lines(first, root)
    assert read.count() == 10_000 and read.rdd.getNumPartitions() <= 4 * 4
    (tmp_path / "logs/sessions/w7/s7/wire.jsonl").write_bytes(b"[]\n{}\n")
    (tmp_path / "logs/sessions/w8/s8/wire.jsonl").write_bytes(b"{}\n{}\n")
    shutil.rmtree(tmp_path / "logs/sessions/w9/s9")
    os.chmod(tmp_path / "logs/sessions/w10/s10/wire.jsonl", 0)
    os.symlink(tmp_path / "nowhere", tmp_path / "logs/sessions/w1/wire.jsonl")
    known = first.select("path", "generation", "upto", "mark", "gone")
    again = {r.path.rsplit("/", 2)[1]: (r.generation, r.start, r.upto, r.gone, r.before, r.rewritten) for r in lines.compared(lines.found(spark, root, ["wire.jsonl"]), known, root).where("error is null").collect()}
    assert again == {"s7": (1, 0, 6, False, 0, True), "s8": (0, 3, 6, False, None, False), "s9": (0, 0, 0, True, 0, False)}
    ticks = lines._Ticks({"path": root, "suffix": "wire.jsonl"})
    one = ticks.latestOffset()
    assert one == ticks.latestOffset() and len(json.dumps(one)) < 100
    (tmp_path / "logs/sessions/w8/s8/wire.jsonl").write_bytes(b"{}\n{}\n{}\n")
    assert ticks.latestOffset() != one


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_ranges(spark, tmp_path, size):
    """New lines are the same however files are cut."""
    put(tmp_path / "a.jsonl", *[f"line {i} {'x' * (i % 7)}" for i in range(30)], end="")
    root = f"file://{tmp_path}"
    changes = lines.compared(lines.found(spark, root, [".jsonl"]), spark.createDataFrame([], lines.FILES), root)
    got = sorted((r.byte_offset, bytes(r.line).decode()) for r in lines.new_lines(changes, root, size).collect())
    at, want = 0, []
    for text in (tmp_path / "a.jsonl").read_text().split("\n")[:-1]:
        want.append((at, text))
        at += len(text) + 1
    assert got == want


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    from meterlake.sinks.store import Store

    store = Store(spark, f"file://{tmp_path}/store")
    one, two = store.begin(), store.begin()
    rows = spark.createDataFrame([(1,)], "n long")
    one.write("t", rows)
    one.publish()
    two.append("u", rows, "n long")
    with pytest.raises(RuntimeError):
        two.publish()
    assert store.versions() == [1]


def test_buckets_are_few_files(spark, tmp_path):
    """A bucket's rows come together before they are written, however many tasks made them."""
    from meterlake.sinks.store import BUCKETS, Store

    store = Store(spark, f"file://{tmp_path}/store")
    commit = store.begin()
    commit.write_buckets("t", spark.range(0, 5000, 1, 16).select(F.col("id").cast("string").alias("k")), "k", range(BUCKETS))
    commit.publish()
    assert len(list((tmp_path / "store/t/v1").glob("*/*.parquet"))) <= 2 * BUCKETS
    assert store.read("t", "k string").distinct().count() == store.read("t", "k string").count() == 5000
