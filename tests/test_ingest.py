"""From folders of logs to a ledger, its reports and files, end to end."""

import json

from meterlake.__main__ import main
from meterlake.plans import dashboard, ingest
from meterlake.operators.filters import Filters
from meterlake.schemas import ACCOUNT_STATE
from meterlake.sinks import files
from meterlake.sinks.store import Store, bucket_of
from meterlake.sources import catalogs

from .test_sources import assistant, put, step, usage


def logs(tmp_path):
    k, c = tmp_path / "kimi", tmp_path / "claude"
    put(k / "sessions/ws/s1/wire.jsonl", step("u1"), usage(), step("u2"), usage(time=1785585700000))
    put(k / "sessions/ws/s1/state.json", json.dumps({"createdAt": 1, "updatedAt": 9, "title": "T"}), end="")
    put(k / "sessions/ws/s2/agents/sub/wire.jsonl", step("u1"), usage())
    zero = {"input_tokens": 0, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}
    put(c / "projects/p/a.jsonl", assistant(usage=zero | {"output_tokens": 5}, requestId="r1", cwd="/x/proj"), assistant(usage=zero | {"output_tokens": 20}, requestId="r1", uuid="v", parentUuid="u"))
    put(c / "projects/p/a/subagents/agent-9.jsonl", assistant(usage=zero | {"output_tokens": 1}, requestId="r2"))
    return str(k), str(c)


def test_ledger_from_logs(spark, tmp_path):
    k, c = logs(tmp_path)
    pro = spark.createDataFrame([(1, "pro", "pro-fable", 0)], ACCOUNT_STATE)
    made = ingest.ledger(spark, catalogs.bundled(spark), pro, k, c)
    t = ingest.import_totals(made).first()
    assert (t.sources, t.occurrences, t.calls, t.replays, t.superseded, t.sessions, t.unpriced_calls) == (4, 6, 4, 1, 1, 3, 0)
    kimi = 100 * 3000 + 20 * 3000 + 300 * 300 + 40 * 15000
    assert t.total_cost_nano == 2 * kimi + 21 * 50000
    by = {r.session_id: (r.call_count, r.workspace_key, r.agent_count, r.inherited_occurrences) for r in dashboard.sessions(made, Filters()).collect()}
    assert by == {"s1": (2, "ws", 1, 0), "anthropic:a": (2, "proj", 2, 0)}
    again = ingest.ledger(spark, catalogs.bundled(spark).limit(0), pro, k, c, previous=made.calls)
    assert ingest.import_totals(again).first().total_cost_nano == t.total_cost_nano
    assert ingest.ledger(spark, catalogs.bundled(spark), pro).calls.count() == 0
    nowhere = ingest.ledger(spark, catalogs.bundled(spark), pro, f"{tmp_path}/none", f"{tmp_path}/none")
    assert (nowhere.calls.count(), nowhere.sessions.count(), nowhere.agents.count()) == (0, 0, 0)


def test_diagnose(spark, tmp_path):
    _, c = logs(tmp_path)
    got = {r.path.rsplit("/", 1)[1]: (r.calls_on_day, r.roots, r.dangling) for r in ingest.diagnose(spark, c, "sessions", "2026-08-01").collect()}
    assert got == {"a.jsonl": (2, 1, 0), "agent-9.jsonl": (1, 1, 0)}
    assert ingest.diagnose(spark, c, "hourly", "2026-08-01").where("calls > 0").first().calls == 3
    day = ingest.diagnose(spark, c, "aborts", "").first()
    assert (day.distinct_requests, day.occurrences) == (2, 3)


def test_commands(spark, tmp_path, capsys):
    k, c = logs(tmp_path)
    main(["--kimi", k, "--claude", c, "import"])
    assert json.loads(capsys.readouterr().out)["calls"] == 4
    main(["--kimi", k, "analyze-cache"])
    assert "| all | none |" in capsys.readouterr().out
    day = {"bucket": "2026-08-01", "group_key": "claude_fable_5", "cost_minor_units": 100, "request_count": 1, "tokens": {"input": 1, "output": 2, "cache_read": 3, "cache_write_5m": 4, "cache_write_1h": 5}}
    export = put(tmp_path / "export.json", json.dumps({"currency": "usd", "granularity": "daily", "group_by": "model_tier", "start_date": "2026-08-01", "end_date": "2026-08-01", "series": [day]}))
    main(["--claude", c, "--subscription", "pro", "audit", str(export), "--out", str(tmp_path / "out")])
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0].startswith("date,model_key,export_cost_usd,ledger_cost_usd,difference_cost_usd") and text[1].startswith("2026-08-01,claude-fable-5,1.0,0.00105,-0.99895")


def test_store_commands(spark, tmp_path, capsys):
    """A store followed, looked at again, metered once an account is known, and priced anew."""
    k, c = logs(tmp_path)
    told = lambda *given: main(list(given)) or json.loads(capsys.readouterr().out)
    store = ["--store", str(tmp_path / "store")]
    first = told("--kimi", k, "--claude", c, "follow", *store)
    assert (first["inserted"], first["discovered_sources"], first["removed"], first["errors"]) == (6, 4, 0, 0)
    assert told("--kimi", k, "--claude", c, "follow", *store)["lines"] == 0
    kimi = 100 * 3000 + 20 * 3000 + 300 * 300 + 40 * 15000
    assert told("reprice", *store) == {"call_count": 2, "total_cost_nano": 2 * kimi, "unpriced_call_count": 0}
    told("--claude", c, "--subscription", "pro", "follow", *store)
    assert told("reprice", *store) == {"call_count": 4, "total_cost_nano": 2 * kimi + 21 * 50000, "unpriced_call_count": 0}
    report = put(tmp_path / "report.json", json.dumps([{"totalCost": 1.5, "modelBreakdowns": [{"modelName": "claude-fable-5", "cost": 1.5}]}]))
    found = told("--claude", c, "--subscription", "pro", "audit-external", str(report))
    assert (found["external_usd"], found["calls"], found["ledger_usd"]) == (1.5, 2, 21 * 50000 / 1e9)
    main(["--claude", c, "--subscription", "pro", "diagnose", "replays", "--day", "2026-08-01"])
    assert "2026-08-01|claude-fable-5|2" in capsys.readouterr().out.replace(" ", "")


def test_csv_and_store(spark, tmp_path):
    df = spark.createDataFrame([('claude,"odd"', None, 1)], "a string, b string, c int")
    assert files.csv_lines(df).first().line == '"claude,""odd""",,1'
    assert json.loads(files.json_lines(df).first().line) == {"a": 'claude,"odd"', "b": None, "c": 1}
    files.write_csv(df, str(tmp_path / "csv"), one_file=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == 'a,b,c\n"claude,""odd""",,1\n'


def test_store(spark, tmp_path):
    """Commits are seen whole or not at all; buckets that a commit doesn't touch stay as they are."""
    store, schema = Store(spark, f"file://{tmp_path}/store"), "k string, n long"
    assert store.read("t", schema).count() == 0
    for n in range(4):
        store.publish("t", spark.createDataFrame([("a", n)], schema))
    assert store.versions() == [3, 4] and sorted(p.name for p in (tmp_path / "store/t").iterdir()) == ["v3", "v4"]
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(100)], schema)
    commit = store.begin()
    commit.write_buckets("u", rows, "k", range(64))
    assert store.read("u", schema).count() == 0 and commit.read("u", schema).count() == 100
    commit.publish()
    ((bucket,),) = rows.where("k = 'k7'").select(bucket_of("k")).collect()
    there = store.read("u", schema, [bucket])
    kept = there.where("k <> 'k7'").collect()
    commit = store.begin()
    commit.write_buckets("u", there.where("k <> 'k7'"), "k", [bucket])
    commit.publish()
    assert sorted(store.read("u", schema, [bucket]).collect()) == sorted(kept)
    assert sorted(r.n for r in store.read("u", schema).collect()) == [n for n in range(100) if n != 7]
    for _ in range(3):
        store.publish("t", spark.createDataFrame([("a", 9)], schema))
    assert store.read("u", schema).count() == 99
