"""The ledger's semantics on hand-made rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions import labels, times, usage
from meterlake.operators import audits, cache_window, canonical, diagnostics, metering, pricing, reconcile
from meterlake.operators.filters import Filters
from meterlake.operators.ordered import running
from meterlake.plans import dashboard
from meterlake.plans.testdata import Data
from meterlake.schemas import ACCOUNT_STATE, OCCURRENCE, TOKENS
from meterlake.sources import catalogs

KIMI, CLAUDE = "moonshot-ai/kimi-k3", "claude-fable-5"
BASE = {"source_path": "p", "generation": 0, "byte_offset": 10, "event_fingerprint": "f", "timestamp_ms": 1785585600000, "provider": "moonshotai", "raw_model": KIMI, "session_id": "s", "agent_id": "main", "provider_request_id": "r", "step_uuid": "u", "account_state_id": None, "is_metered": True, "metering_basis": "metered-api"} | dict(zip(TOKENS, (100, 20, 0, 0, 300, 40), strict=True))
NAMES = [c.split()[0] for c in OCCURRENCE.split(", ")]


def occurrences(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c)[n] for n in NAMES) for c in changes], OCCURRENCE)


def sessions(spark, **created):
    return spark.createDataFrame([(k, "moonshotai", f"ws-{k}", None, None, v, v) for k, v in created.items()], "session_id string, provider string, workspace_key string, work_directory string, title string, created_at_ms long, updated_at_ms long")


def agents(spark, *ids):
    return spark.createDataFrame([(s, a, a, a.title(), "main" if a == "main" else "sub") for s, a in ids], "session_id string, agent_id string, agent_key string, agent_label string, agent_type string")


def ms(text):
    return int(datetime.datetime.fromisoformat(text).timestamp() * 1000)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_new_york_days(spark):
    one, two = (value(spark, times.bucket_start_ms(F.lit(ms(t)), "day", "America/New_York")) for t in ("2026-03-08T16:00+00:00", "2026-03-09T16:00+00:00"))
    assert (one, two - one) == (ms("2026-03-08T05:00+00:00"), 23 * times.HOUR)
    assert value(spark, times.bucket_start_ms(F.lit(ms("2026-03-08T16:00+00:00")), "week", "UTC")) == ms("2026-03-02T00:00+00:00")
    assert [times.automatic_bucket(0, d * times.DAY) for d in (1 / 24, 30, 365, 1095)] == ["minute", "hour", "day", "week"]
    with pytest.raises(ValueError):
        times.checked_zone("No/Where")


def test_presets():
    now = ms("2026-03-10T12:00+00:00")
    assert times.preset_range("today", now, "America/New_York") == (ms("2026-03-10T04:00+00:00"), None)
    assert times.preset_range("last-month", now, "UTC") == (ms("2026-02-01T00:00+00:00"), ms("2026-03-01T00:00+00:00") - 1)
    assert times.preset_range("7d", now, "UTC")[0] == now - 7 * times.DAY and times.preset_range("all", now, "UTC") == (None, None)


def test_labels(spark):
    assert value(spark, labels.short_title(F.lit("  A﻿\n " + "A" * 60))) == "A " + "A" * 45 + "…"
    assert [value(spark, labels.usd(F.lit(n).cast("long"))) for n in (460_000_000, 0, 5_000_000, 12_345_678_901)] == ["$0.46", "$0.00", "$0.0050", "$12.35"]
    assert value(spark, labels.workspace_of(F.lit("C:\\work\\project\\"))) == "project"
    assert value(spark, labels.csv_field(F.lit('a"b'))) == '"a""b"' and value(spark, labels.csv_field(F.lit("a"))) == "a"
    assert value(spark, labels.bundled_date(F.lit(catalogs.KIMI))) == "2026-08-09" and value(spark, labels.bundled_date(F.lit("x"))) is None


def test_providers(spark):
    of = lambda m: (value(spark, usage.provider_of(F.lit(m))), value(spark, usage.model_key(F.lit(m))))
    assert [of(m) for m in ("claude-x", "Moonshot-AI/Kimi", "Other/a/b", "bare")] == [("anthropic", "claude-x"), ("moonshotai", "Kimi"), ("other", "a/b"), ("bare", "bare")]


def test_earliest_session_owns_a_replay(spark):
    both = occurrences(spark, {"session_id": "late", "source_path": "a"}, {"session_id": "early", "source_path": "b"})
    s = sessions(spark, late=20, early=10)
    call = canonical.canonicalize(both, s)
    assert call.first().session_id == "early" and call.count() == 1
    kinds = {r.session_id: r.replay_classification for r in canonical.classified(both, call).collect()}
    assert kinds == {"early": "original", "late": "fork-replay"}
    left = reconcile.without_sources(both, spark.createDataFrame([("b",)], "source_path string"))
    assert canonical.canonicalize(left, s).first().session_id == "late"
    assert canonical.replays(canonical.classified(both, call), call).count() == 1


def test_progress_and_crossing(spark):
    s = sessions(spark, s=1, t=2)
    take = lambda *rows: canonical.canonicalize(occurrences(spark, *rows), s).first()
    grown = take({"output_tokens": 5}, {"output_tokens": 20, "byte_offset": 20})
    assert (grown.output_tokens, grown.canonical_byte_offset) == (20, 10)
    cross = [{"input_other_tokens": 300, "output_tokens": 40}, {"input_other_tokens": 250, "output_tokens": 50, "byte_offset": 20}, {"input_other_tokens": 1, "output_tokens": 60, "session_id": "t", "source_path": "q"}]
    kimi, claude = take(*cross), take(*[c | {"provider": "anthropic", "raw_model": CLAUDE} for c in cross])
    assert (kimi.input_other_tokens, kimi.output_tokens) == (300, 40) and (claude.input_other_tokens, claude.output_tokens) == (250, 50)
    clash = occurrences(spark, {}, {"raw_model": "other", "byte_offset": 11})
    with pytest.raises(Exception, match="disagree"):
        canonical.canonicalize(clash, s).collect()
    assert canonical.conflicts(clash).count() == 1


def test_one_call_for_each_fingerprint_whatever_the_order(spark):
    rows = [{"event_fingerprint": f"f{i % 5}", "byte_offset": i, "output_tokens": i * 7 % 11, "source_path": f"p{i % 3}"} for i in range(40)]
    s = sessions(spark, s=1)
    one = sorted(map(tuple, canonical.canonicalize(occurrences(spark, *rows), s).collect()))
    two = sorted(map(tuple, canonical.canonicalize(occurrences(spark, *rows[::-1]).repartition(7), s).collect()))
    assert one == two and len(one) == 5
    stored = occurrences(spark, *rows)
    assert reconcile.record_once(stored, stored).count() == 40


def _random(seed: int) -> list[dict]:
    """Revisions of a few calls in transcripts of a few sessions, of equal ages too; no row is largest in all counters."""
    rng, rows = random.Random(seed), []
    for i in range(300):
        call, session = rng.randrange(40), rng.randrange(6)
        kind = {"provider": "anthropic", "raw_model": CLAUDE} if call % 2 else {}
        tokens = {"input_other_tokens": rng.randrange(9), "output_tokens": rng.randrange(9)}
        rows.append({"event_fingerprint": f"f{call}", "session_id": f"s{session}", "source_path": f"p{session}-{rng.randrange(2)}", "generation": rng.randrange(2), "byte_offset": i, "timestamp_ms": rng.randrange(50), **kind, **tokens})
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_known_sessions_take_one_aggregation(spark, seed):
    occ, s = occurrences(spark, *_random(seed)), sessions(spark, **{f"s{i}": i // 2 for i in range(6)})
    one = canonical.canonicalize(occ, s, known=True)
    two = canonical.canonicalize(occ, s)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert sorted(map(str, canonical.canonicalize(occ, s, checked=False, known=True).collect())) == sorted(map(str, two.collect()))
    first = canonical.attributed(occ, s)
    assert sorted(map(str, canonical.classified(occ, first).collect())) == sorted(map(str, canonical.classified(occ, two).collect()))
    plan = canonical.canonicalize(occ, s, known=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(event_fingerprint") == 1


def test_known_sessions_are_held_to_it(spark):
    with pytest.raises(Exception, match="no age is known"):
        canonical.canonicalize(occurrences(spark, {}), sessions(spark, t=1), known=True).collect()
    kind = {"provider": "anthropic", "raw_model": CLAUDE}
    two = occurrences(spark, kind | {"session_id": "t", "output_tokens": 9, "cache_read_tokens": 1}, kind | {"byte_offset": 11})
    with pytest.raises(Exception, match="a source of two sessions"):
        canonical.canonicalize(two.withColumn("input_other_tokens", F.col("byte_offset")), sessions(spark, s=1, t=1), known=True).collect()


def test_calls_carry_what_is_asked_for(spark):
    """Buffers that are shuffled hold no column that isn't asked for; the others are as in whole calls."""
    occ, s = occurrences(spark, *_random(3)), sessions(spark, **{f"s{i}": i // 2 for i in range(6)})
    occ = occ.withColumn("provider", F.when(F.col("event_fingerprint") != "f3", F.col("provider")))
    plan = lambda df: "".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan " not in x)
    for known in (True, False):
        whole, some = (canonical.canonicalize(occ, s, known=known, **k) for k in ({}, {"keep": ["raw_model", "is_metered"]}))
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*some.columns).collect()))
        assert "metering_basis" in plan(whole) and not any(c in plan(some) for c in ("provider_request_id", "metering_basis"))
    first = canonical.attributed(occ, s, known=True)
    assert sorted(map(str, first.collect())) == sorted(map(str, canonical.attributed(occ, s).collect()))
    assert "timestamp_ms" not in plan(first)
    with pytest.raises(Exception, match="no age is known"):
        canonical.attributed(occ, sessions(spark, t=1), known=True).collect()


def test_lines_go_by_order_without_their_flags(spark, tmp_path):
    day = datetime.datetime(1994, 1, 1)
    items = [(1, 5, 2, 3, 4.0, 5.0, 0.1, 0.2, flag, status, day) for flag in "NRN" for status in "OF"]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame([(1, 7, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    occ = Data(spark, str(tmp_path)).occurrences
    plan = occ._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "l_linestatus" not in plan and "SortMergeJoin [l_orderkey" in plan
    rows = [tuple(r) for r in occ.collect()]
    assert sorted(r[2] for r in rows) == [1, 2, 3, 4, 5, 6] and len({(*r[:2], *r[3:]) for r in rows}) == 1


def test_places_of_occurrences(spark, tmp_path):
    """As a window over each whole session gives them; only an order's lines are sorted together."""
    rng = random.Random(5)
    day = datetime.datetime(1994, 1, 1)
    orders = [(k, rng.randrange(120), day) for k in range(0, 400, 3)]
    items = [(rng.randrange(0, 420), rng.randrange(9), rng.randrange(4), rng.randrange(3), float(rng.randrange(3)), 5.0, 0.1, 0.2, "N", "O", day) for _ in range(900)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    occ = Data(spark, str(tmp_path)).occurrences
    customer = {k: c for k, c, _ in orders}
    want, at = [], {}
    for r in sorted((r for r in items if r[0] in customer), key=lambda r: (r[0], r[3], r[1], r[2], r[10], *r[4:10])):
        session = customer[r[0]] % 50
        at[session] = at.get(session, 0) + 1
        want.append((str(session), at[session], f"request:p{r[1] % 13}:{r[1]}-{r[2]}", int(r[4])))
    assert sorted(map(tuple, occ.select("session_id", "byte_offset", "event_fingerprint", "input_other_tokens").collect())) == sorted(want)
    windows = [x for x in occ._jdf.queryExecution().analyzed().toString().splitlines() if "Window [row_number" in x]
    assert windows and all("l_orderkey" in x.split("windowspecdefinition(")[1].split(",")[0] for x in windows)


def _rates(spark, **changes):
    flat = dict.fromkeys(("input_nano_per_token", "output_nano_per_token", "cache_read_nano_per_token", "cache_creation_nano_per_token", "cache_creation_5m_nano_per_token", "cache_creation_1h_nano_per_token"), 1)
    return {"rate_id": 1, "provider": "moonshotai", "model_key": "kimi-k3", "raw_alias": None, **flat, "source_name": "models.dev", "confidence": "exact", "effective_at_ms": None, "snapshot_id": None, "is_active": True} | changes


def test_prices_stick(spark):
    calls = canonical.canonicalize(occurrences(spark, {}), sessions(spark, s=1))
    one = catalogs.frame(spark, [_rates(spark)])
    first = pricing.price(calls, one)
    assert first.first().total_cost_nano == 460
    dear = catalogs.frame(spark, [_rates(spark), _rates(spark, rate_id=2, source_name="user-override", confidence="override", raw_alias=KIMI, **dict.fromkeys(["input_nano_per_token", "output_nano_per_token", "cache_read_nano_per_token", "cache_creation_nano_per_token"], 2))])
    assert pricing.sticky_price(calls, first, dear).first().total_cost_nano == 460
    assert pricing.price(calls, dear).first().total_cost_nano == 920
    more = calls.withColumn("output_tokens", F.lit(50).cast("long"))
    again = pricing.sticky_price(more, first, dear).first()
    assert (again.total_cost_nano, again.rate_id) == (470, 1)
    bare = pricing.price(calls, one.limit(0))
    assert bare.first().total_cost_nano is None and bare.first().pricing_confidence == "unpriced"
    assert pricing.sticky_price(calls, bare, one).first().total_cost_nano is None
    assert pricing.sticky_price(more, bare, one).first().total_cost_nano == 470
    assert pricing.price_unpriced(bare, one).first().total_cost_nano == 460


def test_rate_order(spark):
    calls = canonical.canonicalize(occurrences(spark, {}), sessions(spark, s=1))
    t = BASE["timestamp_ms"]
    pick = lambda *rows, snapshots=None: getattr(pricing.price(calls, catalogs.frame(spark, list(rows)), snapshots).first(), "rate_id")
    assert pick(_rates(spark, source_name="litellm"), _rates(spark, rate_id=2)) == 2
    assert pick(_rates(spark, effective_at_ms=5), _rates(spark, rate_id=2, effective_at_ms=9), _rates(spark, rate_id=3, effective_at_ms=t + 1)) == 2
    assert pick(_rates(spark, is_active=False)) is None and pick(_rates(spark), _rates(spark, rate_id=2)) == 1
    good = spark.createDataFrame([(1, True), (2, False)], "snapshot_id long, is_last_good boolean")
    assert pick(_rates(spark, snapshot_id=2), _rates(spark, rate_id=4, snapshot_id=1, source_name="litellm"), snapshots=good) == 4


def test_bundled(spark):
    r = {x["model_key"]: x for x in catalogs.bundled_rows()}
    assert [r["kimi-k3"][c] for c in ("input_nano_per_token", "cache_read_nano_per_token", "output_nano_per_token")] == [3000, 300, 15000]
    assert [r["claude-fable-5"][c] for c in ("input_nano_per_token", "cache_creation_5m_nano_per_token", "cache_creation_1h_nano_per_token", "cache_read_nano_per_token", "output_nano_per_token")] == [10000, 12500, 20000, 1000, 50000]


@pytest.mark.parametrize("limit", [10_000, 0])
def test_policies(spark, limit):
    states = spark.createDataFrame([(1, "pro", "pro-fable", 0), (2, "max", "subscription-excluded", 200), (3, "enterprise", "enterprise-api", 5 * times.DAY)], ACCOUNT_STATE)
    calls = spark.createDataFrame([(i, t, "anthropic", m) for i, (t, m) in enumerate([(50, CLAUDE), (150, "claude-opus-5"), (200, CLAUDE), (times.DAY, CLAUDE), (9 * times.DAY, CLAUDE), (-5, CLAUDE)])], "id int, timestamp_ms long, provider string, raw_model string")
    got = {r.id: r.state_id for r in metering.as_of(calls, states, limit).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: None}
    basis = [r.metering_basis for r in metering.meter(calls, states).orderBy("id").collect()]
    assert basis == ["pro-fable", "pro-subscription-excluded", "subscription-excluded", "subscription-excluded", "enterprise-api", "account-status-unavailable"]
    assert metering.meter(calls, states, 1).where("id = 5").first().metering_basis == "pro-fable"


def test_detections(spark):
    none = spark.createDataFrame([], ACCOUNT_STATE)
    one = metering.recorded_state(none, "pro", 100)
    assert tuple(one.first()) == (1, "pro", "pro-fable", 0)
    assert metering.recorded_state(one, "pro", 150).count() == 1
    assert [tuple(r) for r in metering.recorded_state(one, "max", 200).orderBy("account_state_id").collect()][1] == (2, "max", "subscription-excluded", 200)


def ledger(spark, *changes):
    occ = occurrences(spark, *[{"event_fingerprint": f"f{i}", "byte_offset": i} | c for i, c in enumerate(changes)])
    s = sessions(spark, s=1, t=2)
    own = canonical.canonicalize(occ, s)
    calls = pricing.price(own, catalogs.bundled(spark))
    return dashboard.Ledger(calls, s, agents(spark, ("s", "main"), ("s", "sub"), ("t", "main")), catalogs.bundled(spark), canonical.classified(occ, own))


def test_sums_agree(spark):
    led = ledger(spark, {}, {"agent_id": "sub", "timestamp_ms": BASE["timestamp_ms"] + 7_300_000}, {"session_id": "t", "raw_model": "moonshot-ai/none"}, {"is_metered": False, "session_id": "t"})
    f = Filters()
    top = dashboard.summary(led, f, BASE["timestamp_ms"]).first()
    for rows in (dashboard.series(led, f, "hour"), dashboard.series(led, f, "call"), dashboard.sessions(led, f), dashboard.models(led, f)):
        s = rows.agg(F.sum("call_count"), F.sum("total_cost_nano"), F.sum("unpriced_calls")).first()
        assert tuple(s) == (top.call_count, top.total_cost_nano, top.unpriced_calls) == (3, 2 * 1_050_000, 1)
    assert (top.cache_hit_ratio, top.replays_excluded) == (900 / 1260, 0)
    assert [r.observation for r in dashboard.timeseries(led, Filters(session_id="s"), 0).collect()] == [0, 1]
    empty = dashboard.summary(led, Filters(workspace="nowhere"), 0).first()
    assert (empty.call_count, empty.total_cost_nano, empty.unpriced_calls, empty.cache_hit_ratio) == (0, 0, None, 0.0)
    hidden = dashboard.sessions(led, f, private=True).first()
    assert (hidden.title, hidden.workspace_key, hidden.work_directory) == ("Hidden session", "Hidden workspace", None)


def test_chart(spark):
    at = [0, 3 * times.HOUR]
    points = spark.createDataFrame([(i, at[i], c, r, p, p, 0, t, 4) for i, (c, r, p, t) in enumerate([(1, 90_000, 100_000, 1), (3, 50_000, 100_000, 4)])], "observation long, bucket_start_ms long, total_cost_nano long, cache_read_tokens long, prompt_tokens long, peak_main_prompt_tokens long, peak_subagent_prompt_tokens long, cumulative_total_cost_nano long, end_total_cost_nano long")
    got = dashboard.chart_rows(points, "call").orderBy("observation").collect()
    assert [r.trailing_average_nano for r in got] == [1, 2] and [round(r.trailing_hit_ratio, 9) for r in got] == [0.9, 0.7]
    assert [r.idle_gap_ms for r in got] == [0, 3 * times.HOUR] and [r.context_rebuild for r in got] == [0, 1] and [r.remaining_nano for r in got] == [3, 0]
    assert [r.idle_gap_ms for r in dashboard.chart_rows(points, "hour").orderBy("observation").collect()] == [0, 2 * times.HOUR]


def test_chart_over_blocks(spark, monkeypatch):
    """Trailing sums and gaps reach over the edges of blocks."""
    monkeypatch.setattr(dashboard, "BLOCK", 30)
    points = spark.range(100).select(F.col("id").alias("observation"), (F.col("id") * 1000).alias("bucket_start_ms"), F.col("id").alias("total_cost_nano"), F.lit(1).alias("cache_read_tokens"), F.lit(2).alias("prompt_tokens"), F.lit(0).alias("peak_main_prompt_tokens"), F.lit(0).alias("peak_subagent_prompt_tokens"), F.lit(0).alias("cumulative_total_cost_nano"), F.lit(0).alias("end_total_cost_nano"))
    got = dashboard.chart_rows(points, "call").orderBy("observation").collect()
    assert [r.trailing_average_nano for r in got] == [sum(range(max(0, i - 19), i + 1)) / min(20, i + 1) for i in range(100)]
    assert all(r.idle_gap_ms == 0 for r in got)


def test_running_sums(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("lead"))
    got = running(df, F.col("lead"), 10, ["id"], {"total": F.col("id")}, "at").orderBy("lead", "id").collect()
    total = 0
    for i, r in enumerate(got):
        total += r.id
        assert (r["at"], r.total) == (i, total)


def test_split_day(spark):
    now = 100 * times.DAY
    of = lambda *ages: dashboard.archive_split_day(spark.createDataFrame([(now - a * times.DAY,) for a in ages], "updated_at_ms long"), now).first().split_day
    assert (of(2, 3, 4, 10, 20, 30), of(5, 5), of(0)) == (3, 5, 1)


def cache(spark, *rows):
    full = [(s, "main", "m", t * times.MINUTE, t * times.MINUTE, f"{i:03}", r, n, None, "h", "h") for i, (s, t, r, n) in enumerate(rows)]
    return spark.createDataFrame(full, "session_id string, agent_id string, model string, request_ms long, usage_ms long, event_fingerprint string, cache_read_tokens long, input_other_tokens long, message_count long, system_prompt_hash string, tools_hash string")


def test_change_point(spark):
    rows = []
    for k, (gap, hit) in enumerate([(59, True), (61, False), (70, False), (90, False)]):
        rows += [(f"s{k}", 0, 100_000, 500), (f"s{k}", gap, *((101_000, 500) if hit else (18_000, 83_000)))]
    found = cache_window.transitions(cache(spark, *rows))
    p = cache_window.change_point(found).first()
    assert (p.lower_ms, p.upper_ms, p.estimated_ms) == (59 * times.MINUTE, 61 * times.MINUTE, 60 * times.MINUTE)
    assert (p.after_hits, p.after_misses, p.after_sessions) == (0, 3, 3)
    assert {r.label: (r.hits, r.misses) for r in cache_window.gap_bands(found).collect()} == {"< 30 min": (0, 0), "30–50 min": (0, 0), "50–60 min": (1, 0), "60–75 min": (0, 2), "≥ 75 min": (0, 1)}
    assert cache_window.change_point(found.where("kind = 'hit'")).count() == 0
    report = cache_window.analyze(cache(spark, *rows)).first()
    assert report.all_change_point.after_misses == 3 and report.hits == 1 and report.cache_read_after_miss_median == 18_000


def test_hit_run(spark):
    rows = [("a", 30 * i, 100_000 + i, 500) for i in range(5)] + [("a", 125, 18_000, 83_000)] + [("b", 0, 100_000, 500), ("b", 0, 100_000, 500)]
    assert tuple(cache_window.longest_hit_run(cache_window.transitions(cache(spark, *rows))).first()) == (120 * times.MINUTE, 4)
    assert tuple(cache_window.longest_hit_run(cache_window.transitions(cache(spark, *rows[-2:]))).first()) == (0, 0)


def test_audit(spark):
    call = {"provider": "anthropic", "raw_model": CLAUDE, "timestamp_ms": ms("2026-08-02T02:00+00:00")}
    calls = pricing.price(canonical.canonicalize(occurrences(spark, call | dict.fromkeys(TOKENS, 0) | {"output_tokens": 580_000}), sessions(spark, s=1)), catalogs.bundled(spark))
    export = spark.createDataFrame([("2026-08-01", CLAUDE, 30.0, 1, 0, 580_000, 0, 0, 0)], "date string, model_key string, cost_usd double, request_count long, input long, output long, cache_read long, cache_write_5m long, cache_write_1h long")
    rows = audits.compared(calls, export, "2026-08-01", "2026-08-02", "America/New_York")
    assert rows.count() == 1 and audits.long(rows).count() == 3
    t = audits.totals(rows).first()
    assert (t.export_usd, t.ledger_usd, t.difference_usd, round(t.difference_percent, 2)) == (30, 29, -1, -3.33)
    assert audits.compared(calls, export, "2026-08-01", "2026-08-02", "UTC").count() == 2
    assert audits.status(calls).first().status == "compared" and audits.status(calls.limit(0)).first().status == "not-detected"


def test_diagnostics(spark):
    records = spark.createDataFrame([("p", 1, 0, "a"), ("p", 2, 5, "a"), ("q", 3, times.HOUR, None)], "path string, byte_offset long, timestamp_ms long, provider_request_id string")
    marks = spark.createDataFrame([(times.DAY, "interrupted")], "timestamp_ms long, kind string")
    got = {r.utc_day: r for r in diagnostics.aborts(records, marks).collect()}
    assert (got["1970-01-01"].distinct_requests, got["1970-01-01"].occurrences) == (2, 3) and got["1970-01-02"].interrupted == 1
    hours = diagnostics.hourly(records, "1970-01-01").orderBy("utc_hour").collect()
    assert len(hours) == 24 and [r.calls for r in hours[:3]] == [2, 1, 0]
    links = spark.createDataFrame([("p", "a", None), ("p", "b", "a"), ("p", "c", "zz"), ("q", "a", "b")], "path string, uuid string, parent_uuid string")
    assert {r.path: (r.roots, r.dangling) for r in diagnostics.chains(links).collect()} == {"p": (1, 1), "q": (0, 1)}


def test_filters():
    f = Filters.of_query({"from": "5", "to": "9", "agentType": "sub", "junk": "x", "model": ""})
    assert (f.from_ms, f.to_ms, f.agent_type, f.model) == (5, 9, "sub", None)
    for bad in ({"from": "9", "to": "5"}, {"from": "x"}, {"bucket": "year"}, {"timeZone": "No/Where"}):
        with pytest.raises(ValueError):
            Filters.of_query(bad)
