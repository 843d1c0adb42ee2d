"""DuckDB SQL for the queries of catalogue, over the same tables."""

from meterlake.plans.testdata import NOW, STATES, rate_rows
from meterlake.schemas import COSTS, RATES, TOKENS
from meterlake.sources.catalogs import VENDOR_MODELS

NY = "America/New_York"
DAY = 86_400_000


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _values(name: str, columns: list[str], rows: list) -> str:
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)})"


_RATE = ["rate_id", "provider", "model_key", "raw_alias", *RATES, "source_name", "confidence", "effective_at_ms"]
_ROWS = [[r[c] for c in _RATE] for r in rate_rows()]
RATE_CTE = _values("rates", _RATE, _ROWS)
BUNDLED_CTE = _values("bundled", _RATE, _ROWS[:13])
_PROMPT = "(" + " + ".join(TOKENS[:5]) + ")"


def _costs(r: str = "r") -> str:
    i, cr, rd, out = f"c.input_other_tokens * {r}.input_nano_per_token", f"(c.cache_creation_tokens * {r}.cache_creation_nano_per_token + c.cache_creation_5m_tokens * {r}.cache_creation_5m_nano_per_token + c.cache_creation_1h_tokens * {r}.cache_creation_1h_nano_per_token)", f"c.cache_read_tokens * {r}.cache_read_nano_per_token", f"c.output_tokens * {r}.output_nano_per_token"
    parts = [i, cr, rd, out, f"{i} + {cr} + {rd} + {out}"]
    return ", ".join(f"CAST({x} AS BIGINT) AS {n}" for x, n in zip(parts, COSTS, strict=True))


CALLS = f"""{BUNDLED_CTE},
e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS timestamp_ms, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
sessions AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN user_id % 2 = 0 THEN 'moonshotai' ELSE 'anthropic' END AS session_provider, 'ws-' || (user_id % 7) AS workspace_key, '/home/ws-' || (user_id % 7) AS work_directory,
         CASE WHEN user_id % 5 <> 0 THEN '  Session ' || user_id || repeat('  about costs', user_id % 7) END AS title, min(timestamp_ms) AS created_at_ms, max(timestamp_ms) AS updated_at_ms
  FROM e GROUP BY user_id),
raw AS (
  SELECT event_id, event_type, 'request:' || event_id AS event_fingerprint, timestamp_ms, CASE event_id % 4 WHEN 0 THEN 'moonshot-ai/kimi-k3' WHEN 1 THEN 'moonshot-ai/kimi-k2.6' WHEN 2 THEN 'claude-fable-5' ELSE 'claude-unknown' END AS raw_model,
         CASE WHEN event_id % 4 < 2 THEN 'moonshotai' ELSE 'anthropic' END AS provider, k * 10 + 1 AS input_other_tokens, event_id % 7 * 20 AS cache_creation_tokens, event_id % 5 * 10 AS cache_creation_5m_tokens,
         event_id % 3 * 10 AS cache_creation_1h_tokens, k * 1000 AS cache_read_tokens, CAST(floor(value * 100 + 0.5) AS BIGINT) AS output_tokens, CAST(user_id AS VARCHAR) AS session_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'main' WHEN event_type IN ('purchase', 'signup') THEN 'sub-' || (user_id % 3) ELSE 'x' END AS agent_id, event_type <> 'error' AS is_metered
  FROM e),
agents AS (SELECT DISTINCT session_id, agent_id, CASE WHEN agent_id = 'main' THEN 'main' WHEN agent_id = 'x' THEN 'unknown' ELSE 'sub' END AS agent_type, 'Agent ' || agent_id AS agent_label FROM raw),
calls AS (
  SELECT c.*, r.rate_id, r.provider || '/' || r.model_key AS resolved_model_key, r.input_nano_per_token AS rate_input_nano, coalesce(r.confidence, 'unpriced') AS pricing_confidence, coalesce(r.source_name, 'No matching rate') AS pricing_basis, {_costs()}
  FROM raw c LEFT JOIN bundled r ON r.provider = c.provider AND r.model_key = CASE WHEN position('/' IN c.raw_model) > 0 THEN substr(c.raw_model, position('/' IN c.raw_model) + 1) ELSE c.raw_model END),
v AS (
  SELECT c.*, s.session_provider, s.workspace_key, s.work_directory, s.title, s.created_at_ms, s.updated_at_ms, a.agent_type, a.agent_label, {_PROMPT} AS prompt,
         greatest(cache_read_tokens * rate_input_nano - cache_read_cost_nano, 0) AS extra_any
  FROM calls c JOIN sessions s USING (session_id) JOIN agents a USING (session_id, agent_id) WHERE is_metered),
m AS (SELECT *, CASE WHEN rate_id IS NOT NULL THEN extra_any END AS extra FROM v)"""

FILTERED = "timestamp_ms BETWEEN 1704400000000 AND 1706000000000 AND session_provider = 'moonshotai' AND agent_type = 'main'"


def _s(x: str, alias: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {alias}"


def _summary(where: str, midnight: str) -> str:
    sums = ", ".join(_s(c, c) for c in [*COSTS, "output_tokens", "cache_read_tokens"])
    return f"""WITH {CALLS}, f AS (SELECT * FROM m WHERE {where}),
active AS (SELECT session_id FROM f ORDER BY updated_at_ms DESC, timestamp_ms DESC, session_id DESC LIMIT 1)
SELECT count(*) AS call_count, {sums}, {_s(f"CASE WHEN timestamp_ms >= {midnight} THEN total_cost_nano END", "cost_today_nano")},
  {_s("CASE WHEN session_id = (SELECT session_id FROM active) THEN total_cost_nano END", "active_session_cost_nano")},
  CAST(sum(CASE WHEN total_cost_nano IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpriced_calls, {_s("prompt", "input_tokens")},
  round(CASE WHEN coalesce(sum(prompt), 0) = 0 THEN 0.0 ELSE sum(cache_read_tokens)::DOUBLE / sum(prompt)::DOUBLE END, 6) AS cache_hit_ratio
FROM f"""


def _local(unit: str, ms: str = "timestamp_ms", zone: str = NY) -> str:
    return f"epoch_ms(timezone('{zone}', date_trunc('{unit}', timezone('{zone}', to_timestamp({ms} / 1000.0)))))"


def _midnight(ms: int) -> str:
    return _local("day", str(ms))


_PARTS = COSTS[:4]
_CUMULATIVE = ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS cumulative_{c}" for c in _PARTS)
_RUNNING = f"""{_CUMULATIVE}, CAST(sum({' + '.join(_PARTS)}) OVER w AS BIGINT) AS cumulative_total_cost_nano,
  CAST(sum({' + '.join(_PARTS)} + no_cache_extra_cost_nano) OVER w AS BIGINT) AS cumulative_no_cache_cost_nano, CAST(row_number() OVER w - 1 AS BIGINT) AS observation"""


def _series_ctes(bucket: str, where: str) -> str:
    sums = ", ".join(_s(c, c) for c in [*COSTS, "cache_read_tokens"])
    return f"""{CALLS}, f AS (SELECT * FROM m WHERE {where}),
p AS (SELECT {bucket} AS bucket_start_ms, count(*) AS call_count, {sums}, {_s('extra', 'no_cache_extra_cost_nano')}, {_s('prompt', 'prompt_tokens')},
  CAST(coalesce(max(CASE WHEN agent_type <> 'sub' THEN prompt END), 0) AS BIGINT) AS peak_main_prompt_tokens, CAST(coalesce(max(CASE WHEN agent_type = 'sub' THEN prompt END), 0) AS BIGINT) AS peak_subagent_prompt_tokens,
  CAST(sum(CASE WHEN total_cost_nano IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpriced_calls FROM f GROUP BY 1),
q AS (SELECT *, {_RUNNING} FROM p WINDOW w AS (ORDER BY bucket_start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_CALL_CTES = f"""{CALLS}, f AS (SELECT * FROM m WHERE session_id = '7'),
p AS (SELECT event_fingerprint, timestamp_ms AS bucket_start_ms, CAST(1 AS BIGINT) AS call_count, {', '.join(f"coalesce({c}, 0) AS {c}" for c in COSTS)}, coalesce(extra, 0) AS no_cache_extra_cost_nano, cache_read_tokens, prompt AS prompt_tokens,
  CASE WHEN agent_type = 'sub' THEN 0 ELSE prompt END AS peak_main_prompt_tokens, CASE WHEN agent_type = 'sub' THEN prompt ELSE 0 END AS peak_subagent_prompt_tokens, CAST(CASE WHEN total_cost_nano IS NULL THEN 1 ELSE 0 END AS BIGINT) AS unpriced_calls FROM f),
q AS (SELECT *, {_RUNNING} FROM p WINDOW w AS (ORDER BY bucket_start_ms, event_fingerprint ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _chart(ctes: str, spacing: int, call: bool) -> str:
    rebuilt = "CASE WHEN peak_main_prompt_tokens > 0 AND prompt_tokens >= 20000 AND (prompt_tokens - cache_read_tokens)::DOUBLE / prompt_tokens >= 0.5 THEN 1 ELSE 0 END" if call else "0"
    return f"""WITH {ctes}
SELECT observation, bucket_start_ms, total_cost_nano, round(sum(total_cost_nano) OVER t / count(*) OVER t, 6) AS trailing_average_nano,
  round(CASE WHEN sum(prompt_tokens) OVER t = 0 THEN 0.0 ELSE (sum(cache_read_tokens) OVER t)::DOUBLE / (sum(prompt_tokens) OVER t)::DOUBLE END, 6) AS trailing_hit_ratio,
  round(CASE WHEN prompt_tokens = 0 THEN 0.0 ELSE cache_read_tokens::DOUBLE / prompt_tokens END, 6) AS hit_ratio,
  CAST(CASE WHEN bucket_start_ms - lag(bucket_start_ms) OVER o - {spacing} >= 3600000 THEN bucket_start_ms - lag(bucket_start_ms) OVER o - {spacing} ELSE 0 END AS BIGINT) AS idle_gap_ms,
  CAST({rebuilt} AS INTEGER) AS context_rebuild, CASE WHEN peak_main_prompt_tokens > 0 THEN peak_main_prompt_tokens END AS context_main, CASE WHEN peak_subagent_prompt_tokens > 0 THEN peak_subagent_prompt_tokens END AS context_subagent,
  CAST(last_value(cumulative_total_cost_nano) OVER (ORDER BY observation ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - cumulative_total_cost_nano AS BIGINT) AS remaining_nano
FROM q WINDOW o AS (ORDER BY observation), t AS (ORDER BY observation ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


_POINT = f"bucket_start_ms, call_count, {', '.join(COSTS)}, no_cache_extra_cost_nano, cache_read_tokens, prompt_tokens, peak_main_prompt_tokens, peak_subagent_prompt_tokens, unpriced_calls, {', '.join('cumulative_' + c for c in _PARTS)}, cumulative_total_cost_nano, cumulative_no_cache_cost_nano, observation"


def _sessions(where: str, private: bool = False) -> str:
    shown = "'Hidden workspace' AS workspace_key, CAST(NULL AS VARCHAR) AS work_directory, 'Hidden session' AS title" if private else "workspace_key, work_directory, title"
    return f"""WITH {CALLS}, g AS (SELECT session_id, any_value(workspace_key) AS workspace_key, any_value(work_directory) AS work_directory, any_value(title) AS title, any_value(created_at_ms) AS created_at_ms, max(timestamp_ms) AS last_call_at_ms,
  count(*) AS call_count, {_s('total_cost_nano', 'total_cost_nano')}, count(*) FILTER (total_cost_nano IS NULL) AS unpriced_calls FROM m WHERE {where} GROUP BY session_id)
SELECT session_id, {shown}, created_at_ms, last_call_at_ms, call_count, total_cost_nano, unpriced_calls, (SELECT count(*) FROM agents a WHERE a.session_id = g.session_id) AS agent_count, CAST(0 AS BIGINT) AS inherited_occurrences FROM g"""


OCC = f"""{RATE_CTE},
n AS (SELECT rate_id - 1 AS i, CASE WHEN provider = 'anthropic' THEN model_key ELSE 'moonshot-ai/' || model_key END AS name FROM rates WHERE rate_id <= 13),
occ AS (
  SELECT CAST(o_custkey % 50 AS VARCHAR) AS session_id, CAST(o_custkey % 50 AS VARCHAR) AS source_path, 788918400000 + (o_custkey % 50) * 17 % 50 * {DAY} AS created_ms,
    row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS byte_offset,
    'request:p' || (l_partkey % 13) || ':' || l_partkey || '-' || l_suppkey AS event_fingerprint, l_partkey, epoch_us(o_orderdate) // 1000 AS timestamp_ms, CASE WHEN l_partkey % 13 >= 10 THEN 'anthropic' ELSE 'moonshotai' END AS provider, n.name AS raw_model,
    CAST(floor(l_quantity) AS BIGINT) AS input_other_tokens, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS cache_creation_tokens, CAST(0 AS BIGINT) AS cache_creation_5m_tokens, CAST(0 AS BIGINT) AS cache_creation_1h_tokens,
    CAST(floor(l_extendedprice) AS BIGINT) AS cache_read_tokens, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS output_tokens, CASE WHEN l_partkey % 5 <> 0 THEN 'r' END AS request, l_partkey % 11 <> 0 AS is_metered
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN n ON n.i = l_partkey % 13),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_fingerprint ORDER BY created_ms, source_path, byte_offset) AS place, {', '.join(f'max({c}) OVER (PARTITION BY event_fingerprint) AS max_{c}' for c in TOKENS)} FROM occ),
firsts AS (SELECT * FROM ranked WHERE place = 1),
whole AS (SELECT event_fingerprint, bool_or({' AND '.join(f'{c} = max_{c}' for c in TOKENS)}) AS dominated FROM ranked GROUP BY 1),
lasts AS (SELECT r.event_fingerprint, {', '.join(f'arg_max(r.{c}, r.byte_offset) AS last_{c}' for c in TOKENS)} FROM ranked r JOIN firsts f ON f.event_fingerprint = r.event_fingerprint AND f.source_path = r.source_path GROUP BY 1),
canon AS (
  SELECT f.event_fingerprint, f.l_partkey, f.source_path AS canonical_source_path, f.byte_offset AS canonical_byte_offset, f.timestamp_ms, f.provider, f.raw_model, f.session_id, f.request, f.is_metered,
    {', '.join(f"CASE WHEN w.dominated THEN f.max_{c} WHEN f.provider = 'anthropic' THEN l.last_{c} ELSE f.{c} END AS {c}" for c in TOKENS)}
  FROM firsts f JOIN whole w USING (event_fingerprint) JOIN lasts l USING (event_fingerprint)),
classes AS (
  SELECT o.*, c.is_metered AS canonical_metered, o.source_path = c.canonical_source_path AND o.byte_offset = c.canonical_byte_offset AS is_canonical,
    CASE WHEN o.source_path = c.canonical_source_path AND o.byte_offset = c.canonical_byte_offset THEN 'original' WHEN o.source_path = c.canonical_source_path THEN 'superseded-usage' WHEN c.request IS NULL THEN 'possible-replay' ELSE 'fork-replay' END AS kind
  FROM occ o JOIN canon c USING (event_fingerprint))"""


def _priced(source: str, rates: str, name: str) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (pr) FROM (
    SELECT c.*, {_costs()}, r.rate_id, r.provider || '/' || r.model_key AS resolved_model_key, coalesce(r.confidence, 'unpriced') AS pricing_confidence,
      coalesce(r.source_name || CASE WHEN r.confidence = 'inferred' THEN '; cache creation uses the normal input rate' ELSE '' END, 'No matching rate') AS pricing_basis,
      row_number() OVER (PARTITION BY c.event_fingerprint ORDER BY CASE r.source_name WHEN 'user-override' THEN 0 WHEN 'models.dev' THEN 1 WHEN 'anthropic' THEN 1 WHEN 'litellm' THEN 2 ELSE 3 END, coalesce(r.effective_at_ms, 0) DESC, r.rate_id) AS pr
    FROM {source} c LEFT JOIN {rates} r ON (r.raw_alias = c.raw_model OR r.raw_alias IS NULL AND r.provider = c.provider AND r.model_key = CASE WHEN position('/' IN c.raw_model) > 0 THEN substr(c.raw_model, position('/' IN c.raw_model) + 1) ELSE c.raw_model END)
      AND (r.effective_at_ms IS NULL OR r.effective_at_ms <= c.timestamp_ms)) WHERE pr = 1)"""


_MEASURES = ["cost_usd", "request_count", "input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_untyped"]
_AUDIT_COLUMNS = dict(zip(_MEASURES[2:], ["input_other_tokens", "output_tokens", "cache_read_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "cache_creation_tokens"], strict=True))
_LOCAL_DAY = f"strftime(timezone('{NY}', to_timestamp(timestamp_ms / 1000.0)), '%Y-%m-%d')"
_UTC_DAY = "strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d')"
_PLAIN = "CASE WHEN position('/' IN raw_model) > 0 THEN substr(raw_model, position('/' IN raw_model) + 1) ELSE raw_model END"
AUDIT = f"""{CALLS},
ranged AS (SELECT *, {_LOCAL_DAY} AS date, {_PLAIN} AS model FROM calls WHERE provider = 'anthropic'),
inside AS (SELECT * FROM ranged WHERE date BETWEEN '2024-01-03' AND '2024-01-20'),
ours AS (SELECT date, model AS model_key, sum(coalesce(total_cost_nano, 0))::DOUBLE / 1e9 AS cost_usd, count(*) AS request_count, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {m}' for m, c in _AUDIT_COLUMNS.items())} FROM inside WHERE is_metered GROUP BY 1, 2),
days AS (SELECT {_UTC_DAY} AS date, sum(total_cost_nano) AS c, count(*) AS n, {', '.join(f'sum({c}) AS {c}' for c in TOKENS)} FROM calls WHERE provider = 'anthropic' AND is_metered AND raw_model = 'claude-fable-5' GROUP BY 1),
fable AS (SELECT date, CAST(substr(date, 9, 2) AS INTEGER) % 3 AS o, * EXCLUDE (date) FROM days WHERE date BETWEEN '2024-01-03' AND '2024-01-20'),
theirs AS (SELECT date, model_key, (CAST(c AS BIGINT) // 10000000 + o * 25) / 100.0::DOUBLE AS cost_usd, n + o AS request_count, CAST(input_other_tokens + o AS BIGINT) AS input, CAST(output_tokens AS BIGINT) AS output, CAST(cache_read_tokens AS BIGINT) AS cache_read,
  CAST(cache_creation_5m_tokens AS BIGINT) AS cache_write_5m, CAST(cache_creation_1h_tokens + o AS BIGINT) AS cache_write_1h, CAST(0 AS BIGINT) AS cache_write_untyped FROM fable, (VALUES ('claude-fable-5'), ('claude-haiku-4-5-20251001')) k(model_key)),
both_ AS (SELECT coalesce(a.date, b.date) AS date, coalesce(a.model_key, b.model_key) AS model_key, {', '.join(f'coalesce(b.{m}, 0) AS export_{m}, coalesce(a.{m}, 0) AS ledger_{m}, coalesce(a.{m}, 0) - coalesce(b.{m}, 0) AS difference_{m}' for m in _MEASURES)}
  FROM ours a FULL JOIN theirs b ON a.date = b.date AND a.model_key = b.model_key)"""


def _round(column: str) -> str:
    return f"round({column}, 6) AS {column}" if column.endswith("cost_usd") else column


CACHE = f"""e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 12000 AS request_ms, 'request:' || event_id AS fp FROM events),
g AS (SELECT *, request_ms - lag(request_ms) OVER (PARTITION BY user_id ORDER BY request_ms, fp) AS gap FROM e),
c AS (SELECT fp, CAST(user_id AS VARCHAR) AS session_id, request_ms, k, CASE WHEN coalesce(gap > 3600000, false) OR event_id % 101 = 0 THEN 18000 ELSE 100000 + k * 10 END AS read, CASE WHEN coalesce(gap > 3600000, false) OR event_id % 101 = 0 THEN 83000 + k * 10 ELSE 500 END AS input,
  CASE WHEN event_id % 97 = 0 THEN 'sys-b' ELSE 'sys-a' END AS sys, row_number() OVER (ORDER BY request_ms, fp) AS gp, row_number() OVER (PARTITION BY user_id ORDER BY request_ms, fp) AS sp FROM g),
l AS (SELECT *, lag(request_ms) OVER s AS p_ms, lag(read) OVER s AS p_read, lag(input) OVER s AS p_input, lag(sys) OVER s AS p_sys, lag(gp) OVER s AS p_gp, lag(sp) OVER s AS p_sp FROM c WINDOW s AS (PARTITION BY session_id ORDER BY request_ms, fp)),
x AS (SELECT *, request_ms - p_ms AS gap_ms, (input + read)::DOUBLE / (p_input + p_read) AS size FROM l WHERE p_ms IS NOT NULL)"""


def _kinds(least: int) -> str:
    return f"""y AS (SELECT *, CASE WHEN gap_ms < 0 THEN 'invalidChronology' WHEN p_read < {least} THEN 'insufficientPriorCache' WHEN sys <> p_sys THEN 'requestConfigurationChanged' WHEN size < 0.8 OR size > 1.25 THEN 'promptSizeChanged' END AS reason FROM x),
t AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN read::DOUBLE / p_read >= 0.9 THEN 'hit' WHEN read::DOUBLE / p_read <= 0.5 AND p_read > read AND input >= 0.8::DOUBLE * (p_read - read) THEN 'miss' ELSE 'ambiguous' END AS kind FROM y),
low AS (SELECT max(gap_ms) AS lower_ms FROM t WHERE kind = 'hit'), high AS (SELECT min(gap_ms) AS upper_ms FROM t, low WHERE kind = 'miss' AND gap_ms > lower_ms)"""


_CACHE = f"WITH {CACHE}, {_kinds(65536)}"
TURNS = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn AS byte_offset, role, conv_id || '-' || turn AS uuid, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_uuid, length(text) % 5 <> 0 AS accepted, 1704067200000 + conv_id * 60000 + turn * 1000 AS timestamp_ms FROM conversations WHERE (conv_id * 31 + turn) % 17 <> 0)"
_CHAIN = f"{TURNS}, chain AS (SELECT path, count(*) FILTER (parent_uuid IS NULL) AS roots, count(*) FILTER (parent_uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM turns u WHERE u.path = t.path AND u.uuid = t.parent_uuid)) AS dangling FROM turns t GROUP BY path)"
_INTEGRITY = f"""{_CHAIN}, day AS (SELECT path, strftime(make_timestamp(min(timestamp_ms) * 1000), '%H:%M:%S') AS first_utc, strftime(make_timestamp(max(timestamp_ms) * 1000), '%H:%M:%S') AS last_utc, count(*) AS calls_on_day FROM turns WHERE role = 'assistant' AND {_UTC_DAY} = '2024-01-01' GROUP BY path),
integrity AS (SELECT path, first_utc, last_utc, calls_on_day, roots, dangling, (SELECT count(*) FROM turns u WHERE u.path = d.path AND NOT accepted) AS malformed FROM day d JOIN chain USING (path))"""
_AGE = f"(({NOW} - updated_at_ms) // {DAY})"
_OPTIONS = f"""{CALLS}, spend AS (SELECT s.*, t.cost FROM sessions s JOIN (SELECT session_id, sum(total_cost_nano) AS cost FROM calls WHERE is_metered GROUP BY 1) t USING (session_id) WHERE cost > 0)"""


def _split(source: str) -> str:
    return f"""ages AS (SELECT {_AGE} AS age FROM {source} WHERE {_AGE} >= 1), kinds AS (SELECT age, (SELECT count(*) FROM ages b WHERE b.age <= a.age)::DOUBLE / (SELECT count(*) FROM ages) AS share FROM (SELECT DISTINCT age FROM ages) a),
split AS (SELECT coalesce((SELECT age FROM kinds WHERE age < (SELECT max(age) FROM kinds) OR (SELECT count(*) FROM kinds) = 1 ORDER BY abs(share - 0.3::DOUBLE), age LIMIT 1), 1) AS d)"""


_RANKED = f"""o AS (SELECT *, {_AGE} AS age, CASE WHEN {_AGE} < 1 THEN 0 WHEN {_AGE} <= d THEN 1 ELSE 2 END AS rank_ FROM spend, split),
opt AS (SELECT *, CASE rank_ WHEN 0 THEN 'Last 24 hours' WHEN 1 THEN CASE WHEN d = 1 THEN '1 day ago' ELSE '1–' || d || ' days ago' END ELSE (d + 1) || '+ days ago' END AS grp, trim(regexp_replace(coalesce(title, session_id), '\\s+', ' ', 'g')) AS flat, {NOW} - updated_at_ms AS old FROM o)"""
_USD = "'$' || CASE WHEN cost < 10000000 THEN CAST(CAST(floor(cost / 100000.0 + 0.5) / 10000 AS DECIMAL(20, 4)) AS VARCHAR) ELSE CAST(CAST((CAST(cost AS BIGINT) + 5000000) // 10000000 / 100.0 AS DECIMAL(20, 2)) AS VARCHAR) END"
_LABEL = f"CASE WHEN old < 3600000 THEN (old // 60000) || 'm' WHEN old < {DAY} THEN (old // 3600000) || 'h' ELSE (old // {DAY}) || 'd' END || ' · ' || {_USD} || ' · ' || CASE WHEN length(flat) <= 48 THEN flat ELSE substr(flat, 1, 47) || '…' END || ' · ' || workspace_key"

ORACLES = {
    "summary": _summary("true", _midnight(NOW - 4 * DAY)),
    "summary_filtered": _summary(FILTERED, _midnight(NOW - 14 * DAY)),
    "timeseries_minute": f"WITH {_series_ctes('timestamp_ms // 60000 * 60000', 'true')} SELECT {_POINT} FROM q",
    "timeseries_hour": f"WITH {_series_ctes('timestamp_ms // 3600000 * 3600000', 'true')} SELECT {_POINT} FROM q",
    "timeseries_day_ny": f"WITH {_series_ctes(_local('day'), 'true')} SELECT {_POINT} FROM q",
    "timeseries_week_ny": f"WITH {_series_ctes(_local('week'), FILTERED)} SELECT {_POINT} FROM q",
    "timeseries_call": f"WITH {_CALL_CTES} SELECT event_fingerprint, {_POINT} FROM q",
    "auto_bucket": f"WITH {CALLS}, r AS (SELECT min(timestamp_ms) AS from_ms, max(timestamp_ms) AS to_ms FROM m WHERE {FILTERED}) SELECT from_ms, to_ms, CASE WHEN to_ms - from_ms <= 21600000 THEN 'minute' WHEN to_ms - from_ms <= {90 * DAY} THEN 'hour' WHEN to_ms - from_ms <= {730 * DAY} THEN 'day' ELSE 'week' END AS resolution FROM r",
    "chart_rows_trailing": _chart(_CALL_CTES, 0, True),
    "chart_rows_hour": _chart(_series_ctes("timestamp_ms // 3600000 * 3600000", "true"), 3600000, False),
    "sessions_by_cost": _sessions("true"),
    "sessions_recent": _sessions(FILTERED),
    "sessions_start": _sessions("workspace_key = 'ws-3'"),
    "sessions_private": _sessions("true", True),
    "agents_in_session": f"WITH {CALLS} SELECT session_id, agent_id AS agent_key, agent_type, min(agent_label) AS agent_label, count(*) AS call_count, {_s('total_cost_nano', 'total_cost_nano')}, count(*) FILTER (total_cost_nano IS NULL) AS unpriced_calls FROM m WHERE session_id = '7' AND timestamp_ms >= 1704400000000 GROUP BY 1, 2, 3",
    "models": f"""WITH {CALLS} SELECT c.raw_model, c.resolved_model_key, c.pricing_confidence, c.pricing_basis, count(*) AS call_count, {_s('total_cost_nano', 'total_cost_nano')}, CAST(sum({' + '.join(TOKENS)}) AS BIGINT) AS total_tokens, count(*) FILTER (total_cost_nano IS NULL) AS unpriced_calls,
      {', '.join(f"round(max(b.{r}) / 1000.0::DOUBLE, 6) AS {r.removesuffix('_nano_per_token')}_usd_per_million" for r in RATES)} FROM m c LEFT JOIN bundled b ON b.rate_id = c.rate_id GROUP BY 1, 2, 3, 4""",
    "options_workspaces": f"WITH {CALLS}, w AS (SELECT DISTINCT workspace_key AS value FROM m) SELECT 'Workspace ' || row_number() OVER (ORDER BY value) AS label, value FROM w",
    "options_models": f"WITH {CALLS} SELECT DISTINCT raw_model AS value FROM m WHERE session_provider = 'moonshotai'",
    "options_providers": f"WITH {CALLS} SELECT DISTINCT provider AS value, CASE provider WHEN 'anthropic' THEN 'Claude' WHEN 'moonshotai' THEN 'Kimi' ELSE provider END AS label FROM m",
    "options_agents": f"WITH {CALLS} SELECT agent_id AS value, min(agent_label) AS label FROM m WHERE session_provider = 'anthropic' GROUP BY 1",
    "options_sessions": f"WITH {_OPTIONS}, {_split('spend')}, {_RANKED} SELECT session_id AS value, {_LABEL} AS label, session_provider AS provider, workspace_key AS workspace, grp AS recency_group, CAST(rank_ AS INTEGER) AS recency_rank, CAST(cost AS BIGINT) AS total_cost_nano, updated_at_ms FROM opt",
    "options_grouped": f"WITH {_OPTIONS.replace('WHERE cost > 0', 'WHERE cost > 0 AND session_provider = ' + chr(39) + 'moonshotai' + chr(39))}, {_split('spend')}, {_RANKED} SELECT CAST(rank_ AS INTEGER) AS recency_rank, grp AS recency_group, count(*) AS options, first(session_id ORDER BY cost DESC, updated_at_ms DESC, session_id) AS first_option FROM opt GROUP BY 1, 2",
    "archive_split": f"WITH {CALLS}, {_split('sessions')} SELECT CAST(d AS BIGINT) AS split_day FROM split",
    "health_counts": f"WITH {CALLS} SELECT count(*) FILTER (is_metered) AS calls, count(DISTINCT session_id) FILTER (is_metered) AS sessions, count(*) AS all_calls, count(*) FILTER (is_metered AND total_cost_nano IS NULL) AS unpriced_calls, min(timestamp_ms) FILTER (is_metered) AS first_call_ms, max(timestamp_ms) FILTER (is_metered) AS last_call_ms, (SELECT count(*) FROM agents) AS agents, (SELECT count(*) FROM agents WHERE agent_type = 'sub') AS subagents FROM calls",
    "canonical_calls": f"WITH {OCC} SELECT event_fingerprint, canonical_source_path, canonical_byte_offset, timestamp_ms, provider, raw_model, session_id, is_metered, {', '.join(TOKENS)} FROM canon",
    "replay_classification": f"WITH {OCC}, d AS (SELECT *, {_UTC_DAY} AS utc_day FROM classes WHERE provider = 'anthropic' AND is_metered) SELECT utc_day, raw_model, count(*) FILTER (kind = 'original') AS canonical, count(*) FILTER (kind = 'fork-replay') AS fork_replay, count(*) FILTER (kind = 'possible-replay') AS possible_replay, count(*) FILTER (kind = 'superseded-usage') AS superseded FROM d WHERE utc_day BETWEEN '1993-01-01' AND '1997-12-31' GROUP BY 1, 2",
    "replay_count": f"WITH {OCC} SELECT count(*) AS replays FROM classes WHERE NOT is_canonical AND kind <> 'superseded-usage' AND canonical_metered",
    "replay_by_session": f"WITH {OCC} SELECT session_id, count(*) AS replays FROM classes WHERE NOT is_canonical AND kind <> 'superseded-usage' AND canonical_metered AND CAST(session_id AS INTEGER) % 2 = 1 GROUP BY 1",
    "rate_best_match": f"WITH {OCC}, o2 AS (SELECT source_path || '-' || byte_offset AS event_fingerprint, raw_model, provider, timestamp_ms, {', '.join(TOKENS)} FROM occ), {_priced('o2', 'rates', 'pz')} SELECT raw_model, rate_id, count(*) AS occurrences, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM pz GROUP BY 1, 2",
    "priced_calls": f"WITH {OCC}, {_priced('canon', 'rates', 'pz')} SELECT event_fingerprint, {', '.join(COSTS)}, rate_id, resolved_model_key, pricing_confidence, pricing_basis FROM pz",
    "reprice_totals": f"WITH {OCC}, {_priced('canon', 'rates', 'pz')} SELECT count(*) AS calls, count(total_cost_nano) AS priced_calls, count(*) - count(total_cost_nano) AS unpriced_calls, {_s('total_cost_nano', 'total_cost_nano')} FROM pz",
    "sticky_price": f"""WITH {OCC}, {BUNDLED_CTE}, before_ AS (SELECT * REPLACE (output_tokens + CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS output_tokens) FROM canon WHERE l_partkey % 3 <> 0), {_priced('before_', 'bundled', 'old')}, {_priced('canon', 'rates', 'new')},
      again AS (SELECT c.event_fingerprint, {_costs()} FROM canon c JOIN old o USING (event_fingerprint) JOIN rates r ON r.rate_id = o.rate_id)
      SELECT n.event_fingerprint, CASE WHEN o.event_fingerprint IS NULL THEN n.total_cost_nano WHEN o.output_tokens = n.output_tokens THEN o.total_cost_nano ELSE a.total_cost_nano END AS total_cost_nano, coalesce(o.rate_id, n.rate_id) AS rate_id, coalesce(o.pricing_confidence, n.pricing_confidence) AS pricing_confidence
      FROM new n LEFT JOIN old o USING (event_fingerprint) LEFT JOIN again a USING (event_fingerprint)""",
    "metering_asof": f"""WITH {CALLS}, {_values('st', ['id', 'sub', 'policy', 'since'], STATES)}, z AS (SELECT r.event_fingerprint, r.provider, r.raw_model, arg_max(st.id, st.since) AS id, arg_max(st.policy, st.since) AS policy FROM raw r LEFT JOIN st ON st.since <= r.timestamp_ms GROUP BY 1, 2, 3),
      b AS (SELECT *, CASE WHEN provider <> 'anthropic' THEN 'metered-api' WHEN policy IS NULL THEN 'account-status-unavailable' WHEN policy = 'enterprise-api' THEN 'enterprise-api' WHEN policy = 'pro-fable' THEN CASE WHEN raw_model = 'claude-fable-5' THEN 'pro-fable' ELSE 'pro-subscription-excluded' END ELSE 'subscription-excluded' END AS basis FROM z)
      SELECT event_fingerprint, CAST(CASE WHEN provider = 'anthropic' THEN id END AS BIGINT) AS account_state_id, basis IN ('metered-api', 'enterprise-api', 'pro-fable') AS is_metered, basis AS metering_basis FROM b""",
    "audit_usage_wide": f"WITH {AUDIT} SELECT date, model_key, {', '.join(_round(f'{s}_{m}') for m in _MEASURES for s in ('export', 'ledger', 'difference'))} FROM both_",
    "audit_usage_long": f"WITH {AUDIT} " + " UNION ALL ".join(f"SELECT date, model_key, '{s}' AS source, {', '.join((f'round({s}_{m}, 6)' if m == 'cost_usd' else f'{s}_{m}') + f' AS {m}' for m in _MEASURES)} FROM both_" for s in ("export", "ledger", "difference")),
    "audit_model_deviation": f"WITH {AUDIT} SELECT model_key, round(sum(export_cost_usd), 6) AS export_usd, round(sum(ledger_cost_usd), 6) AS ledger_usd, round(sum(ledger_cost_usd) - sum(export_cost_usd), 6) AS difference_usd FROM both_ GROUP BY 1",
    "audit_totals": f"WITH {AUDIT} SELECT round(sum(export_cost_usd), 6) AS export_usd, round(sum(ledger_cost_usd), 6) AS ledger_usd, CAST(sum(export_request_count) AS BIGINT) AS export_requests, CAST(sum(ledger_request_count) AS BIGINT) AS ledger_requests, round(sum(ledger_cost_usd) - sum(export_cost_usd), 6) AS difference_usd, round(CASE WHEN sum(export_cost_usd) <> 0 THEN (sum(ledger_cost_usd) - sum(export_cost_usd)) / sum(export_cost_usd) * 100 END, 6) AS difference_percent FROM both_",
    "audit_gaps": f"WITH {AUDIT} SELECT count(*) FILTER (NOT is_metered) AS unmetered_calls, count(*) FILTER (is_metered AND total_cost_nano IS NULL) AS unpriced_calls FROM inside",
    "audit_external_split": f"WITH {CALLS}, ext(model_key, cost_usd) AS (VALUES ('claude-fable-5', 1250.5::DOUBLE), ('claude-opus-5', 10.25::DOUBLE), ('claude-unknown', 3.75::DOUBLE)) SELECT model_key, cost_usd, model_key IN (SELECT raw_model FROM calls WHERE provider = 'anthropic' AND is_metered) AS is_metered FROM ext",
    "audit_external": f"""WITH {CALLS}, ext(model_key, cost_usd) AS (VALUES ('claude-fable-5', 1250.5::DOUBLE), ('claude-opus-5', 10.25::DOUBLE), ('claude-unknown', 3.75::DOUBLE)), s AS (SELECT *, model_key IN (SELECT raw_model FROM calls WHERE provider = 'anthropic' AND is_metered) AS mm FROM ext),
      a AS (SELECT coalesce(sum(CASE WHEN mm THEN cost_usd END), 0) AS external_usd, count(*) FILTER (NOT mm) AS unmetered_models FROM s), b AS (SELECT coalesce(sum(total_cost_nano), 0)::DOUBLE / 1e9 AS ledger_usd, count(*) AS calls, count(*) FILTER (total_cost_nano IS NULL) AS unpriced_calls FROM calls WHERE provider = 'anthropic' AND is_metered)
      SELECT round(external_usd, 6) AS external_usd, unmetered_models, round(ledger_usd, 6) AS ledger_usd, calls, unpriced_calls, round(ledger_usd - external_usd, 6) AS difference_usd, round((ledger_usd - external_usd) / external_usd * 100, 6) AS difference_percent FROM a, b""",
    "diag_hourly": f"WITH {CALLS} SELECT lpad(CAST(h AS VARCHAR), 2, '0') AS utc_hour, (SELECT count(*) FROM calls WHERE {_UTC_DAY} = '2024-01-10' AND timestamp_ms // 3600000 % 24 = h) AS calls FROM range(24) r(h)",
    "diag_aborts": f"""WITH {CALLS}, r AS (SELECT {_UTC_DAY} AS utc_day, event_type, event_id % 3 AS k, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 500 AS VARCHAR) ELSE session_id || '#' || event_id END AS request FROM raw)
      SELECT utc_day, count(DISTINCT request) FILTER (event_type <> 'error') AS distinct_requests, count(*) FILTER (event_type <> 'error') AS occurrences, count(*) FILTER (event_type = 'error' AND k = 0) AS interrupted, count(*) FILTER (event_type = 'error' AND k = 1) AS api_error, count(*) FILTER (event_type = 'error' AND k = 2) AS streaming_snapshot FROM r GROUP BY 1""",
    "diag_sessions": f"WITH {_INTEGRITY} SELECT * FROM integrity",
    "diag_suspects": f"WITH {_INTEGRITY} SELECT count(*) FILTER (dangling > 0 OR roots > 1 OR malformed > 0) AS suspect_sessions FROM integrity",
    "chain_dangling": f"WITH {_CHAIN} SELECT * FROM chain",
    "cache_transitions": f"{_CACHE} SELECT fp AS event_fingerprint, session_id, gap_ms, kind, reason, CAST(read AS BIGINT) AS cache_read_tokens, CAST(p_read AS BIGINT) AS previous_cache_read_tokens, round(size, 6) AS prompt_size_ratio, gp - p_gp - 1 AS intervening_global, sp - p_sp - 1 AS intervening_session FROM t",
    "cache_exclusions": f"{_CACHE} SELECT reason, count(*) AS transitions FROM t WHERE kind = 'excluded' GROUP BY 1",
    "cache_gap_bands": f"{_CACHE}, b(band, label, lo, hi) AS (VALUES (0, '< 30 min', -1e18, 30), (1, '30–50 min', 30, 50), (2, '50–60 min', 50, 60), (3, '60–75 min', 60, 75), (4, '≥ 75 min', 75, 1e18)) SELECT CAST(band AS INTEGER) AS band, label, count(*) FILTER (kind = 'hit') AS hits, count(*) FILTER (kind = 'miss') AS misses FROM b LEFT JOIN t ON gap_ms >= lo * 60000 AND gap_ms < hi * 60000 AND kind IN ('hit', 'miss') GROUP BY 1, 2",
    "cache_change_point": f"""{_CACHE} SELECT lower_ms, upper_ms, count(*) FILTER (gap_ms <= lower_ms AND kind = 'hit') AS before_hits, count(*) FILTER (gap_ms <= lower_ms AND kind = 'miss') AS before_misses, count(*) FILTER (gap_ms >= upper_ms AND kind = 'hit') AS after_hits, count(*) FILTER (gap_ms >= upper_ms AND kind = 'miss') AS after_misses,
      count(DISTINCT strftime(make_timestamp(request_ms * 1000), '%Y-%m-%d')) FILTER (gap_ms >= upper_ms) AS after_days, count(DISTINCT session_id) FILTER (gap_ms >= upper_ms) AS after_sessions, count(DISTINCT session_id) FILTER (gap_ms >= upper_ms) AS after_streams, (lower_ms + upper_ms) / 2.0::DOUBLE AS estimated_ms
      FROM t, low, high WHERE kind IN ('hit', 'miss') AND upper_ms IS NOT NULL GROUP BY lower_ms, upper_ms""",
    "cache_hit_run": f"""{_CACHE}, i AS (SELECT *, sum(CASE WHEN kind = 'hit' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY request_ms, fp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island, min(request_ms) OVER (PARTITION BY session_id) AS began FROM t),
      r AS (SELECT *, sum(gap_ms) OVER w AS run_ms, count(*) OVER w AS n FROM i WHERE kind = 'hit' WINDOW w AS (PARTITION BY session_id, island ORDER BY request_ms, fp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT CAST(run_ms AS BIGINT) AS run_ms, n AS run_length FROM r WHERE run_ms > 0 ORDER BY run_ms DESC, began, request_ms, fp LIMIT 1""",
    "cache_median": f"{_CACHE} SELECT median(read)::DOUBLE AS cache_read_after_miss_median FROM t WHERE kind = 'miss'",
    "cache_sensitivity": " UNION ALL ".join(f"SELECT * FROM (WITH {CACHE}, {_kinds(n)} SELECT CAST({n} AS BIGINT) AS min_cache_read, (SELECT count(*) FROM t WHERE kind IN ('hit', 'miss')) AS classified, CASE WHEN upper_ms IS NOT NULL THEN lower_ms END AS lower_ms, upper_ms FROM low, high)" for n in (65536, 98304, 131072)),
    "carry_forward_identity": f"""WITH {TURNS}, u AS (SELECT *, role = 'assistant' AS turn_, role = 'assistant' AND accepted AS used FROM turns), l AS (SELECT * FROM u WHERE used),
      x AS (SELECT l.path, l.byte_offset, coalesce((SELECT max(b.byte_offset) FROM u b WHERE b.path = l.path AND b.byte_offset < l.byte_offset AND b.used), -1) AS after_used, coalesce((SELECT max(b.byte_offset) FROM u b WHERE b.path = l.path AND b.byte_offset < l.byte_offset AND b.turn_), -1) AS after_turn FROM l)
      SELECT x.path, x.byte_offset, (SELECT arg_max(s.uuid, s.byte_offset) FROM u s WHERE s.path = x.path AND s.role = 'system' AND s.byte_offset < x.byte_offset AND s.byte_offset > x.after_used) AS step_uuid,
        (SELECT arg_max(s.uuid, s.byte_offset) FROM u s WHERE s.path = x.path AND s.role = 'user' AND s.byte_offset < x.byte_offset AND s.byte_offset > x.after_turn) AS request_uuid FROM x""",
    "missing_sources": "SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS source_path FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 50 % 7 = 0",
    "provider_and_model_key": """WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN 'moonshot-ai/' WHEN 1 THEN 'Moonshot/' WHEN 2 THEN 'claude-' WHEN 3 THEN 'Other/a/' ELSE '' END || 'm' || (event_id % 3) AS raw_model FROM events)
      SELECT raw_model, CASE WHEN starts_with(raw_model, 'claude-') THEN 'anthropic' WHEN lower(split_part(raw_model, '/', 1)) IN ('moonshot-ai', 'moonshot') THEN 'moonshotai' ELSE lower(split_part(raw_model, '/', 1)) END AS provider, CASE WHEN contains(raw_model, '/') THEN substr(raw_model, strpos(raw_model, '/') + 1) ELSE raw_model END AS model_key, count(*) AS calls FROM r GROUP BY 1""",
    "fingerprint": f"""WITH {CALLS} SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'request:' || provider || ':' || event_id WHEN 1 THEN 'step:' || provider || ':s' || event_id ELSE 'fallback:' || sha256('{{"model":"' || raw_model || '","requestMetadata":' || CASE WHEN event_id % 2 = 0 THEN '"meta"' ELSE 'null' END || ',"timestampMs":' || timestamp_ms
      || ',"tokens":{{"cacheCreation":' || cache_creation_tokens || ',"cacheCreation1h":' || cache_creation_1h_tokens || ',"cacheCreation5m":' || cache_creation_5m_tokens || ',"cacheRead":' || cache_read_tokens || ',"inputOther":' || input_other_tokens || ',"output":' || output_tokens || '}}}}') END AS event_fingerprint FROM raw""",
    "hourly_activity": f"WITH {CALLS} SELECT {_UTC_DAY} AS utc_day, CAST(timestamp_ms // 3600000 % 24 AS INTEGER) AS utc_hour, count(*) AS calls FROM calls GROUP BY 1, 2",
    "jsonl_byte_offsets": """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn, strlen(regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g')) AS bytes, regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') AS x FROM conversations)
      SELECT path, CAST(coalesce(sum(bytes + 1) OVER (PARTITION BY path ORDER BY turn, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, bytes FROM t""",
    "variant_typing": "SELECT event_id % 12 AS kind, CAST(CASE event_id % 12 WHEN 0 THEN 10 WHEN 2 THEN 10 WHEN 6 THEN 1000 END AS BIGINT) AS tokens, event_id % 12 < 10 AS present, event_id % 12 < 11 AS readable, count(*) AS events FROM events GROUP BY 1, 2, 3, 4",
    "stream_reconcile": f"""WITH {CALLS}, {_values('st', ['id', 'sub', 'policy', 'since'], STATES)}, w AS (SELECT event_id, timestamp_ms, provider, raw_model, session_id, input_other_tokens, cache_creation_tokens, CAST(0 AS BIGINT) AS cache_creation_5m_tokens, CAST(0 AS BIGINT) AS cache_creation_1h_tokens, cache_read_tokens, output_tokens FROM raw),
      z AS (SELECT w.event_id, arg_max(st.policy, st.since) AS policy FROM w LEFT JOIN st ON st.since <= w.timestamp_ms GROUP BY 1),
      p AS (SELECT c.*, {_costs()} FROM w c LEFT JOIN bundled r ON r.provider = c.provider AND r.model_key = {_PLAIN.replace('raw_model', 'c.raw_model')}),
      b AS (SELECT p.*, CASE WHEN provider <> 'anthropic' THEN 'metered-api' WHEN policy = 'enterprise-api' THEN 'enterprise-api' WHEN policy = 'pro-fable' THEN CASE WHEN raw_model = 'claude-fable-5' THEN 'pro-fable' ELSE 'pro-subscription-excluded' END ELSE 'subscription-excluded' END AS metering_basis FROM p JOIN z USING (event_id))
      SELECT 'step:' || provider || ':' || event_id AS event_fingerprint, session_id, timestamp_ms, raw_model, {', '.join(TOKENS)}, total_cost_nano, metering_basis IN ('metered-api', 'enterprise-api', 'pro-fable') AS is_metered, metering_basis FROM b""",
}

_ID = "'anthropic:' || session_id"
_N = "CAST(session_id AS BIGINT)"
_NATIONS = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, (k + 1) * 0.25 AS given, k * 1.5 AS out, CASE WHEN k % 2 = 0 THEN k * 0.125 END AS read, CASE WHEN k % 3 = 0 THEN k * 0.5 END AS write FROM nation)"


def _nano(x: str) -> str:
    return f"CAST(floor(({x}) * 1000 + 0.5) AS BIGINT)"


def _rates(given: str, out: str, read: str, write: str, short: str, hour: str) -> str:
    return ", ".join(f"{_nano(x)} AS {c}" for x, c in zip((given, out, read, write, short, hour), RATES, strict=True))


_REMOTE = _rates("given", "out", "coalesce(read, given)", *["coalesce(write, given)"] * 3)
_INFERRED = "CASE WHEN write IS NULL THEN 'inferred' ELSE 'exact' END AS confidence, CAST(NULL AS BIGINT) AS effective_at_ms"
_KINDS = "CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 11 = 0 THEN 'interrupted' WHEN event_id % 11 = 1 THEN 'api-error' WHEN event_id % 11 = 2 THEN 'streaming-snapshot' END"
_EVENT_DAYS = f"{CALLS}, days AS (SELECT {_UTC_DAY} AS date, event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM e GROUP BY 1, 2)"
_LOGGED = f"""{CALLS}, {_values('st', ['id', 'sub', 'policy', 'since'], STATES)},
w AS (SELECT event_id, session_id, agent_id, timestamp_ms, CASE WHEN raw_model LIKE 'claude-%' THEN 'anthropic' ELSE 'moonshotai' END AS provider, raw_model, {', '.join(TOKENS)} FROM raw WHERE event_id % 10 < 8),
z AS (SELECT w.event_id, arg_max(st.policy, st.since) AS policy FROM w LEFT JOIN st ON st.since <= w.timestamp_ms GROUP BY 1),
p AS (SELECT c.*, {_costs()} FROM w c LEFT JOIN bundled r ON r.provider = c.provider AND r.model_key = {_PLAIN.replace('raw_model', 'c.raw_model')}),
b AS (SELECT p.*, CASE WHEN provider <> 'anthropic' THEN 'metered-api' WHEN policy = 'enterprise-api' THEN 'enterprise-api' WHEN policy = 'pro-fable' THEN CASE WHEN raw_model = 'claude-fable-5' THEN 'pro-fable' ELSE 'pro-subscription-excluded' END ELSE 'subscription-excluded' END AS metering_basis FROM p JOIN z USING (event_id))"""

ORACLES |= {
    "claude_usage": f"WITH {CALLS} SELECT 'proj-' || ({_N} % 5) AS project, {_ID} AS session_id, agent_id, raw_model AS model, CASE WHEN event_id % 3 = 0 THEN 'r' ELSE 'm' END || event_id AS provider_request_id, 'u' || event_id AS step_uuid, 'm' || event_id AS request_metadata, timestamp_ms, {', '.join(TOKENS)} FROM raw WHERE event_id % 10 < 8",
    "claude_malformed": f"WITH {CALLS} SELECT {_ID} AS session_id, agent_id, count(*) FILTER (event_id % 10 = 9) AS malformed FROM raw GROUP BY 1, 2",
    "claude_sessions": f"""WITH {CALLS}, own AS (SELECT session_id, max(timestamp_ms) AS b FROM raw WHERE agent_id = 'main' AND event_id % 10 <> 9 GROUP BY 1)
      SELECT {_ID} AS session_id, 'anthropic' AS provider, CASE WHEN {_N} % 3 <> 0 THEN 'ws-' || ({_N} % 7) ELSE 'proj-' || ({_N} % 5) END AS workspace_key, CASE WHEN {_N} % 3 <> 0 THEN work_directory END AS work_directory, CASE WHEN {_N} % 4 = 0 THEN 'Renamed ' ELSE 'Title ' END || session_id AS title, created_at_ms, greatest(created_at_ms, coalesce(b, created_at_ms)) AS updated_at_ms FROM sessions LEFT JOIN own USING (session_id)""",
    "claude_agents": f"""WITH {CALLS}, a AS (SELECT session_id, agent_id, count(*) FILTER (event_id % 10 <> 9) AS known FROM raw GROUP BY 1, 2 UNION ALL SELECT session_id, 'main', 1 FROM sessions WHERE session_id NOT IN (SELECT session_id FROM raw WHERE agent_id = 'main'))
      SELECT {_ID} AS session_id, agent_id, CASE WHEN agent_id = 'main' THEN 'main' WHEN agent_id = 'sub-0' AND known > 0 THEN 'agent:planner' WHEN agent_id = 'sub-1' AND known > 0 THEN 'skill:review' ELSE 'subagent' END AS agent_key, CASE WHEN agent_id = 'main' THEN 'Main' WHEN agent_id = 'sub-0' AND known > 0 THEN 'planner' WHEN agent_id = 'sub-1' AND known > 0 THEN 'review (skill)' ELSE 'Other subagent' END AS agent_label, CASE WHEN agent_id = 'main' THEN 'main' ELSE 'sub' END AS agent_type FROM a""",
    "claude_scan": f"""WITH {CALLS}, x AS (SELECT session_id, agent_id, {_KINDS} AS kind, event_id % 10 = 9 AS bad, CASE WHEN event_id % 10 <> 9 THEN timestamp_ms END AS ms FROM raw
      UNION ALL SELECT session_id, 'main', NULL, false, created_at_ms FROM sessions UNION ALL SELECT session_id, 'main', NULL, false, created_at_ms FROM sessions WHERE {_N} % 4 = 0)
      SELECT {_ID} AS session_id, agent_id, kind, count(*) AS lines, count(*) FILTER (bad) AS malformed, max(ms) AS last_ms FROM x GROUP BY 1, 2, 3""",
    "stream_reconcile_claude": f"WITH {_LOGGED} SELECT 'request:' || provider || ':' || CASE WHEN event_id % 3 = 0 THEN 'r' ELSE 'm' END || event_id AS event_fingerprint, {_ID} AS session_id, agent_id, timestamp_ms, raw_model, {', '.join(TOKENS)}, total_cost_nano, metering_basis IN ('metered-api', 'enterprise-api', 'pro-fable') AS is_metered, metering_basis FROM b",
    "kimi_states": f"WITH {CALLS} SELECT session_id, 'moonshotai' AS provider, workspace_key, work_directory, trim(title) AS title, created_at_ms, updated_at_ms FROM sessions",
    "kimi_state_agents": f"WITH {CALLS} SELECT session_id, agent_id, agent_type, CASE WHEN agent_type = 'sub' THEN 'main' END AS parent_agent_id, CASE WHEN agent_id IN ('main', 'sub-0') THEN 'log' END AS source_path FROM agents",
    "kimi_requests": f"WITH {CALLS} SELECT session_id, raw_model AS model, timestamp_ms, output_tokens, CASE WHEN event_id % 3 <> 0 THEN timestamp_ms - 5000 END AS requested_ms, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 9 AS BIGINT) END AS message_count, CASE WHEN event_id % 3 <> 0 THEN 'sys' END AS system_prompt_hash, CASE WHEN event_id % 3 <> 0 THEN 'tools' END AS tools_hash FROM raw",
    "catalog_models_dev": f"WITH {_NATIONS} SELECT 'moonshotai' AS provider, 'kimi-n' || k AS model_key, CAST(NULL AS VARCHAR) AS raw_alias, {_REMOTE}, 'models.dev' AS source_name, {_INFERRED} FROM n WHERE k % 5 <> 4",
    "catalog_litellm": f"WITH {_NATIONS} SELECT 'moonshotai' AS provider, 'kimi-n' || k AS model_key, CAST(NULL AS VARCHAR) AS raw_alias, {_REMOTE}, 'litellm' AS source_name, {_INFERRED} FROM n WHERE k % 4 <> 3",
    "catalog_overrides": f"""WITH {_NATIONS} SELECT CASE WHEN k % 3 = 1 THEN 'anthropic' ELSE 'moonshotai' END AS provider, CASE k % 3 WHEN 0 THEN 'kimi-n' WHEN 1 THEN 'claude-n' ELSE 'plain-n' END || k AS model_key, CASE k % 3 WHEN 0 THEN 'moonshot-ai/kimi-n' WHEN 1 THEN 'claude-n' ELSE 'plain-n' END || k AS raw_alias,
      {_rates('given', 'out', 'coalesce(read, given)', 'given', 'coalesce(write, given)', 'given')}, 'user-override' AS source_name, 'override' AS confidence, CASE WHEN k % 4 = 0 THEN k * 86400000 END AS effective_at_ms FROM n""",
    "catalog_vendor": f"WITH {_NATIONS} SELECT k + 1 AS rate_id, 'anthropic' AS provider, {_rates('given', 'out', 'given / 8', 'given * 1.25', 'given * 1.25', 'given * 2')}, 'anthropic' AS source_name, 'exact' AS confidence FROM n WHERE k < {len(VENDOR_MODELS)}",
    "export_days": f"WITH {_EVENT_DAYS} SELECT date, 'claude-' || event_type AS model_key, k * 25 / 100.0::DOUBLE AS cost_usd, n AS request_count, k AS input, k * 2 AS output, k * 3 AS cache_read, n AS cache_write_5m, n * 2 AS cache_write_1h FROM days",
    "report_models": f"WITH {_EVENT_DAYS} SELECT 'claude-' || event_type AS model_key, sum(k * 0.25::DOUBLE) AS cost_usd FROM days GROUP BY 1",
    "report_totals": f"WITH {_EVENT_DAYS} SELECT sum(k * 0.25::DOUBLE) AS total_usd FROM days GROUP BY event_type",
    "summary_with_replays": f"WITH {OCC} SELECT count(*) AS call_count, CAST(sum({_PROMPT}) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, (SELECT count(*) FROM classes WHERE NOT is_canonical AND kind <> 'superseded-usage' AND canonical_metered) AS replays_excluded FROM canon WHERE is_metered",
    "sessions_with_replays": f"""WITH {OCC}, own AS (SELECT session_id, count(*) AS call_count FROM canon WHERE is_metered GROUP BY 1), again AS (SELECT session_id, count(*) AS n FROM classes WHERE NOT is_canonical AND kind <> 'superseded-usage' AND canonical_metered GROUP BY 1)
      SELECT session_id, call_count, CAST(1 AS BIGINT) AS agent_count, coalesce(n, 0) AS inherited_occurrences FROM own LEFT JOIN again USING (session_id)""",
}

_WIRE_BYTES = """length('{"type":"context.append_loop_event","event":{"type":"step.end","uuid":"' || event_id || '"}}') + 1
  + length('{"type":"usage.record","time":' || timestamp_ms || ',"model":"' || raw_model || '","usageScope":"turn","usage":{"inputOther":' || input_other_tokens
    || ',"inputCacheCreation":' || cache_creation_tokens || ',"inputCacheRead":' || cache_read_tokens || ',"output":' || output_tokens || '}}') + 1"""
_ZEROS = "CAST(0 AS BIGINT) AS"

ORACLES |= {
    "import_counters": f"""WITH {CALLS}, c AS (SELECT session_id, {_N} AS n, event_id, {_WIRE_BYTES} AS bytes FROM raw),
      again AS (SELECT n FROM c WHERE n % 7 <> 0 AND n % 5 = 1 GROUP BY n HAVING count(*) FILTER (event_id % 2 = 0) > 0 AND count(*) FILTER (event_id % 2 <> 0) > 0),
      new AS (SELECT * FROM c WHERE event_id % 2 = 0 AND n IN (SELECT n FROM again))
      SELECT CAST(1 AS BIGINT) AS version, true AS changed, count(DISTINCT n) AS discovered_sessions, count(DISTINCT n) AS discovered_sources, 2 * count(*) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes, {_ZEROS} malformed, count(*) AS inserted, {_ZEROS} removed, {_ZEROS} rewritten, {_ZEROS} errors FROM c
      UNION ALL SELECT 2, true, (SELECT count(DISTINCT n) FROM c WHERE n % 7 <> 0), (SELECT count(DISTINCT n) FROM c WHERE n % 7 <> 0), 2 * count(*), CAST(coalesce(sum(bytes), 0) AS BIGINT), 0, count(*), (SELECT count(*) FROM c WHERE n % 7 = 0), (SELECT count(*) FROM again), 0 FROM new""",
    "store_agents": ORACLES["claude_agents"],
    "rate_refresh": f"""WITH {_NATIONS} SELECT 'kimi-n' || k AS model_key, (k + 1) * 1000 AS {RATES[0]}, k % 5 <> 0 AND k % 7 <> 6 AS is_active, CAST(CASE WHEN k % 5 <> 0 AND k % 7 <> 6 THEN 2 ELSE 1 END AS BIGINT) AS snapshot_id, true AS same_id FROM n
      UNION ALL SELECT 'kimi-n' || k, (k + 1) * 1000 + 500, true, 2, false FROM n WHERE k % 5 = 0 AND k % 7 <> 6""",
    "rate_statuses": f"""SELECT * FROM (VALUES ('moonshotai', 'failed', false, false, 'litellm', 'Kimi LiteLLM', CAST({NOW - 4} AS BIGINT), NULL, 'litellm: HTTP 503', true, 'Pricing refresh failed: litellm: HTTP 503'),
      ('anthropic', 'failed', true, false, 'bundled-claude-2026-08-14', 'Claude Bundled', NULL, '2026-08-14', 'anthropic: no rates', true, 'Pricing is stale. Pricing refresh failed: anthropic: no rates'))
      AS t(provider, refresh_status, is_stale, has_overrides, source_name, source_label, updated_at_ms, bundled_date, error, has_warning, description) WHERE EXISTS (SELECT 1 FROM nation)""",
    "health_report": f"""WITH {CALLS}, tries AS (SELECT CAST(r_regionkey AS BIGINT) AS k, CASE WHEN r_regionkey % 2 = 0 THEN 'moonshotai' ELSE 'anthropic' END AS provider, 'source-' || r_regionkey AS source_name, CASE WHEN r_regionkey IN (1, 2) THEN 'HTTP 50' || r_regionkey END AS error FROM region),
      p AS (SELECT provider, count(*) FILTER (k <> 4) AS tried, count(*) FILTER (error IS NOT NULL) AS bad, max(CASE WHEN k <> 4 AND error IS NULL THEN {NOW} - k * 1000 END) AS good, string_agg(source_name || ': ' || error, '; ' ORDER BY source_name) AS error FROM tries GROUP BY 1),
      q AS (SELECT provider, provider || ' ' || CASE WHEN tried = 0 THEN 'not-attempted' WHEN bad = tried THEN 'failed' WHEN bad > 0 THEN 'partial-failure' ELSE 'succeeded' END || ' ' || CASE WHEN provider = 'anthropic' THEN 'Claude Bundled' ELSE 'Kimi Bundled' END || ' '
        || concat_ws(' ', CASE WHEN good IS NULL OR {NOW} - good > {DAY} THEN 'Pricing is stale.' END, 'Pricing refresh failed: ' || error) AS line FROM p),
      n AS (SELECT count(*) FILTER (is_metered) AS calls, count(DISTINCT session_id) FILTER (is_metered) AS sessions, count(*) FILTER (is_metered AND total_cost_nano IS NULL) AS unpriced_calls FROM calls)
      SELECT calls, sessions, unpriced_calls, CAST(3 AS BIGINT) AS data_version, 'warning' AS status, '{STATES[0][2]}' AS account_policy, CAST({NOW - 9} AS BIGINT) AS account_last_success_at_ms,
        (SELECT string_agg(DISTINCT session_provider, '; ' ORDER BY session_provider) FROM sessions) AS providers, (SELECT string_agg(line, '; ' ORDER BY provider) FROM q) AS pricing,
        concat_ws('; ', '2 source(s) could not be read.', 'Claude account check: not signed in', (SELECT string_agg(source_name || ': ' || error, '; ' ORDER BY source_name) FROM tries WHERE error IS NOT NULL), CASE WHEN unpriced_calls > 0 THEN unpriced_calls || ' call(s) have no matching price.' END) AS warnings FROM n""",
    "options_in_order": f"WITH {_OPTIONS}, {_split('spend')}, {_RANKED} SELECT session_id AS value, grp AS recency_group, row_number() OVER (PARTITION BY rank_ ORDER BY cost DESC, updated_at_ms DESC, session_id) - 1 AS group_position, row_number() OVER (ORDER BY rank_, cost DESC, updated_at_ms DESC, session_id) - 1 AS position FROM opt",
    "workspaces_in_order": f"WITH {CALLS} SELECT workspace_key AS value, row_number() OVER (ORDER BY workspace_key) - 1 AS position FROM (SELECT DISTINCT workspace_key FROM v)",
}
