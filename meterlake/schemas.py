"""Schemas of the ledger's tables."""

#: The six token counters of a call.
TOKENS = ["input_other_tokens", "cache_creation_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "cache_read_tokens", "output_tokens"]
COSTS = ["input_cost_nano", "cache_creation_cost_nano", "cache_read_cost_nano", "output_cost_nano", "total_cost_nano"]
RATES = ["input_nano_per_token", "output_nano_per_token", "cache_read_nano_per_token", "cache_creation_nano_per_token", "cache_creation_5m_nano_per_token", "cache_creation_1h_nano_per_token"]

_longs = lambda names: ", ".join(f"{c} long" for c in names)

SESSION = "session_id string, provider string, workspace_key string, work_directory string, title string, created_at_ms long, updated_at_ms long"
AGENT = "session_id string, agent_id string, agent_key string, agent_label string, agent_type string"
OCCURRENCE = f"source_path string, generation long, byte_offset long, event_fingerprint string, timestamp_ms long, provider string, raw_model string, {_longs(TOKENS)}, session_id string, agent_id string, provider_request_id string, step_uuid string, account_state_id long, is_metered boolean, metering_basis string"
CALL = f"event_fingerprint string, canonical_source_path string, canonical_generation long, canonical_byte_offset long, timestamp_ms long, provider string, raw_model string, resolved_model_key string, {_longs(TOKENS)}, session_id string, agent_id string, {_longs(COSTS)}, rate_id long, pricing_confidence string, pricing_basis string, account_state_id long, is_metered boolean, metering_basis string"
RATE = f"rate_id long, provider string, model_key string, raw_alias string, {_longs(RATES)}, source_name string, confidence string, effective_at_ms long, snapshot_id long, is_active boolean"
ACCOUNT_STATE = "account_state_id long, subscription_type string, policy string, effective_from_ms long"
USAGE_RECORD = f"source_path string, byte_offset long, model string, provider_request_id string, step_uuid string, request_metadata string, timestamp_ms long, {_longs(TOKENS)}"
EXPORT_DAY = "date string, model_key string, cost_usd double, request_count long, input long, output long, cache_read long, cache_write_5m long, cache_write_1h long"
