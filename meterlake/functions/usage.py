"""Token, price and model expressions over a call's columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.schemas import TOKENS

#: Models that a pro subscription bills by use.
PRO_METERED = ["claude-fable-5"]


def prompt_tokens() -> Column:
    """Every input-side token: uncached input, cache writes, cache reads."""
    return sum((F.col(c) for c in TOKENS[1:5]), F.col(TOKENS[0]))


def all_tokens() -> Column:
    return prompt_tokens() + F.col("output_tokens")


def no_cache_extra_nano() -> Column:
    """What cache reads would cost more at the input rate, zero at least; null without a rate."""
    extra = F.col("cache_read_tokens") * F.col("rate_input_nano") - F.col("cache_read_cost_nano")
    return F.when(extra.isNotNull(), F.greatest(extra, F.lit(0)))


def main_prompt_tokens() -> Column:
    """Prompt of a main agent; an agent of unknown type counts as main."""
    return F.when(F.coalesce(F.col("agent_type") != "sub", F.lit(True)), prompt_tokens())


def subagent_prompt_tokens() -> Column:
    return F.when(F.col("agent_type") == "sub", prompt_tokens())


def costs(rate: Column) -> dict[str, Column]:
    """The five cost columns by the fields of a rate struct; all null where it is null."""
    parts = {
        "input_cost_nano": F.col("input_other_tokens") * rate["input_nano_per_token"],
        "cache_creation_cost_nano": F.col("cache_creation_tokens") * rate["cache_creation_nano_per_token"] + F.col("cache_creation_5m_tokens") * rate["cache_creation_5m_nano_per_token"] + F.col("cache_creation_1h_tokens") * rate["cache_creation_1h_nano_per_token"],
        "cache_read_cost_nano": F.col("cache_read_tokens") * rate["cache_read_nano_per_token"],
        "output_cost_nano": F.col("output_tokens") * rate["output_nano_per_token"],
    }
    return parts | {"total_cost_nano": sum(list(parts.values())[1:], parts["input_cost_nano"])}


def provider_of(model: Column) -> Column:
    """Provider by the part before the first slash; bare claude- models are of anthropic."""
    first = F.lower(F.substring_index(model, "/", 1))
    return F.when(model.startswith("claude-"), "anthropic").when(first.isin("moonshot-ai", "moonshot"), "moonshotai").otherwise(first)


def provider_of_alias(alias: Column) -> Column:
    """As provider_of, but an alias without a slash that isn't claude- is of moonshotai."""
    return F.when(F.locate("/", alias) > 0, provider_of(alias)).when(alias.startswith("claude-"), "anthropic").otherwise("moonshotai")


def model_key(model: Column) -> Column:
    """What follows the first slash, or all of it."""
    return F.substr(model, F.locate("/", model) + 1)


def event_fingerprint(provider: Column, request_id: Column, step_uuid: Column, model: Column, metadata: Column, timestamp_ms: Column) -> Column:
    """Identity of a call: the provider's request id, else the step, else a digest of what was used."""
    tokens = F.struct(*[F.col(c).alias(n) for c, n in (("cache_creation_tokens", "cacheCreation"), ("cache_creation_1h_tokens", "cacheCreation1h"), ("cache_creation_5m_tokens", "cacheCreation5m"), ("cache_read_tokens", "cacheRead"), ("input_other_tokens", "inputOther"), ("output_tokens", "output"))])
    body = F.to_json(F.struct(model.alias("model"), metadata.alias("requestMetadata"), timestamp_ms.alias("timestampMs"), tokens.alias("tokens")), {"ignoreNullFields": "false"})
    return F.when(request_id.isNotNull(), F.concat(F.lit("request:"), provider, F.lit(":"), request_id)).when(step_uuid.isNotNull(), F.concat(F.lit("step:"), provider, F.lit(":"), step_uuid)).otherwise(F.concat(F.lit("fallback:"), F.sha2(body, 256)))


def usd_per_million_to_nano(usd: Column) -> Column:
    return F.floor(usd * 1000 + 0.5).cast("long")


def usd_per_token_to_nano(usd: Column) -> Column:
    return F.floor(usd * 1e9 + 0.5).cast("long")


def nano_to_usd_per_million(nano: Column) -> Column:
    return nano / F.lit(1000.0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def percent_difference(base: Column, difference: Column) -> Column:
    """Null where the base is 0."""
    return F.when(base != 0, difference / base * 100)


def metering(provider: Column, model: Column, policy: Column) -> tuple[Column, Column]:
    """is_metered and metering_basis by the account's policy at the call's time; null: none known."""
    pro = model_key(model).isin(PRO_METERED)
    basis = F.when(F.coalesce(provider != "anthropic", F.lit(True)), "metered-api").when(policy.isNull(), "account-status-unavailable").when(policy == "enterprise-api", "enterprise-api").when(policy == "pro-fable", F.when(pro, "pro-fable").otherwise("pro-subscription-excluded")).otherwise("subscription-excluded")
    return basis.isin("metered-api", "enterprise-api", "pro-fable"), basis


def policy_of(subscription: Column) -> Column:
    return F.when(subscription == "pro", "pro-fable").when(subscription == "enterprise", "enterprise-api").otherwise("subscription-excluded")


def source_priority(source: Column) -> Column:
    """Overrides before vendor catalogs before community ones before bundled rates."""
    return F.when(source == "user-override", 0).when(source.isin("anthropic", "models.dev"), 1).when(source == "litellm", 2).otherwise(3)


def pricing_basis(source: Column, confidence: Column) -> Column:
    return F.concat(source, F.when(confidence == "inferred", "; cache creation uses the normal input rate").otherwise(""))
