"""Families of logs. Batch and stream ingest know them by this registry alone: a family that is
registered is discovered, parsed and followed like the two that are there."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.schemas import AGENT
from meterlake.sources import claude, kimi


@dataclass(frozen=True)
class Provider:
    """suffix: of its files' names. pattern: of its files' paths. placed: adds session_id and agent_id by
    path. records: usage records of lines (path, byte_offset, text). malformed: per path, how many lines
    can't be read. agents: AGENT rows of placed lines. open_lines: lines that later ones of their path
    still need (path, byte_offset, text), for families that carry something from line to line. parts: placed
    usage records, sessions and agents of all that is below a root, for ingest in one batch."""

    name: str
    suffix: str
    pattern: str
    placed: Callable[[DataFrame], DataFrame]
    records: Callable[[DataFrame], DataFrame]
    malformed: Callable[[DataFrame], DataFrame]
    agents: Callable[[DataFrame], DataFrame]
    open_lines: Callable[[DataFrame], DataFrame] | None = None
    parts: Callable[[SparkSession, str], tuple[DataFrame, DataFrame, DataFrame]] | None = None

    def owns(self, path: Column) -> Column:
        return path.rlike(self.pattern)


def named_agents(placed: DataFrame) -> DataFrame:
    """AGENT rows of files whose path names the agent, and nothing else does."""
    rows = placed.select("session_id", "agent_id").distinct()
    main = F.col("agent_id") == "main"
    label = F.when(main, "Main").otherwise(F.col("agent_id"))
    kind = F.when(main, "main").otherwise("unknown")
    return rows.select("session_id", "agent_id", F.col("agent_id").alias("agent_key"), label.alias("agent_label"), kind.alias("agent_type"))


_REGISTRY: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    """A provider of a name that is known takes its place."""
    _REGISTRY[provider.name] = provider


def unregister(name: str) -> None:
    _REGISTRY.pop(name, None)


def all_providers() -> list[Provider]:
    return list(_REGISTRY.values())


def suffixes() -> list[str]:
    return sorted({p.suffix for p in _REGISTRY.values()})


def owned(lines: DataFrame) -> list[tuple[Provider, DataFrame]]:
    """Each provider with its own of the rows that have a path."""
    return [(p, lines.where(p.owns(F.col("path")))) for p in _REGISTRY.values()]


def placed(rows: DataFrame) -> DataFrame:
    """path, session_id and agent_id of the rows that a provider owns."""
    parts = [p.placed(own).select("path", "session_id", "agent_id") for p, own in owned(rows)]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


AGENT_COLUMNS = [c.split()[0] for c in AGENT.split(", ")]

register(Provider("kimi", "wire.jsonl", kimi.WIRE, kimi.placed, kimi.usage_records, kimi.malformed, lambda lines: named_agents(kimi.placed(lines)), kimi.open_steps, kimi.parts))
register(Provider("claude", ".jsonl", f"{claude.MAIN}|{claude.SUB}", claude.placed, claude.usage_records, claude.malformed, claude.agents, parts=claude.parts))
