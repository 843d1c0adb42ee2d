"""Dashboard filters as conjunctions of columns that reach the scan."""

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.times import checked_zone


@dataclass(frozen=True)
class Filters:
    """None means: no condition. Bounds are inclusive. provider is that of the session."""

    from_ms: int | None = None
    to_ms: int | None = None
    workspace: str | None = None
    session_id: str | None = None
    model: str | None = None
    provider: str | None = None
    agent_type: str | None = None
    agent_key: str | None = None
    bucket: str = "auto"
    session_sort: str = "cost"
    time_zone: str = "UTC"

    def __post_init__(self):
        for name, known in (("bucket", ("auto", "minute", "hour", "day", "week")), ("session_sort", ("cost", "recent", "start")), ("agent_type", (None, "main", "sub", "unknown"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name}: {getattr(self, name)!r}")
        if self.from_ms is not None and self.to_ms is not None and self.from_ms > self.to_ms:
            raise ValueError("from_ms is after to_ms")
        checked_zone(self.time_zone)

    @classmethod
    def of_query(cls, query: dict[str, str]) -> "Filters":
        """From a URL's parameters; unknown ones and empty values are passed over."""
        names = {"from": "from_ms", "to": "to_ms", "sessionId": "session_id", "agentType": "agent_type", "agentKey": "agent_key", "sessionSort": "session_sort", "timeZone": "time_zone"} | {n: n for n in ("workspace", "model", "provider", "bucket")}
        got = {names[k]: v for k, v in query.items() if k in names and v != ""}
        for k in ("from_ms", "to_ms"):
            if k in got and not re.fullmatch(r"\d+", got[k]):
                raise ValueError(f"{k}: {got[k]!r}")
            if k in got:
                got[k] = int(got[k])
        return cls(**got)

    def conditions(self) -> list[Column]:
        pairs = {"workspace_key": self.workspace, "session_id": self.session_id, "raw_model": self.model, "session_provider": self.provider, "agent_type": self.agent_type, "agent_key": self.agent_key}
        return [*self._range(), *[F.col(c) == v for c, v in pairs.items() if v is not None]]

    def drilldown(self) -> list[Column]:
        """For a session's agents: workspace, session and provider don't count."""
        pairs = {"raw_model": self.model, "agent_type": self.agent_type, "agent_key": self.agent_key}
        return [*self._range(), *[F.col(c) == v for c, v in pairs.items() if v is not None]]

    def _range(self) -> list[Column]:
        low = [] if self.from_ms is None else [F.col("timestamp_ms") >= self.from_ms]
        return low if self.to_ms is None else [*low, F.col("timestamp_ms") <= self.to_ms]


def matching(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def described(facts: DataFrame, sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """Calls or occurrences with the columns of their session and agent; those without either go."""
    own = sessions.select("session_id", F.col("provider").alias("session_provider"), "workspace_key", "work_directory", "title", "created_at_ms", "updated_at_ms")
    return facts.join(own, "session_id").join(agents, ["session_id", "agent_id"])


def visible(calls: DataFrame, sessions: DataFrame, agents: DataFrame, filters: Filters) -> DataFrame:
    """Metered calls that the filters let through, described."""
    return matching(described(calls.where("is_metered"), sessions, agents), filters.conditions())
