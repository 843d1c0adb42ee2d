"""Changes of the ledger: keys that occur once, sources that vanish, calls that must be made anew."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.canonical import canonicalize

KEY = ["source_path", "generation", "byte_offset"]


def record_once(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored and those of new whose place is not in it; a place that new repeats counts once."""
    fresh = new.dropDuplicates(KEY).join(stored.select(*KEY), KEY, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def missing_sources(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """Paths that the ledger has and the logs no longer do."""
    return stored.select("source_path").distinct().join(discovered.select("source_path"), "source_path", "left_anti")


def without_sources(occurrences: DataFrame, gone: DataFrame) -> DataFrame:
    return occurrences.join(gone.select("source_path"), "source_path", "left_anti")


def affected(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fingerprints whose occurrences differ between two states of the table."""
    mark = lambda df: df.select("event_fingerprint", *KEY)
    one, two = mark(before), mark(after)
    return one.exceptAll(two).union(two.exceptAll(one)).select("event_fingerprint").distinct()


def rebuilt(ledger: DataFrame, occurrences: DataFrame, sessions: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The canonical calls with those of the fingerprints made anew; one without occurrences goes."""
    keys = fingerprints.select("event_fingerprint")
    made = canonicalize(occurrences.join(keys, "event_fingerprint", "left_semi"), sessions)
    return ledger.join(keys, "event_fingerprint", "left_anti").unionByName(made, allowMissingColumns=True)


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key: an upsert of sessions or agents."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.col(version)).alias("r"))
    return best.select("r.*")


def merged_agents(state: DataFrame, found: DataFrame) -> DataFrame:
    """Agents that a state file names and those that have a log: the file's type and parent, the
    log's path, one row for each (session_id, agent_id)."""
    a, b = state.alias("a"), found.alias("b")
    rows = a.join(b, ["session_id", "agent_id"], "full")
    kind = F.when(F.col("a.agent_type").isin("main", "sub"), F.col("a.agent_type")).when(F.col("agent_id") == "main", "main").otherwise("unknown")
    return rows.select("session_id", "agent_id", kind.alias("agent_type"), F.col("a.parent_agent_id").alias("parent_agent_id"), F.coalesce("b.source_path", "a.source_path").alias("source_path"))
