"""Incremental ingest: new lines of logs become occurrences, and only the calls that they touch
are made anew. Nothing is dropped for being late; a source that is rewritten or gone is retracted."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from meterlake.functions import usage
from meterlake.operators import metering, pricing, reconcile
from meterlake.schemas import AGENT, CALL, COSTS, OCCURRENCE, SESSION
from meterlake.sinks.store import BUCKETS, Commit, Store, bucket_of
from meterlake.sources import lines as logs
from meterlake.sources import providers

CALLS = CALL + ", provider_request_id string"
CONTEXT = "path string, generation long, byte_offset long, text string"
AGENTS = AGENT + ", source_path string"
FOLLOWED = f"root string, {logs.FILES}"
GONE = "source_path string, generation long, vanished boolean"
COUNTERS = ["discovered_sessions", "discovered_sources", "lines", "bytes", "malformed", "inserted", "removed", "rewritten", "errors"]
BATCHES = f"version long, stream string, batch_id long, changed boolean, {', '.join(f'{c} long' for c in COUNTERS)}"


def record_usage(records: DataFrame, states: DataFrame) -> DataFrame:
    """Occurrences of usage records: fingerprint, provider and metering. records have path,
    generation, byte_offset, session_id and agent_id besides what the parsers give."""
    provider = usage.provider_of(F.col("model"))
    parts = [F.col(c) for c in ("provider_request_id", "step_uuid", "model", "request_metadata", "timestamp_ms")]
    named = {"source_path": F.col("path"), "event_fingerprint": usage.event_fingerprint(provider, *parts), "provider": provider}
    rows = records.withColumns(named).withColumnRenamed("model", "raw_model")
    return metering.meter(rows, states).select(*_names(OCCURRENCE))


class Reconciler:
    """Folds log lines of all registered providers into a store of occurrences and canonical, priced
    calls. What a batch changes is published at once, and with it how far each file was read; a batch
    that fails before that leaves nothing.

    Occurrences and calls lie in buckets by fingerprint, and a batch rewrites only those that it touches.
    sessions are those to begin with; refresh_sessions takes up changes. One writer at a time; any number
    of folders can be followed into one store."""

    def __init__(self, spark: SparkSession, folder: str, sessions: DataFrame, rates: DataFrame, states: DataFrame):
        self.spark, self.store = spark, Store(spark, folder)
        self.given_sessions, self.rates, self.states = sessions, rates, states

    @property
    def occurrences(self) -> DataFrame:
        return self.store.read("occurrences", OCCURRENCE)

    @property
    def calls(self) -> DataFrame:
        return self.store.read("calls", CALLS)

    @property
    def agents(self) -> DataFrame:
        """AGENT rows, and the log that each is known from."""
        return self.store.read("agents", AGENTS)

    @property
    def sessions(self) -> DataFrame:
        known = "sessions" in self.store.manifest()
        return self.store.read("sessions", SESSION) if known else _filled(self.given_sessions, SESSION)

    @property
    def batches(self) -> DataFrame:
        """The log of batches: one row for each that was published, by version, with its counters."""
        return self.store.read("batches", BATCHES)

    def changes_since(self, version: int) -> DataFrame:
        """Batches after a version that changed the ledger: what a reader has to look at again."""
        return self.batches.where((F.col("version") > version) & F.col("changed"))

    def batch(self, lines: DataFrame, batch_id: int, stream: str = "") -> None:
        """Lines that someone else has read: op (line or retract), path, generation, byte_offset, line. A
        batch that a stream delivers again is known by the stream and its number, and changes nothing."""
        known = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
        if not self.batches.where(known).isEmpty():
            return
        gone = lines.where("op = 'retract'").select(F.col("path").alias("source_path"), "generation", F.lit(True).alias("vanished"))
        fresh = lines.where("op = 'line'").select("path", "generation", "byte_offset", "line")
        commit = self.store.begin()
        found = lines.where("op = 'line'").select("path").distinct()
        self._fold(commit, fresh, gone, {"stream": stream, "batch_id": batch_id}, commit.keep("found", found))
        commit.publish()

    def take(self, root: str, batch_id: int | None = None) -> None:
        """Takes up what has changed below a folder since the store last saw it: new files, new lines,
        files written anew and files that have gone. To do it again changes nothing, and nothing is published."""
        commit = self.store.begin()
        files = self.store.read("files", FOLLOWED)
        known, others = files.where(F.col("root") == root).drop("root"), files.where(F.col("root") != root)
        listing = logs.found(self.spark, root, providers.suffixes(), commit.keep).select("path", "size")
        owned = providers.placed(listing.select("path"))
        listing = listing.join(owned.select("path").distinct(), "path", "left_semi")
        changes = commit.keep("changes", logs.compared(listing, known, root))
        if changes.isEmpty():
            return
        good = changes.where("error is null")
        now = good.select(F.lit(root).alias("root"), *_names(logs.FILES))
        kept = known.join(good.select("path"), "path", "left_anti").select(F.lit(root).alias("root"), *_names(logs.FILES))
        commit.write("files", others.select(*_names(FOLLOWED)).unionByName(now).unionByName(kept))
        gone = good.where("before is not null").select(F.col("path").alias("source_path"), F.col("before").alias("generation"), F.col("gone").alias("vanished"))
        counts = changes.agg(F.count_if("rewritten").alias("rewritten"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
        self._fold(commit, logs.new_lines(changes, root), gone, {"stream": root, "batch_id": batch_id, **counts.asDict()}, owned)
        commit.publish()

    def _fold(self, commit: Commit, fresh: DataFrame, gone: DataFrame, counted: dict, found: DataFrame) -> None:
        """Takes lines (path, generation, byte_offset, line) and retractions into the commit. The lines are
        read once, into a table that lasts as long as the commit."""
        read = Observation()
        amount = [F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes")]
        fresh = commit.keep("lines", logs.texts(fresh.observe(read, *amount)))
        context = self.store.read("context", CONTEXT)
        recorded, opened, malformed = [], [], []
        for provider, own in providers.owned(fresh):
            malformed.append(provider.malformed(own).select("malformed"))
            if provider.open_lines:  # what a file's last batch left open comes before its new lines
                carried = context.join(own.select("path", "generation").distinct(), ["path", "generation"], "left_semi")
                own = own.select("path", "generation", "byte_offset", "text").unionByName(carried)
                opened.append(_with_generation(provider.open_lines(_by_generation(own))).select(*_names(CONTEXT)))
            records = provider.placed(_with_generation(provider.records(_by_generation(own))))
            recorded.append(record_usage(records, self.states))
        new, gone = commit.keep("fresh", _union(recorded)), commit.keep("gone", gone)
        places = gone.select("source_path", "generation")
        retracted = commit.keep("retracted", self.occurrences.join(places, ["source_path", "generation"], "left_semi"))
        keys = new.select("event_fingerprint").union(retracted.select("event_fingerprint"))
        without = lambda old: old.join(places, ["source_path", "generation"], "left_anti")
        before, after = self._rewrite(commit, keys, lambda old: reconcile.record_once(without(old), new))
        kept = context.join(fresh.select("path").distinct(), "path", "left_anti")
        kept = kept.join(places.withColumnRenamed("source_path", "path"), ["path", "generation"], "left_anti")
        commit.write("context", _union([kept, *opened]))
        self._take_agents(commit, fresh, gone)
        sessions = found if "session_id" in found.columns else providers.placed(found)
        size = sessions.agg(F.countDistinct("session_id").alias("s"), F.countDistinct("path").alias("p")).first()
        lost = retracted.join(gone.where("vanished"), ["source_path", "generation"], "left_semi")
        counted |= {"version": commit.version, "discovered_sessions": size.s, "discovered_sources": size.p, **read.get}
        counted |= {"malformed": _union(malformed).agg(F.coalesce(F.sum("malformed"), F.lit(0))).first()[0]}
        retractions = retracted.count()
        counted |= {"removed": lost.count(), "inserted": after - before + retractions}
        counted.setdefault("rewritten", 0)
        counted.setdefault("errors", 0)
        counted["changed"] = bool(counted["inserted"] or retractions)
        commit.append("batches", self.spark.createDataFrame([tuple(counted[c] for c in _names(BATCHES))], BATCHES), BATCHES)

    def _take_agents(self, commit: Commit, fresh: DataFrame, gone: DataFrame) -> None:
        """Agents of the new lines. A row that names more than the file's path does takes the place of the
        one that is known, and so does any row where that file has gone or was written anew."""
        made = []
        for provider, own in providers.owned(fresh):
            paths = provider.placed(own.select("path")).groupBy("session_id", "agent_id").agg(F.min("path").alias("source_path"))
            made.append(provider.agents(own).select(*_names(AGENT)).join(paths, ["session_id", "agent_id"]).select(*_names(AGENTS)))
        known = self.agents.join(gone.select("source_path"), "source_path", "left_anti").withColumn("_new", F.lit(0))
        rows = known.select(*_names(AGENTS), "_new").unionByName(_union(made).withColumn("_new", F.lit(1)))
        plain = F.col("agent_key").isin("main", "subagent") | (F.col("agent_key") == F.col("agent_id"))
        rows = rows.withColumn("_worth", F.struct((~plain).cast("int"), F.col("_new")))
        commit.write("agents", reconcile.latest(rows, ["session_id", "agent_id"], "_worth").select(*_names(AGENTS)))

    def _rewrite(self, commit: Commit, keys: DataFrame, change) -> tuple[int, int]:
        """Occurrences as change makes them, and the calls of keys anew, in the buckets that keys touch.
        Gives the numbers of occurrences there before and after."""
        keys = commit.keep("keys", keys.distinct())
        buckets = [r.b for r in keys.select(bucket_of("event_fingerprint").alias("b")).distinct().collect()]
        if not buckets:
            return 0, 0
        old = self.store.read("occurrences", OCCURRENCE, buckets)
        commit.write_buckets("occurrences", change(old).select(*_names(OCCURRENCE)), "event_fingerprint", buckets)
        now, calls = commit.read("occurrences", OCCURRENCE, buckets), self.store.read("calls", CALLS, buckets)
        sessions = commit.read("sessions", SESSION) if "sessions" in commit.parts else self.sessions
        made = reconcile.rebuilt(calls.select(*_canonical_columns()), now, sessions, keys).select(*_canonical_columns())
        priced = pricing.sticky_price(made, calls, self.rates).select(*_names(CALLS))
        commit.write_buckets("calls", priced, "event_fingerprint", buckets)
        return old.count(), now.count()

    def refresh_sessions(self, sessions: DataFrame) -> None:
        """Takes up new and changed sessions; where the age of one has changed, the calls that it has a
        part in are attributed anew. Sessions that are not named stay."""
        commit, new = self.store.begin(), _filled(sessions, SESSION)
        old = self.sessions
        commit.write("sessions", old.join(new, "session_id", "left_anti").unionByName(new))
        age = old.select("session_id", F.col("created_at_ms").alias("_old"))
        changed = new.join(age, "session_id", "left").where(~F.col("created_at_ms").eqNullSafe(F.col("_old"))).select("session_id")
        keys = self.occurrences.join(changed, "session_id", "left_semi").select("event_fingerprint")
        self._rewrite(commit, keys, lambda occurrences: occurrences)
        commit.publish()

    def classify(self, detected_state_id: int | None = None) -> None:
        """Meters the occurrences that have no account state yet, as after the first detection of one."""
        commit = self.store.begin()
        bare = self.occurrences.where("provider = 'anthropic' and account_state_id is null")
        self._rewrite(commit, bare.select("event_fingerprint"), lambda old: metering.backfill(old, self.states, detected_state_id))
        commit.publish()

    def detect(self, states: DataFrame) -> None:
        """Account states as they are known from now on. Calls from before the first that was ever detected
        are metered by it at once; those that have a state keep it."""
        self.states = states
        bare = self.occurrences.where("provider = 'anthropic' and account_state_id is null")
        if not states.isEmpty() and not bare.isEmpty():
            self.classify()

    def reprice(self, rates: DataFrame) -> dict[str, int]:
        """Prices all calls anew by these rates, which hold from now on; gives the totals."""
        self.rates = rates
        commit, buckets = self.store.begin(), range(BUCKETS)
        priced = pricing.price(self.calls.select(*_canonical_columns()), rates).select(*_names(CALLS))
        commit.write_buckets("calls", priced, "event_fingerprint", buckets)
        commit.publish()
        metered, cost = F.col("is_metered"), F.col("total_cost_nano")
        totals = [F.count_if(metered).alias("call_count"), F.coalesce(F.sum(F.when(metered, cost)), F.lit(0)).alias("total_cost_nano"), F.count_if(metered & cost.isNull()).alias("unpriced_call_count")]
        return self.calls.agg(*totals).first().asDict()

    def start(self, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Follows the logs below a folder; every: as '30 seconds', or once over what is there.

        The stream tells that something has changed; how far each file was read is the store's to know.
        So a lost checkpoint, a batch that comes again or another folder's stream loses and repeats nothing."""
        self.spark.dataSource.register(logs.LogTicks)
        ticks = self.spark.readStream.format("log-ticks").option("path", root).option("suffix", ",".join(providers.suffixes())).load()
        writer = ticks.writeStream.foreachBatch(lambda _, batch_id: self.take(root, batch_id)).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def _by_generation(lines: DataFrame) -> DataFrame:
    """Each generation of a file as a path of its own, as the parsers carry state along a path."""
    return lines.withColumn("path", F.concat_ws("\x00", "path", F.col("generation").cast("string")))


def _with_generation(rows: DataFrame) -> DataFrame:
    parts = F.split("path", "\x00")
    return rows.withColumns({"generation": parts[1].cast("long"), "path": parts[0]})


def _filled(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, null where df lacks one."""
    kinds = [c.split() for c in schema.split(", ")]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _canonical_columns() -> list[str]:
    priced = {*COSTS, "resolved_model_key", "rate_id", "pricing_confidence", "pricing_basis"}
    return [c for c in _names(CALLS) if c not in priced]
