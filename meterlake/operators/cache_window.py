"""Cache-inactivity analysis: hits and misses between neighbouring calls of a stream, and the gap
at which hits turn into misses."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import times
from meterlake.operators import ranks
from meterlake.operators.ordered import running
from meterlake.session import stored

STREAM = ["session_id", "agent_id", "model"]
ORDER = ["request_ms", "usage_ms", "event_fingerprint"]
EXCLUSIONS = ["invalidChronology", "insufficientPriorCache", "requestConfigurationChanged", "messageCountRegressed", "promptSizeChanged"]
#: Label, lower and upper bound of the gap in minutes.
BANDS = [("< 30 min", None, 30), ("30–50 min", 30, 50), ("50–60 min", 50, 60), ("60–75 min", 60, 75), ("≥ 75 min", 75, None)]
SENSITIVITY = [65_536, 98_304, 131_072]


@dataclass(frozen=True)
class Options:
    min_cache_read: int = 65_536
    min_hit_ratio: float = 0.9
    max_miss_ratio: float = 0.5
    min_rebilled_ratio: float = 0.8
    min_prompt_ratio: float = 0.8
    max_prompt_ratio: float = 1.25
    stable_configuration: bool = True

    def __post_init__(self):
        if not 0 <= self.max_miss_ratio < self.min_hit_ratio or self.min_prompt_ratio > self.max_prompt_ratio or min(self.min_cache_read, self.min_rebilled_ratio, self.min_prompt_ratio) < 0:
            raise ValueError(f"inconsistent options: {self}")


def positions(calls: DataFrame) -> DataFrame:
    """Adds global_position and session_position in the order of ORDER."""
    calls = running(calls, F.col("request_ms"), times.DAY, ["usage_ms", "event_fingerprint"], {}, "global_position")
    return calls.withColumn("session_position", F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER)) - 1)


def pairs(calls: DataFrame) -> DataFrame:
    """Each call of a stream but the first, with p, the one before it.

    calls: session_id, agent_id, model, request_ms, usage_ms, event_fingerprint, cache_read_tokens,
    input_other_tokens, message_count, system_prompt_hash and tools_hash."""
    own = Window.partitionBy(*STREAM).orderBy(*ORDER)
    kept = ["request_ms", "cache_read_tokens", "input_other_tokens", "message_count", "system_prompt_hash", "tools_hash", "global_position", "session_position"]
    return positions(calls).withColumn("p", F.lag(F.struct(*kept)).over(own)).where("p is not null")


def transitions(calls: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Each call of a stream but the first, against the one before it: kind (hit, miss, ambiguous
    or excluded), reason, gap_ms, calls in between. calls as pairs() takes them."""
    return classified(pairs(calls), options)


def classified(rows: DataFrame, options: Options) -> DataFrame:
    """transitions() of pairs."""
    c, p = F.col, lambda name: F.col(f"p.{name}")
    gap = c("request_ms") - p("request_ms")
    stable = F.coalesce((p("system_prompt_hash") == c("system_prompt_hash")) & (p("tools_hash") == c("tools_hash")), F.lit(False))
    before, now = p("input_other_tokens") + p("cache_read_tokens"), c("input_other_tokens") + c("cache_read_tokens")
    size = F.when(before != 0, now / before)
    checks = [gap < 0, p("cache_read_tokens") < options.min_cache_read, ~stable if options.stable_configuration else F.lit(False), F.coalesce(c("message_count") < p("message_count"), F.lit(False)), size.isNull() | (size < options.min_prompt_ratio) | (size > options.max_prompt_ratio)]
    reason = F.lit(None).cast("string")
    for name, check in reversed(list(zip(EXCLUSIONS, checks, strict=True))):
        reason = F.when(check, name).otherwise(reason)
    # a threshold of 0 lets a call without cached tokens in front: its ratio counts as a hit
    cache = F.when(p("cache_read_tokens") != 0, c("cache_read_tokens") / p("cache_read_tokens")).otherwise(F.lit(float("inf")))
    removed = p("cache_read_tokens") - c("cache_read_tokens")
    kind = F.when(c("reason").isNotNull(), "excluded").when(cache >= options.min_hit_ratio, "hit").when((cache <= options.max_miss_ratio) & (removed > 0) & (c("input_other_tokens") >= options.min_rebilled_ratio * removed), "miss").otherwise("ambiguous")
    between = lambda name: F.greatest(c(name) - p(name) - 1, F.lit(0))
    rows = rows.withColumn("reason", reason).withColumn("kind", kind)
    return rows.select(*STREAM, *ORDER, gap.alias("gap_ms"), "kind", "reason", "cache_read_tokens", "input_other_tokens", p("cache_read_tokens").alias("previous_cache_read_tokens"), size.alias("prompt_size_ratio"), between("global_position").alias("intervening_global"), between("session_position").alias("intervening_session"))


def exclusions(found: DataFrame) -> DataFrame:
    return found.where("kind = 'excluded'").groupBy("reason").agg(F.count("*").alias("transitions"))


def gap_bands(found: DataFrame) -> DataFrame:
    """Hits and misses in each of the five bands, also where there are none."""
    minutes = F.col("gap_ms") / times.MINUTE
    band: Column = F.lit(len(BANDS) - 1)
    for i, (_, _, upper) in reversed(list(enumerate(BANDS[:-1]))):
        band = F.when(minutes < upper, i).otherwise(band)
    counts = found.where("kind in ('hit', 'miss')").groupBy(band.alias("band")).agg(F.count_if(F.col("kind") == "hit").alias("h"), F.count_if(F.col("kind") == "miss").alias("m"))
    spine = found.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(BANDS)], "band int, label string")
    return spine.join(counts, "band", "left").select("band", "label", F.coalesce("h", F.lit(0)).alias("hits"), F.coalesce("m", F.lit(0)).alias("misses"))


def change_point(found: DataFrame) -> DataFrame:
    """One row, or none: the longest gap of a hit, the shortest longer gap of a miss, and what lies
    before and after."""
    rows = found.where("kind in ('hit', 'miss')")
    hit = rows.where("kind = 'hit'").agg(F.max("gap_ms").alias("lower_ms"))
    miss = rows.where("kind = 'miss'").join(hit, F.col("gap_ms") > F.col("lower_ms")).agg(F.min("gap_ms").alias("upper_ms"))
    bounds = hit.crossJoin(miss).where("lower_ms is not null and upper_ms is not null")  # one row each
    rows = rows.crossJoin(bounds)
    before, after, is_miss = F.col("gap_ms") <= F.col("lower_ms"), F.col("gap_ms") >= F.col("upper_ms"), F.col("kind") == "miss"
    only = lambda x: F.when(after, x)
    return rows.groupBy("lower_ms", "upper_ms").agg(
        F.count_if(before & ~is_miss).alias("before_hits"), F.count_if(before & is_miss).alias("before_misses"), F.count_if(after & ~is_miss).alias("after_hits"), F.count_if(after & is_miss).alias("after_misses"),
        F.countDistinct(only(times.day_key(F.col("request_ms")))).alias("after_days"), F.countDistinct(only(F.col("session_id"))).alias("after_sessions"), F.countDistinct(*[only(F.col(c)) for c in STREAM]).alias("after_streams"),
    ).withColumn("estimated_ms", (F.col("lower_ms") + F.col("upper_ms")) / 2)


def longest_hit_run(found: DataFrame) -> DataFrame:
    """One row: length and transitions of the longest run of hits in a stream that nothing else
    interrupts. The count is that at the first row that reaches the length; of equal runs the one
    of the stream whose first call is earliest counts. Without hits apart in time: 0 and 0."""
    own = Window.partitionBy(*STREAM).orderBy(*ORDER)
    rows = found.withColumn("_breaks", F.sum(F.when(F.col("kind") == "hit", 0).otherwise(1)).over(own)).withColumn("_begin", F.min(F.struct("usage_ms", "event_fingerprint")).over(Window.partitionBy(*STREAM)))
    run = Window.partitionBy(*STREAM, "_breaks").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    hits = rows.where("kind = 'hit'").withColumns({"run_ms": F.sum("gap_ms").over(run), "run_length": F.count("*").over(run)}).where("run_ms > 0")
    best = hits.agg(F.min_by(F.struct("run_ms", "run_length"), F.struct(-F.col("run_ms"), "_begin", *ORDER)).alias("b"))
    return best.select(F.coalesce("b.run_ms", F.lit(0)).alias("run_ms"), F.coalesce("b.run_length", F.lit(0)).alias("run_length"))


def miss_median(found: DataFrame) -> DataFrame:
    """Exact median of the cached tokens after a miss."""
    return ranks.median(found.where("kind = 'miss'"), F.col("cache_read_tokens"), "cache_read_after_miss_median")


def analyze(calls: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The report as one row: counts, medians and the three change points. The transitions are
    written once, as the report reads them eight times."""
    found = stored(transitions(calls, options), "transitions")
    counts = found.agg(F.count("*").alias("transitions"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("hit", "hits"), ("miss", "misses"), ("ambiguous", "ambiguous"))], *[F.count_if(F.col("reason") == r).alias(r) for r in EXCLUSIONS])
    size = calls.agg(F.count("*").alias("calls"), F.countDistinct(*STREAM).alias("streams"))
    out = counts.crossJoin(size).crossJoin(miss_median(found)).crossJoin(longest_hit_run(found))  # one row each
    for name, part in (("all", found), ("account_idle", found.where("intervening_global = 0")), ("session_idle", found.where("intervening_session = 0"))):
        point = change_point(part)
        out = out.join(point.select(F.struct(*point.columns).alias(f"{name}_change_point")), F.lit(True), "left")
    return out


def sensitivity(calls: DataFrame, thresholds: list[int] = SENSITIVITY) -> DataFrame:
    """The change point for each least prefix; one row each, nulls where there is none. The pairs are
    written once."""
    rows, out = stored(pairs(calls), "pairs"), None
    for t in thresholds:
        found = classified(rows, Options(min_cache_read=t))
        base = found.agg(F.count_if(F.col("kind").isin("hit", "miss")).alias("classified"))
        row = base.join(change_point(found).select("lower_ms", "upper_ms"), F.lit(True), "left").withColumn("min_cache_read", F.lit(t).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def boundary_log10(misses: Column, total: Column, after: Column) -> Column:
    """log10 of the chance that all calls after the boundary miss at the rate of all."""
    return F.when((misses > 0) & (total > 0), after * F.log10(misses / total))
