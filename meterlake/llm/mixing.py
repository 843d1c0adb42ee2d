"""Mixing sources to target weights.

Each row gets a hash-random key; each source is range-sorted by it in ranges of equal expected
count, so a source of any size spreads over many tasks. Prefix sums of the sizes are made within
each range, and each range starts at the sum of those before it. A source's budget is then cut
off exactly: whole epochs first, and the rest from the beginning of the shuffled order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import scratch

#: A word of a document.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of all sources together for each shuffle partition.
RANGES = 2


def targets(sizes: list[int], weights: list[int], total: int, epochs: int) -> list[float]:
    """Shares of total by weight, none above epochs times its size; what is over goes to the others.

    Sources that reach their cap do so in the order of cap over weight, so one pass finds the level."""
    order = sorted(range(len(sizes)), key=lambda i: (epochs * sizes[i] / weights[i], i))
    rest, weight, level = total, sum(weights), 0.0
    for i in order:
        level = rest / weight
        if level <= epochs * sizes[i] / weights[i]:
            break
        rest, weight = rest - epochs * sizes[i], weight - weights[i]
        level = 0.0 if not weight else level
    return [float(min(level * w, epochs * s)) if level <= epochs * s / w else float(epochs * s) for s, w in zip(sizes, weights, strict=True)]


def mix_sources(df: DataFrame, source: str, size: str, key: str, weights: list[int], epochs: int = 3) -> DataFrame:
    """Adds source_size long, target double and taken long (units of size, repeats counted).

    df: source, size (long, not negative), key (string of hex digits, as random as a digest)
    and whatever else goes along. Sources by code point, null last, take the weights in turn.
    The budget is the sum of all sizes. A source without any size, and an empty table, take
    nothing. The driver holds one row for each source; rows with equal keys keep one order by
    size, so reruns agree. Columns of these names are replaced, others stay."""
    needed, columns = [source, size, key], df.columns
    df = scratch.packed(df, *needed)
    found = sorted(df.groupBy(source).agg(F.sum(size).alias("s"), F.count("*").alias("n")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    own = [weights[i % len(weights)] for i in range(len(found))]
    goal = targets([r.s for r in found], own, sum(r.s for r in found), epochs)
    parts, rows = RANGES * scratch.partitions(df.sparkSession), max(1, sum(r.n for r in found))
    plan = [(r[0], r.s, g, int(g + 0.5), max(1, -(-r.n * parts // rows))) for r, g in zip(found, goal, strict=True)]
    kind = df.schema[source].dataType.simpleString()
    plan = df.sparkSession.createDataFrame(plan, f"_source {kind}, source_size long, target double, _budget long, _ranges long")
    df = df.join(plan, df[source].eqNullSafe(plan._source), "left").drop("_source")
    df = df.withColumn("_range", F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.col("_ranges") / F.lit(2**32)))
    own = df.groupBy(source, "_range").agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(source).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(F.col(source).alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(source, "_range").orderBy(key, size).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_before", F.coalesce(F.sum(size).over(within), F.lit(0)))
    df = df.join(own, df[source].eqNullSafe(own._s) & (df._range == own._r), "left")
    whole = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0)
    rest = F.when(F.col("source_size") > 0, F.col("_budget") % F.col("source_size")).otherwise(0)
    cut = F.least(F.greatest(rest - F.col("_base") - F.col("_before"), F.lit(0)), F.col(size))
    df = df.withColumn("taken", (F.col(size) * whole + cut).cast("long"))
    return scratch.unpacked(df, needed, columns, "source_size", "target", "taken")


def with_keys(docs: DataFrame, seed: int) -> DataFrame:
    """Adds _size, the words of the text, and _key, hash-random by seed, id and text alone."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary"))).cast("binary"))
    return docs.withColumns({"_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_key": key})


def op6_mix_sources(spark, sf_dir: str, seed: int = 6) -> DataFrame:
    """All documents; weights 1, 2, 3 by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = scratch.written(with_keys(docs, seed).select("doc_id", "source", F.col("_size").alias("size"), "_key"), "mix")
    return mix_sources(rows, "source", "size", "_key", [1, 2, 3]).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 6) -> DataFrame:
    """The mixture itself: a document once for each whole epoch that takes it, and the one that
    the budget cuts with its first words only, one space between them. Columns as in docs, n_chars
    set anew. Documents without words are in no mixture.

    The budgets are planned over narrow rows; the texts move once, to meet their counts."""
    kept, needed = docs.columns, [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    kind = docs.schema["n_chars"].dataType if "n_chars" in kept else None
    keyed = with_keys(scratch.packed(docs, *needed), seed)
    plan = scratch.written(keyed.select("source", "_size", "_key"), "mix")
    plan = mix_sources(plan, "source", "_size", "_key", [1, 2, 3])
    # rows with one key are alike in id, text and so size: they share what was taken of them
    plan = plan.groupBy(F.col("_key").alias("_k")).agg(F.sum("taken").alias("_sum"), F.count("*").alias("_rows"))
    out = keyed.join(plan, keyed._key == plan._k).where("_sum > 0")
    out = out.withColumn("_take", F.expr("_sum div _rows + if(_sum % _rows > 0, 1, 0)"))
    whole, rest = F.expr("cast(_take div _size as int)"), F.col("_take") % F.col("_size")
    times = F.array_repeat(F.lit(None).cast("long"), whole)
    out = out.withColumn("_first", F.explode(F.when(rest > 0, F.concat(times, F.array(rest))).otherwise(times)))
    found = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_first").isNull(), F.col("text")).otherwise(F.array_join(F.slice(found, 1, F.col("_first").cast("int")), " "))
    out = out.withColumn("text", text)
    out = out if kind is None else out.withColumn("n_chars", F.length("text").cast(kind))
    return scratch.unpacked(out, needed, kept)


ORACLE_OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '6', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3.0::DOUBLE * s / w AS ratio, sum(s) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3 * s) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS caps_w
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (total - caps)::DOUBLE / (all_w - caps_w)::DOUBLE AS level FROM r
  WHERE (total - caps)::DOUBLE / (all_w - caps_w)::DOUBLE <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, s AS source_size, CASE WHEN level <= ratio THEN least(level * w, 3.0::DOUBLE * s) ELSE 3.0::DOUBLE * s END AS target FROM r, l),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE size * (budget // source_size) + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
FROM b
"""
