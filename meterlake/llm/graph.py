"""Connected components by star contraction, as joins and aggregations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks each node's larger (large) or other smaller neighbours onto the least of its neighbourhood."""
    near = _both(edges)
    if not large:
        near = near.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = near.join(least, "u")
    if large:
        made = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead from a node of one edge to one that has none of its own."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out > 0 and in > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id and component (least id that is reached) of every node that an edge has.

    Alternates large and small stars until each node hangs on its component's least. All rows
    stay in tables; the driver sees a row a round at most. Loops and repeated edges do no harm; edges
    with a null end are dropped; without edges there are no rows."""
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = edges.select(F.col(a).alias("id")).union(edges.select(F.col(b).alias("id"))).distinct()
    now = scratch.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while not _settled(now):
        now = scratch.written(_stars(_stars(now, True), False), "edges")
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("_least")), "id", "left").select("id", F.coalesce("_least", "id").alias("component"))


def merged(parts: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """parts (id, component) after more edges: only the components that they join are worked on."""
    ends = edges.select(F.col(a).alias("id")).union(edges.select(F.col(b).alias("id"))).distinct()
    new = ends.join(parts, "id", "left_anti").select("id", F.col("id").alias("component"))
    parts = scratch.written(parts.union(new), "parts")
    one, two = (parts.select(F.col("id").alias(x), F.col("component").alias(f"_{x}")) for x in (a, b))
    between = edges.select(a, b).join(one, a).join(two, b).where(F.col(f"_{a}") != F.col(f"_{b}")).select(f"_{a}", f"_{b}").distinct()
    least = components(between, f"_{a}", f"_{b}").select(F.col("id").alias("component"), F.col("component").alias("_least"))
    return parts.join(least, "component", "left").select("id", F.coalesce("_least", "component").alias("component"))
