"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round is two aggregations with joins; nothing but counts reaches the driver, and each round is stored in the
shared folder, so that a lost executor costs that round's tasks only. A hub's edges meet in no single task: its least
neighbour comes from a partial aggregation, and the join back to its edges can be split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins each node's neighbours to the least of them: larger ones in a large star, no larger ones in a small star."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where("v < u")
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    rows = seen.join(least, F.col("u") == F.col("k"))
    out = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else rows.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that has an edge; component is the least id reached. Null ends are no edges."""
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = stored(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
