"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a pair of aggregations and joins over the edges alone; what a round made is written to the
shared folder and read back, so that neither lineage nor the driver grows. Rounds go as the logarithm of
a component's diameter. The edges of a hub are joined where they lie, so that they don't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syslumen.llm._common import Shared, hot_join


def _lowest(edges: DataFrame, shared: Shared, name: str) -> DataFrame:
    """``a, m, n``: the least neighbour of each node and the number of its edges."""
    return shared.write(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)


def _large_star(edges: DataFrame, shared: Shared, name: str) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both, shared, f"{name}-large-low").select("a", F.least("a", "m").alias("m"), "n")
    return hot_join(both.where("b > a"), low, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, shared: Shared, name: str) -> DataFrame:
    low = _lowest(edges, shared, f"{name}-small-low")
    moved = hot_join(edges, low, ["a"], "n").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    odd = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)")
    return not odd.limit(1).count()


def components(edges: DataFrame, shared: Shared, name: str = "components") -> DataFrame:
    """For each node ``a`` of edges ``(a, b)`` but the least of its component, the row ``(a, b)`` with ``b`` that least node.

    Loops and repeated edges do no harm; nodes with null ends are left out; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = shared.write(edges, f"{name}-0")
    done = 0
    while not _is_forest_of_stars(now):
        done += 1
        large = shared.write(_large_star(now, shared, f"{name}-{done}"), f"{name}-{done}-large")
        now = shared.write(_small_star(large, shared, f"{name}-{done}"), f"{name}-{done}")
        for old in (f"{name}-{done - 1}", f"{name}-{done}-large", f"{name}-{done}-large-low", f"{name}-{done}-small-low"):
            shared.drop(old)
    return now
