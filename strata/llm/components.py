"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs: root is the least node that it is connected to.

    Large star ties each node's larger neighbours to its least one, small star the smaller ones; the edges
    end as stars around the roots after a number of rounds that grows as the squared logarithm of the
    nodes at most.  Least neighbours are aggregated before the shuffle and joined back, so that the hub of
    a large component is no task's alone.  Edges stay in the shared folder from round to round.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = large.join(least, F.col("a") == F.col("u"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        after = saved(small.distinct(), "edges")
        dropped(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
