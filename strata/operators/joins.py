"""Joins that Spark has no keyword for, as compositions of equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str], slices: Column | None = None) -> DataFrame:
    """Each left row with the columns of the last right row of its keys at or before its time; nulls where there is none.

    Both sides go into one window by key and time and the right side's row is carried forward: one shuffle,
    no range join.  ``slices``, an expression of the time ``_t`` that never falls as time rises (say, its
    day), splits keys with very many rows: each slice is a window of its own, and a small table
    of the last right row before each slice serves those left rows that their slice has none for.
    """
    held = right.select(F.struct(*columns)).schema[0].dataType
    whole = left.select(F.struct(*left.columns)).schema[0].dataType
    a = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(held).alias("_r"))
    b = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(whole).alias("_l"), F.struct(*columns).alias("_r"))
    both = a.unionByName(b).withColumn("_slice", slices if slices is not None else F.lit(0))
    w = Window.partitionBy(*by, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if slices is not None:
        last = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r")))["_r"]
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        earlier = both.groupBy(*by, "_slice").agg(last.alias("_last")).withColumn("_earlier", F.last("_last", ignorenulls=True).over(before))
        earlier = earlier.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slice").alias("_of"), "_earlier")
        same = F.col("_slice").eqNullSafe(F.col("_of"))
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
        carried = carried.join(earlier, same, "left").withColumn("_r", F.when(F.col("_t").isNotNull(), F.coalesce("_r", "_earlier")))
    return carried.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in columns])


def interval_join(points: DataFrame, ranges: DataFrame, on: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the ranges [low, high] that hold them.

    Ranges are cut into cells of ``width`` and joined with the points' cells by equality, so nothing is
    compared with everything; ``width`` should be about the usual length of a range.
    """
    by = by or []
    p = points.withColumn("_cell", F.floor(F.col(on) / width))
    r = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [*by, "_cell"]).where(F.col(on).between(F.col(low), F.col(high))).drop("_cell")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys on the left are dealt over ``salts`` partitions, the right side repeated as often."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")
