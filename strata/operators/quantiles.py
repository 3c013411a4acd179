"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def median(rows: DataFrame, column: str, around: float = 0.005) -> float | None:
    """The median of a column as a double, as Spark's median() gives it; None without values.

    Approximate quantiles bound the middle, values below it are counted, and only those in it are put in
    order.  If the median should lie outside, the middle is made wider.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    while True:
        inside = F.lit(True)
        if around < 0.5:
            low, high = values.agg(F.percentile_approx("v", [0.5 - around, 0.5 + around])).first()[0] or (None, None)
            if low is None:
                return None
            below, inside = F.col("v") < F.lit(low), F.col("v").between(low, high)
            n, before, within = values.agg(F.count("v"), F.count_if(below), F.count_if(inside)).first()
        else:
            n, before = values.count(), 0
            within = n
        if not n:
            return None
        ranks = [(n - 1) // 2 - before, n // 2 - before]
        if 0 <= ranks[0] and ranks[1] < within:
            break
        around *= 10
    counts = values.where(inside).groupBy("v").agg(F.count("v").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    a, b = counts.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]).first()
    return 0.5 * a + 0.5 * b
