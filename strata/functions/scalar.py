"""Functions that queries of the lake's SQL dialect use and Spark lacks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; at most 92 are needed for 64 bits."""
    state = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), state, step, lambda s: s["x"])


def entropy(groups, key: str, by: list[str]):
    """Shannon entropy in bits of a column's values in each group of a DataFrame: two aggregations."""
    counts = groups.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    return counts.groupBy(*by).agg((F.log2(total) - F.sum(F.col("_n") * F.log2("_n")) / total).alias("entropy"))


def histogram(groups, key: str, by: list[str]):
    """A map of value to count in each group."""
    counts = groups.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "_n")))).alias("histogram"))


def product(value: Column) -> Column:
    """Product of a group's values by logarithms; zero and signs are kept."""
    sign = F.when(F.sum(F.when(value < 0, 1).otherwise(0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.sum(F.when(value == 0, 1).otherwise(0)) > 0, F.lit(0.0)).otherwise(sign * F.exp(F.sum(F.log(F.abs(F.nullif(value, F.lit(0)))))))


def dayofweek0(value: Column) -> Column:
    """Day of the week with Sunday as 0."""
    return F.dayofweek(value) - 1


def date_trunc_ntz(unit: str, value: Column) -> Column:
    """date_trunc that keeps a timestamp without time zone one."""
    return F.date_trunc(unit, value).cast("timestamp_ntz")


def zip_unnest(*arrays: Column) -> Column:
    """Rows of parallel arrays side by side, short ones padded with null: to be used with inline()."""
    return F.inline(F.arrays_zip(*arrays))
