"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target size; its documents start with copy probability target / size.  Fractional
documents are paired and exchange mass at random until one of them is integral, so expected copies
stay as asked and the words of the source stay exactly as they were; the one document of each bucket
that is left fractional goes up a reduction tree, and one of each source is rounded alone at its root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import attached, column, saved
from .textkit import mix64, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Units of one source that are paired in one task, at each level of the tree.
BUCKET = 4096


def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size): one row a source, weights repeat in code point order, null last.

    share times all words is dealt by weight; a source stops at ``most`` times its size and the rest is
    dealt anew.  The common level of target / weight is the largest of what remains after capping the
    first k sources by size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    target = F.least("cap", F.max("level").over(everything) * F.col("weight"))
    return rows.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def settle(mass: np.ndarray, size: np.ndarray, key: np.ndarray, last: bool) -> np.ndarray:
    """Rounds masses in [0, size] to 0 or size but for one; with ``last`` that one too.

    The largest fractional unit is paired with the next largest; where that one hasn't room or mass enough
    to settle it either way, with the next ones too, as many as it takes.  The unit becomes full with the
    probability of its share, at the cost of its partners, or else empty and they gain: in such proportion
    that every expectation and the sum stay as they were.  So the unit that is left fractional at the end
    is a small one, unless all smaller ones together couldn't settle it.
    """
    order = np.lexsort((key, -size))
    order = order[(mass[order] > 0) & (mass[order] < size[order])]
    out = np.where(mass >= size, size, 0.0)
    if not len(order):
        return out
    sizes, now, keys = size[order].tolist(), mass[order].tolist(), key[order]
    draws = uniform(mix64(keys)).tolist()
    n, left = len(sizes), -1

    def snapped(value: float, whole: float) -> float:
        return 0.0 if value < 1e-9 * whole else whole if value > whole * (1 - 1e-9) else value

    for i in range(n):
        s, again = sizes[i], 0
        while 0.0 < now[i] < s:
            down = now[i]
            up, need, partners = s - down, 1.0, []
            for j in range(i + 1, n):
                m, t = now[j], sizes[j]
                if 0.0 < m < t:
                    part = min(m / up, (t - m) / down, need)
                    partners.append((j, part))
                    need -= part
                    if need <= 1e-12:
                        need = 0.0
                        break
            if not partners:
                left = i
                break
            draw = draws[i] if not again else float(uniform(mix64(keys[i : i + 1] ^ mix64(np.array([again], np.uint64))))[0])
            again += 1
            fills = draw * s < down
            way = -up if fills else down
            for j, part in partners:
                now[j] = snapped(now[j] + part * way, sizes[j])
            now[i] = (s if fills else 0.0) if not need else snapped(down - (1.0 - need) * way, s)
    if left >= 0 and last:
        now[left] = sizes[left] if uniform(mix64(~keys[left : left + 1]))[0] * sizes[left] < now[left] else 0.0
    out[order] = now
    return out


def _settle_group(table: pa.Table, last: bool) -> pa.Table:
    columns = [table.column(n).to_numpy() for n in ("place", "mass", "weight")]
    order = np.argsort(columns[0], kind="stable")
    key, mass, size = (c[order] for c in columns)
    mass = settle(mass.astype(np.float64), size.astype(np.float64), key.view(np.uint64), last)
    return table.take(pa.array(order)).set_column(table.schema.get_field_index("mass"), "mass", pa.array(mass))


def _settle_some(table: pa.Table) -> pa.Table:
    return _settle_group(table, last=False)


def _settle_last(table: pa.Table) -> pa.Table:
    return _settle_group(table, last=True)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, text_hash, size, rows, source_size, target, copies).

    Rows that agree in id, source and text form one unit, counted in ``rows``, with the same copies.
    Null text and null ids are allowed; a null source is a source; a document without words has size 0
    and is taken floor(target / source_size) times, which adds no words.  An empty table gives no rows.
    The order of rows doesn't matter, and the same table gives the same result.
    """
    spark = docs.sparkSession
    units = docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), F.xxhash64(column(text_col)).alias("text_hash"), word_count(column(text_col)).alias("size"))
    units = saved(units.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    shares = saved(targets(sizes.drop("units"), weights, share, most).join(sizes.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    widest = (shares.agg(F.max("units")).first()[0] or 0) // BUCKET + 1
    level = shares.withColumnsRenamed({"source": "s"})
    rows = units.join(level, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"base": F.floor(wanted).cast("long"), "weight": (F.col("size") * F.col("rows")).cast("double"), "place": F.xxhash64(F.lit(seed), "doc_id", "source", "text_hash", "size")})
    rows = rows.withColumns({"mass": (wanted - F.col("base")) * F.col("weight"), "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.floor(F.col("units") / BUCKET) + 1).cast("long")})
    columns = ["doc_id", "source", "text_hash", "size", "rows", "source_size", "target", "base", "weight", "place", "mass", "bucket"]
    rows, settled = rows.select(columns), []
    while True:
        last = widest <= 1
        rows = rows.groupBy("source", "bucket").applyInArrow(_settle_last if last else _settle_some, rows.schema)
        if last:
            settled.append(rows)
            break
        rows = saved(rows, "mix-level")
        done = (F.col("mass") <= 0) | (F.col("mass") >= F.col("weight"))
        settled.append(rows.where(done))
        rows = rows.where(~done).withColumn("bucket", F.floor(F.col("bucket") / BUCKET).cast("long"))
        widest = (widest - 1) // BUCKET + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.when((F.col("weight") > 0) & (F.col("mass") >= F.col("weight")), 1).otherwise(0)
    return out.select("doc_id", "source", "text_hash", "size", "rows", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents as the mix takes them: each row as many times as its copies, all columns kept, whatever their names.

    Null ids, texts and sources are allowed; rows that agree in all three are taken equally often, and an
    empty table stays empty.
    """
    plan = mix(docs, id_col, text_col, source_col, **how).where(F.col("copies") > 0).select("doc_id", "source", "text_hash", "copies")
    keys = {"doc_id": column(id_col), "source": column(source_col), "text_hash": F.xxhash64(column(text_col))}
    taken, names = attached(docs, keys, plan, "inner")
    times = F.explode(F.array_repeat(F.lit(True), column(names["copies"]).cast("int"))).alias(names["copies"])
    return taken.select(*[column(c) for c in docs.columns], times).drop(names["copies"])
