"""Packing documents into fixed-length sequences as a cutting-stock problem.

A document's full blocks of the capacity are sequences by themselves; the remainders are the orders of
a cutting-stock problem, the very short ones bundled.  Their length histogram, in classes of a few tokens, is all that the driver
sees: a linear program over cutting patterns, whose columns a knapsack dynamic program prices; the
rounded-down patterns and a first-fit packing of the few orders left are then laid over the documents
by their rank within each class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoding import encoder
from .store import column, saved

CAPACITY = 2048
#: Tokens a length class spans: at most CAPACITY / GRID classes, whatever the corpus.
GRID = 8
#: Pieces below this share of the capacity would lose much to the classes: a partition's are bundled, up to that share, and a bundle is cut as one order.
SMALL, BUNDLE = 32, 4
#: The linear program ends this near its optimum.
GAP = 5e-4


def _price(value: np.ndarray, units: int) -> np.ndarray:
    """The pattern of the highest total value that fits: an unbounded knapsack by dynamic programming.  value[c] is of class c, which takes c units."""
    best, choice = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for w in range(1, units + 1):
        total = best[w - 1 :: -1][:w] + value[1 : w + 1]
        c = int(total.argmax()) + 1
        if total[c - 1] > best[w - 1] + 1e-12:
            best[w], choice[w] = total[c - 1], c
        else:
            best[w], choice[w] = best[w - 1], 0
    pattern, w = np.zeros(units + 1, np.int64), units
    while w > 0:
        c = int(choice[w])
        if c:
            pattern[c] += 1
        w -= c or 1
    return pattern


def plan(demand: np.ndarray, most_columns: int = 6000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is cut, so that class c is cut at least demand[c] times.

    demand has units + 1 entries; the class of index c takes c of the units.  The linear program starts
    from one-class patterns and takes in the best priced column until none is worth more than a sequence.
    Rounding errors in it can cost sequences but no order: what the rounded patterns miss is packed after.
    """
    units = len(demand) - 1
    classes = np.flatnonzero(demand[1:] > 0) + 1
    if not len(classes):
        return []
    n = len(classes)
    columns = [np.zeros(units + 1, np.int64) for _ in range(n)]
    for column, c in zip(columns, classes, strict=True):
        column[c] = units // c
    basis: list[np.ndarray | int] = list(columns)  # an int is the surplus of a class
    cost = np.ones(n)
    inverse = np.diag([1.0 / (units // c) for c in classes])
    level = inverse @ demand[classes].astype(float)
    bound = 0.0
    for _ in range(most_columns):
        dual = cost @ inverse
        k = int(dual.argmin())
        if dual[k] < -1e-9:
            enter, entry, entry_cost = k, np.zeros(n), 0.0
            entry[k] = -1.0
        else:
            value = np.zeros(units + 1)
            value[classes] = np.maximum(dual, 0)
            enter = _price(value, units)
            worth = float(enter @ value)
            bound = max(bound, float(value @ demand) / max(worth, 1.0))  # no solution takes fewer sequences
            if worth <= 1 + 1e-7 or cost @ level <= bound * (1 + GAP):
                break
            entry, entry_cost = enter[classes].astype(float), 1.0
        way = inverse @ entry
        rows = np.flatnonzero(way > 1e-10)
        if not len(rows):
            break
        ratio = level[rows] / way[rows]
        row = rows[int(ratio.argmin())]
        far = level[row] / way[row]
        level = np.maximum(level - far * way, 0)
        level[row] = far
        pivot = inverse[row] / way[row]
        inverse = inverse - np.outer(way, pivot)
        inverse[row] = pivot
        basis[row], cost[row] = enter, entry_cost
    left = demand.copy()
    out: list[tuple[np.ndarray, int]] = []
    for column, x in zip(basis, level, strict=True):
        if isinstance(column, np.ndarray):
            times = int(x + 1e-6)
            while times and (column * times > left).any():
                times -= 1
            if times:
                out.append((column, times))
                left = left - column * times
    while left.sum():  # first fit, longest first, a whole pattern at a time
        pattern, room = np.zeros(units + 1, np.int64), units
        for c in np.flatnonzero(left)[::-1]:
            take = min(int(left[c]), room // int(c))
            pattern[c], room = take, room - take * int(c)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left = left - pattern * times
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grid: int = GRID, keep_ids: bool = False) -> DataFrame:
    """Encoded documents cut at multiples of the capacity: (doc_id, start, length, ids_crc32, doc_tokens, class, part, rank[, ids]).

    ``rank`` counts the orders of one class within their partition ``part``; an order is a piece, or a
    bundle of small ones, whose pieces share their class and rank.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, end_id)
        ranks = np.zeros(capacity // grid + 2, np.int64).tolist()
        bundle: list[tuple] = []

        def ranked(size: int) -> tuple[int, int]:
            c = -(-size // grid)
            ranks[c] += 1
            return c, ranks[c] - 1

        def closed() -> list[tuple]:
            c, rank = ranked(sum(x[2] for x in bundle))
            out = [(doc, start, length, crc, total, c, part, rank, *ids) for doc, start, length, crc, total, *ids in bundle]
            bundle.clear()
            return out

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * keep_ids
            arrays = [pa.array(x, t) for x, t in zip(columns[1:], types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of), *arrays], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank", *["ids"] * keep_ids])

        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 256):
                own, rows = batch.slice(lo, 256), []
                for doc, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    ids = encode.encode(text)
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        cut = ids[4 * start : 4 * (start + length)]
                        if length * SMALL < capacity:
                            if bundle and (sum(x[2] for x in bundle) + length) * BUNDLE > capacity:
                                rows += closed()
                            bundle.append((doc, start, length, zlib.crc32(cut), total) + (cut,) * keep_ids)
                        else:
                            c, rank = ranked(length)
                            rows.append((doc, start, length, zlib.crc32(cut), total, c, part, rank) + (cut,) * keep_ids)
                if rows:
                    yield made(rows)
        if bundle:
            yield made(closed())

    return docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grid: int = GRID, keep_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Null text is empty and has its end id alone; without an end id an empty text has no piece.  Rows with
    one id, null ids and equal rows are packed each by itself.  An empty table gives no rows.  ``keep_ids``
    carries the ids along as little-endian 32-bit integers.
    """
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, end_id, id_col, text_col, capacity, grid, keep_ids), "pieces")
    parts = saved(cut.groupBy("class", "part").agg((F.max("rank") + 1).alias("n")), "piece-counts")
    units = capacity // grid
    demand = np.zeros(units + 1, np.int64)
    for c, n in parts.groupBy("class").agg(F.sum("n")).collect():  # a row a class: at most capacity / grid + 1
        demand[min(c, units)] += n
    patterns = plan(demand)
    base = np.concatenate(([0], np.cumsum([times for _, times in patterns]))).astype(np.int64)
    slots = {c: [(p, int(pattern[c]), times) for p, (pattern, times) in enumerate(patterns) if pattern[c]] for c in np.flatnonzero(demand).tolist()}
    ends = {c: np.cumsum([each * times for _, each, times in own]) for c, own in slots.items()}
    table = spark.sparkContext.broadcast((base, slots, ends))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(F.col("class").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shifts, (F.col("class") == F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    ranked = ranked.select(*names, "class", (F.col("rank") + F.col("shift")).alias("at"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*names).schema) + ", sequence_id long"

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, own, stops = table.value
        for batch in batches:
            kind = np.minimum(batch.column(len(names)).to_numpy(), units)
            at = batch.column(len(names) + 1).to_numpy()
            sequence = np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                here = np.flatnonzero(kind == c)
                which = np.searchsorted(stops[c], at[here], "right")
                pattern, each, _ = (np.array(x)[which] for x in zip(*own[c], strict=True))
                first = np.concatenate(([0], stops[c]))[which]
                sequence[here] = starts[pattern] + (at[here] - first) // each
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence)], names=[*names, "sequence_id"])

    laid = ranked.mapInArrow(lay, schema)
    within = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")
    return laid.withColumn("offset", offset).select(*names[:5], "sequence_id", "offset", *names[5:])
