"""A snapshot of a table as a DataFrame: live files by field id, deleted places anti-joined, inlined rows added.

The file list is pruned by partition values and by the minimum and maximum of each file's columns before
Spark sees it; below that Catalyst pushes filters and columns into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import io
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog
from .prune import TAG, Filter
from .types import ROW_ID, read_schema, to_spark


def filesystem(where: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(where) if ":/" in where else (fs.LocalFileSystem(), where)


def located(data_path: str, path: str) -> str:
    """Where a file of the catalog lies: below the data path, unless its own path is absolute."""
    return path if path.startswith("/") or ":/" in path else f"{data_path}/{path}"


#: Operators that a filter for pruning may have.
OPERATORS = ("=", "<", "<=", ">", ">=", "in")


def _comparable(value: Any) -> Any:
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return value.isoformat() if isinstance(value, dt.date) else value


def encode(value: Any) -> str | None:
    """A statistic as text."""
    if value is None:
        return None
    if isinstance(value, (dt.date, dt.datetime)):
        return str(_comparable(value))
    return str(value)


def _decode(text: str, kind: str) -> Any:
    if kind.startswith(("int", "uint")) and kind != "interval":
        return int(text)
    if kind.startswith("decimal"):
        return Decimal(text)
    if kind.startswith("float"):
        return float(text)
    return text


def transform_of(value: Any, transform: str) -> str | None:
    """A partition value as text."""
    if value is None:
        return None
    if transform == "identity":
        return encode(value)
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return str(getattr(value, transform))


def _may_hold(low: Any, high: Any, op: str, value: Any) -> bool:
    try:
        if op == "in":
            return any(low <= v <= high for v in value)
        return {"=": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[op]
    except TypeError:
        return True


def pruned(cat: Catalog, table_id: int, at: int, files: list[dict], filters: list[tuple[str, str, Any]]) -> list[dict]:
    """The files that may hold rows for all filters (column, operator, value)."""
    columns = {c["column_name"]: c for c in cat.columns(table_id, at)}
    for name, op, value in filters:
        column = columns.get(name)
        if column is None or op not in OPERATORS or value is None:
            continue
        wanted = [_comparable(v) for v in value] if op == "in" else _comparable(value)
        stats = {s["data_file_id"]: s for s in cat.rows("SELECT * FROM file_column_stats WHERE table_id = ? AND column_id = ?", table_id, column["column_id"])}
        keys = cat.rows("SELECT p.partition_id, p.partition_key_index, p.transform FROM partition_column p JOIN partition_info i USING (partition_id) WHERE i.table_id = ? AND p.column_id = ?", table_id, column["column_id"])
        exact = {}
        if op in ("=", "in"):
            values = value if op == "in" else [value]
            for k in keys:
                try:
                    exact[k["partition_id"], k["partition_key_index"]] = {transform_of(v, k["transform"]) for v in values}
                except (AttributeError, ValueError):
                    continue
        own = {(r["data_file_id"], r["partition_key_index"]): r["partition_value"] for r in cat.rows("SELECT * FROM file_partition_value WHERE table_id = ?", table_id)} if exact else {}

        def holds(f: dict) -> bool:
            for (part, index), allowed in exact.items():
                if f["partition_id"] == part and own.get((f["data_file_id"], index)) not in allowed:
                    return False
            s = stats.get(f["data_file_id"])
            if s is None:
                return True
            if s["min_value"] is None:
                return s["null_count"] != s["value_count"]
            kind = column["column_type"]
            return _may_hold(_decode(s["min_value"], kind), _decode(s["max_value"], kind), op, wanted)

        files = [f for f in files if holds(f)]
    return files


_roots: dict[str, str] = {}


def _qualified(spark: SparkSession, path: str) -> str:
    """A folder as Spark's scans name it."""
    if path not in _roots:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        full = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri().toString()
        _roots[path] = full.replace(":///", ":/", 1)  # a scheme without a host has one slash there
    return _roots[path]


def _seen(spark: SparkSession, data_path: str, path: str) -> str:
    """A data file as Spark's scans name it."""
    if located("", path) == path:
        folder, _, name = path.rpartition("/")
        return f"{_qualified(spark, folder)}/{name}"
    return f"{_qualified(spark, data_path)}/{path}"


def read_files(spark: SparkSession, files: list[dict], columns: list[dict], data_path: str, meta: bool, tag: str | None = None, tasks: int | None = None) -> DataFrame:
    """Rows of data files in one vectorised scan; ``meta`` adds _path, _pos and _row_id, ``tag`` names the scan, ``tasks`` are at most so many."""
    schema = read_schema(columns, row_id=meta)
    names = [c["column_name"] for c in columns]
    reader = spark.read.option("mergeSchema", "false")
    rows = (reader.option(TAG, tag) if tag else reader).schema(schema).parquet(*[located(data_path, f["path"]) for f in files])
    if not meta:
        return rows.select(*names)
    rows = rows.select(*names, ROW_ID, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    rows = rows.coalesce(tasks) if tasks else rows  # below the joins, so that a task opens them once
    starts = [(_seen(spark, data_path, f["path"]), f["path"], f["row_id_start"]) for f in files]
    if len(starts) == 1:
        _, path, start = starts[0]
        return rows.select(*names, F.lit(path).alias("_path"), "_pos", F.coalesce(ROW_ID, F.lit(start).cast("long") + F.col("_pos")).alias("_row_id"))
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, "f string, _path string, start long")), F.col("_file") == F.col("f"))  # a row a file; Spark takes a list's size for unbounded and would broadcast the table
    return rows.select(*names, "_path", "_pos", F.coalesce(ROW_ID, F.col("start") + F.col("_pos")).alias("_row_id"))


def inlined_table(batch: dict) -> pa.Table:
    return pa.ipc.open_file(io.BytesIO(batch["rows"])).read_all()


def inlined_rows(spark: SparkSession, cat: Catalog, table_id: int, at: int, columns: list[dict], batches: list[dict], meta: bool, dead: set | None = None) -> DataFrame | None:
    """Rows of inlined batches with the columns of the snapshot, without those deleted by then.

    Batches of one layout become one table before Spark sees them, so the plan has a branch for each
    layout that the table has had, however many batches there are.
    """
    if not batches:
        return None
    if dead is None:
        dead = {(d["batch_uuid"], d["place"]) for d in cat.rows("SELECT * FROM inlined_delete WHERE table_id = ? AND begin_snapshot <= ?", table_id, at)}
    layouts: dict[tuple, list[pa.Table]] = {}
    for b in batches:
        held = inlined_table(b)
        ids = pa.ipc.open_file(io.BytesIO(b["row_ids"])).read_all().column(0).to_pylist() if b["row_ids"] else range(b["row_id_start"], b["row_id_start"] + b["record_count"])
        keep = [i for i in range(b["record_count"]) if (b["batch_uuid"], i) not in dead]
        if not keep:
            continue
        if len(keep) < b["record_count"]:
            held, ids = held.take(pa.array(keep)), [ids[i] for i in keep]
        held = held.append_column("_path", pa.array([b["batch_uuid"]] * len(keep))).append_column("_pos", pa.array(keep, pa.int64())).append_column("_row_id", pa.array(ids, pa.int64()))
        held = pa.Table.from_arrays(held.columns, schema=pa.schema([pa.field(f.name, f.type) for f in held.schema]))
        layouts.setdefault(tuple((f.name, str(f.type)) for f in held.schema), []).append(held)
    out = None
    for tables in layouts.values():
        frame = spark.createDataFrame(pa.concat_tables(tables))
        picked = []
        for c in columns:
            kind = to_spark(c["column_type"])
            stored = f"c{c['column_id']}"
            if stored in frame.columns:
                value = F.col(stored).cast(kind)
            else:
                value = F.expr(c["initial_default"]).cast(kind) if c["initial_default"] is not None else F.lit(None).cast(kind)
            picked.append(value.alias(c["column_name"]))
        frame = frame.select(*picked, *(["_path", "_pos", "_row_id"] if meta else []))
        out = frame if out is None else out.unionByName(frame)
    return out


def empty(spark: SparkSession, columns: list[dict], meta: bool = False) -> DataFrame:
    fields = [T.StructField(c["column_name"], to_spark(c["column_type"])) for c in columns]
    if meta:
        fields += [T.StructField("_path", T.StringType()), T.StructField("_pos", T.LongType()), T.StructField("_row_id", T.LongType())]
    return spark.createDataFrame([], T.StructType(fields))


#: Rows of a file whose deleted places are one bitmap of 4 KB, and how many bitmaps are broadcast at most.
BITMAP_ROWS, BITMAPS = 1 << 15, 1 << 13


def broadcast_places(files: list[dict], deletes: list[dict]) -> bool:
    """Whether the places that ``deletes`` name in ``files`` are broadcast, by the catalog's counts."""
    return min(sum(d["delete_count"] for d in deletes), sum(f["record_count"] // BITMAP_ROWS + 1 for f in files)) <= BITMAPS


def without_deleted(spark: SparkSession, rows: DataFrame, files: list[dict], deletes: list[dict], data_path: str) -> DataFrame:
    """Rows (with _path and _pos) of ``files`` whose places no delete file names.

    The places go to the tasks as bitmaps, and the rows stay where they are.  If the bitmaps would be too
    many, rows and places are both shuffled: the driver never holds more than BITMAPS of them.
    """
    if not deletes:
        return rows
    gone = spark.read.schema("data_path string, pos long").parquet(*[located(data_path, p) for p in sorted({d["path"] for d in deletes})])
    gone = gone.select(F.col("data_path").alias("_gone_path"), F.col("pos").alias("_gone_pos"))
    if not broadcast_places(files, deletes):
        return rows.join(gone.hint("merge"), (F.col("_path") == F.col("_gone_path")) & (F.col("_pos") == F.col("_gone_pos")), "left_anti")
    gone = gone.groupBy("_gone_path", F.expr(f"_gone_pos div {BITMAP_ROWS}").alias("_gone_part")).agg(F.bitmap_construct_agg(F.col("_gone_pos") % BITMAP_ROWS).alias("_gone_bits"))
    rows = rows.join(F.broadcast(gone), (F.col("_path") == F.col("_gone_path")) & (F.expr(f"_pos div {BITMAP_ROWS}") == F.col("_gone_part")), "left")
    byte = F.ascii(F.decode(F.expr(f"substring(_gone_bits, CAST(_pos % {BITMAP_ROWS} div 8 AS INT) + 1, 1)"), "ISO-8859-1"))
    clear = F.expr("shiftleft(1, CAST(_pos % 8 AS INT))").bitwiseAND(byte) == 0
    return rows.where(F.col("_gone_bits").isNull() | clear).drop("_gone_path", "_gone_part", "_gone_bits")


def chosen(cat: Catalog, table_id: int, at: int, alternatives: list[list[Filter]]) -> list[dict]:
    """The live files that may hold rows for all filters of one of the alternatives."""
    files = cat.live("data_file", table_id, at)
    keep = {f["data_file_id"] for filters in alternatives for f in (pruned(cat, table_id, at, files, filters) if filters else files)}
    return [f for f in files if f["data_file_id"] in keep]


def scan(spark: SparkSession, cat: Catalog, data_path: str, table: dict, at: int, filters: list[Filter] | None = None, meta: bool = False, tag: str | None = None, alternatives: list[list[Filter]] | None = None) -> DataFrame:
    """The table at a snapshot.  ``filters`` only prune files; the caller applies them to rows.

    ``alternatives`` are several such lists, of which a file must pass one.
    """
    table_id = table["table_id"]
    columns = cat.columns(table_id, at)
    files = chosen(cat, table_id, at, alternatives or [filters or []])
    deletes = cat.live("delete_file", table_id, at)
    touched = {d["data_file_id"] for d in deletes}
    clean = [f for f in files if f["data_file_id"] not in touched]
    dirty = [f for f in files if f["data_file_id"] in touched]
    names = [c["column_name"] for c in columns] + (["_path", "_pos", "_row_id"] if meta else [])
    parts = []
    if clean:
        parts.append(read_files(spark, clean, columns, data_path, meta, tag))
    if dirty:
        own = {f["data_file_id"] for f in dirty}
        rows = read_files(spark, dirty, columns, data_path, True, tag)
        parts.append(without_deleted(spark, rows, dirty, [d for d in deletes if d["data_file_id"] in own], data_path).select(*names))
    inlined = inlined_rows(spark, cat, table_id, at, columns, cat.live("inlined_batch", table_id, at), meta)
    if inlined is not None:
        parts.append(inlined.select(*names))
    if not parts:
        return empty(spark, columns, meta)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
