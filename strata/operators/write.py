"""Writing data files: layout by partition keys and sort keys, and the footers' statistics for the commit."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import encode, filesystem, located
from ..sources.types import ROW_ID, ROW_ID_FIELD, from_spark, to_spark

TRANSFORMS = {"identity": lambda c: c, "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}
#: Footers are read on the driver up to so many files, beyond that by Spark tasks.
DRIVER_FOOTERS = 64


def partition_column(name: str, transform: str) -> Column:
    return TRANSFORMS[transform](F.col(f"`{name}`"))


def parse_partition_key(text: str) -> tuple[str, str]:
    """``col`` or ``year(col)`` as (column, transform)."""
    m = re.fullmatch(r"\s*(?:(\w+)\s*\(\s*(\w+)\s*\)|(\w+))\s*", text)
    if not m or (m[1] and m[1].lower() not in TRANSFORMS):
        raise ValueError(f"unsupported partition key: {text}")
    return (m[2], m[1].lower()) if m[1] else (m[3], "identity")


def parse_sort_key(text: str) -> tuple[str, str, str]:
    """``expr [ASC|DESC] [NULLS FIRST|LAST]`` as (expression, direction, null order); nulls come last if not said."""
    m = re.fullmatch(r"(?is)\s*(.+?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?\s*", text)
    if not m or re.search(r"(?i)\bcollate\b", m[1]):
        raise ValueError(f"unsupported sort key: {text}")
    return m[1], (m[2] or "ASC").upper(), f"NULLS_{(m[3] or 'LAST').upper()}"


def sort_columns(keys: list[dict]) -> list[Column]:
    out = []
    for k in keys:
        column = F.expr(k["expression"])
        down, first = k["sort_direction"] == "DESC", k["null_order"] == "NULLS_FIRST"
        out.append((column.desc_nulls_first() if first else column.desc_nulls_last()) if down else (column.asc_nulls_first() if first else column.asc_nulls_last()))
    return out


def shaped(df: DataFrame, columns: list[dict], row_id: bool = False) -> DataFrame:
    """df with the columns, types and field ids of the table; missing columns take their defaults."""
    picked = []
    have = {c.lower(): c for c in df.columns}
    for c in columns:
        kind = to_spark(c["column_type"])
        if c["column_name"].lower() in have:
            value = F.col(f"`{have[c['column_name'].lower()]}`").cast(kind)
        else:
            value = F.expr(c["default_value"]).cast(kind) if c["default_value"] is not None else F.lit(None).cast(kind)
        if not c["nulls_allowed"]:
            value = F.coalesce(value, F.raise_error(F.lit(f"null value in column \"{c['column_name']}\" violates not-null constraint")).cast(kind))
        picked.append(value.alias(c["column_name"], metadata={"parquet.field.id": c["column_id"]}))
    if row_id:
        picked.append(F.col("_row_id").alias(ROW_ID, metadata={"parquet.field.id": ROW_ID_FIELD}))
    return df.select(*picked)


def _footer(data_path: str, path: str, ids: dict[str, int]) -> dict:
    where = located(data_path, path)
    files, name = filesystem(where)
    with files.open_input_file(name) as file:
        size, meta = file.size(), pq.ParquetFile(file).metadata
    found: dict[str, list[Any]] = {}
    for g in range(meta.num_row_groups):
        for k in range(meta.num_columns):
            column = meta.row_group(g).column(k)
            if column.path_in_schema not in ids:
                continue
            s, total = column.statistics, found.setdefault(column.path_in_schema, [0, 0, None, None, True])
            total[0] += column.num_values
            if s is None or s.null_count is None:
                total[4] = False
                continue
            total[1] += s.null_count
            if s.has_min_max:
                total[2] = s.min if total[2] is None else min(total[2], s.min)
                total[3] = s.max if total[3] is None else max(total[3], s.max)
            elif s.null_count != column.num_values:
                total[4] = False
    stats = []
    for column, (values, nulls, low, high, sure) in found.items():
        plain = low is None or not isinstance(low, (bytes, float)) or (isinstance(low, float) and low == low and high == high)
        if sure and plain:
            stats.append((ids[column], values, nulls, encode(low), encode(high)))
    return {"path": path, "record_count": meta.num_rows, "file_size_bytes": size, "stats": stats}


def footers(df: DataFrame, data_path: str, paths: list[str], ids: dict[str, int]) -> list[dict]:
    """Counts and statistics of data files; one small row a file comes to the driver."""
    if len(paths) <= DRIVER_FOOTERS:
        return [_footer(data_path, p, ids) for p in paths]
    spark = df.sparkSession
    kind = pa.schema([("path", pa.string()), ("record_count", pa.int64()), ("file_size_bytes", pa.int64()), ("stats", pa.list_(pa.struct([("column", pa.int64()), ("rows", pa.int64()), ("nulls", pa.int64()), ("low", pa.string()), ("high", pa.string())])))])
    names = [f.name for f in kind.field("stats").type.value_type]

    def run(batches):
        for batch in batches:
            found = [_footer(data_path, p, ids) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([f | {"stats": [dict(zip(names, x, strict=True)) for x in f["stats"]]} for f in found], schema=kind)

    spread = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(2, len(paths) // DRIVER_FOOTERS))
    made = spread.mapInArrow(run, "path string, record_count long, file_size_bytes long, stats array<struct<column:long,rows:long,nulls:long,low:string,high:string>>").collect()
    return [{"path": r.path, "record_count": r.record_count, "file_size_bytes": r.file_size_bytes, "stats": [tuple(x) for x in r.stats]} for r in made]


def listed(df: DataFrame, data_path: str, folder: str) -> list[str]:
    """Data files below a folder, with paths as the catalog has them."""
    where = located(data_path, folder)
    files, name = filesystem(where)
    found = files.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    return sorted(folder + f.path[len(name) :] for f in found if f.is_file and f.base_name.endswith(".parquet"))


@contextlib.contextmanager
def _advised(spark: SparkSession, options: dict) -> Iterator[None]:
    """Adaptive execution aims at the target file size, if the options give one."""
    key, size = "spark.sql.adaptive.advisoryPartitionSizeInBytes", options.get("target_file_size")
    before = spark.conf.get(key, None)
    if size:
        spark.conf.set(key, str(int(size)))
    try:
        yield
    finally:
        if size:
            spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def write(df: DataFrame, data_path: str, table: dict, columns: list[dict], partition: list[dict], sort: list[dict], options: dict, row_id: bool = False) -> list[dict]:
    """Writes df as new data files of the table, not yet part of any snapshot, and returns their descriptions.

    With partition keys each file holds one tuple of values: Spark deals the rows out by the keys' folders,
    which are only a layout; the values go to the catalog as text.  Adaptive execution splits the rows of
    one tuple over as many tasks, and so files, as the target size asks for, and puts small ones together.
    """
    folder = f"{table['path'].rstrip('/')}/{uuid.uuid4().hex}"
    out = shaped(df, columns, row_id)
    keys = []
    for i, k in enumerate(partition):
        keys.append(f"_p{i}")
        out = out.withColumn(f"_p{i}", F.coalesce(partition_column(k["column_name"], k["transform"]).cast("string"), F.lit("\0")))
        out = out.withColumn(f"_p{i}", F.concat(F.lit("v"), F.hex(F.encode(f"_p{i}", "utf-8"))))
    if keys:
        out = out.hint("rebalance", *[F.col(k) for k in keys])
    elif options.get("per_thread_output") == "false":
        out = out.coalesce(1)
    if sort or keys:
        out = out.sortWithinPartitions(*keys, *sort_columns(sort))
    writer = out.write.option("compression", options.get("parquet_compression", "snappy"))
    if options.get("parquet_row_group_size_bytes"):
        writer = writer.option("parquet.block.size", options["parquet_row_group_size_bytes"])
    if options.get("parquet_row_group_size"):
        writer = writer.option("parquet.block.row.count.limit", options["parquet_row_group_size"])
    if options.get("parquet_compression_level"):
        writer = writer.option("parquet.compression.codec.zstd.level", options["parquet_compression_level"])
    if str(options.get("parquet_version", "1")).lstrip("vV") == "2":
        writer = writer.option("parquet.writer.version", "v2")
    if options.get("max_records_per_file"):
        writer = writer.option("maxRecordsPerFile", options["max_records_per_file"])
    if keys:
        writer = writer.partitionBy(*keys)
    with _advised(df.sparkSession, options if keys else {}):
        writer.parquet(located(data_path, folder))
    ids = {c["column_name"]: c["column_id"] for c in columns}
    files = [f for f in footers(df, data_path, listed(df, data_path, folder), ids) if f["record_count"]]
    for f in files:
        f["has_row_id"] = row_id
        if keys:
            values = [bytes.fromhex(m[1]).decode() for m in re.finditer(r"_p\d+=v([^/]*)/", f["path"])]
            f["partition"] = [None if v == "\0" else v for v in values]
            f["partition_id"] = partition[0]["partition_id"]
    return files


def columns_of(df: DataFrame) -> list[dict]:
    """Column descriptions of a DataFrame's schema."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "void":
            raise ValueError(f"column {f.name} has no type")
        out.append({"name": f.name, "type": from_spark(f.dataType), "nullable": True})
    return out
