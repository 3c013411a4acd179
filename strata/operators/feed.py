"""The change feed: rows inserted and deleted between two snapshots, both included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from ..sources.scan import empty, inlined_rows, located, read_files, without_deleted

SYSTEM = ("snapshot_id", "rowid")


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _files(spark: SparkSession, files: list[dict], columns: list[dict], data_path: str, key: str, begins: bool) -> DataFrame:
    rows = read_files(spark, files, columns, data_path, meta=True)
    when = spark.createDataFrame([(f["path"], f[key]) for f in files], "p string, snapshot_id long")
    return rows.join(F.broadcast(when), F.col("_path") == F.col("p")).drop("p")


def insertions(spark: SparkSession, cat: Catalog, data_path: str, table: dict, start: int, end: int) -> DataFrame:
    """Rows that came with snapshots start ... end, with snapshot_id and rowid; what only moved in a flush or a compaction isn't among them."""
    table_id, columns = table["table_id"], cat.columns(table["table_id"], end)
    names = [c["column_name"] for c in columns]
    files = cat.rows("SELECT * FROM data_file WHERE table_id = ? AND begin_snapshot BETWEEN ? AND ? AND silent = 0", table_id, start, end)
    parts = [_files(spark, files, columns, data_path, "begin_snapshot", True)] if files else []
    batches = cat.rows("SELECT * FROM inlined_batch WHERE table_id = ? AND begin_snapshot BETWEEN ? AND ? AND silent = 0", table_id, start, end)
    rows = inlined_rows(spark, cat, table_id, end, columns, batches, meta=True, dead=set())
    if rows is not None:
        when = spark.createDataFrame([(b["batch_uuid"], b["begin_snapshot"]) for b in batches], "p string, snapshot_id long")
        parts.append(rows.join(F.broadcast(when), F.col("_path") == F.col("p")).drop("p"))
    out = _union([p.select("snapshot_id", F.col("_row_id").alias("rowid"), *names) for p in parts])
    return out if out is not None else _none(spark, columns)


def deletions(spark: SparkSession, cat: Catalog, data_path: str, table: dict, start: int, end: int) -> DataFrame:
    """Rows that went with snapshots start ... end."""
    table_id, columns = table["table_id"], cat.columns(table["table_id"], end)
    names = [c["column_name"] for c in columns]
    parts = []
    # Whole files: what was live in them just before, all in one scan.
    ended = cat.rows("SELECT * FROM data_file WHERE table_id = ? AND end_snapshot BETWEEN ? AND ? AND end_silent = 0", table_id, start, end)
    if ended:
        earlier = cat.rows("SELECT d.* FROM delete_file d JOIN data_file f USING (data_file_id) WHERE f.table_id = ? AND f.end_snapshot BETWEEN ? AND ? AND f.end_silent = 0 AND d.begin_snapshot < f.end_snapshot", table_id, start, end)
        rows = without_deleted(spark, _files(spark, ended, columns, data_path, "end_snapshot", False), ended, earlier, data_path)
        parts.append(rows.select("snapshot_id", F.col("_row_id").alias("rowid"), *names))
    # Places in files.
    deletes = cat.rows("SELECT d.path, d.begin_snapshot, d.data_file_id FROM delete_file d WHERE d.table_id = ? AND d.begin_snapshot BETWEEN ? AND ?", table_id, start, end)
    if deletes:
        ids = sorted({d["data_file_id"] for d in deletes})
        files = [f for f in cat.rows("SELECT * FROM data_file WHERE table_id = ?", table_id) if f["data_file_id"] in set(ids)]
        path_of = {f["data_file_id"]: f["path"] for f in files}
        rows = read_files(spark, files, columns, data_path, meta=True)
        gone = spark.read.schema("data_path string, pos long").parquet(*[located(data_path, p) for p in sorted({d["path"] for d in deletes})])
        gone = gone.withColumn("f", F.col("_metadata.file_name"))
        when = spark.createDataFrame([(d["path"].rsplit("/", 1)[-1], path_of[d["data_file_id"]], d["begin_snapshot"]) for d in deletes], "df string, dp string, snapshot_id long")
        gone = gone.join(F.broadcast(when), (F.col("f") == F.col("df")) & (F.col("data_path") == F.col("dp"))).select(F.col("data_path").alias("_gone_path"), F.col("pos").alias("_gone_pos"), "snapshot_id")
        parts.append(rows.join(gone.hint("merge"), (F.col("_path") == F.col("_gone_path")) & (F.col("_pos") == F.col("_gone_pos"))).select("snapshot_id", F.col("_row_id").alias("rowid"), *names))
    dead = cat.rows("SELECT * FROM inlined_delete WHERE table_id = ? AND begin_snapshot BETWEEN ? AND ?", table_id, start, end)
    own = {d["batch_uuid"] for d in dead}
    rows = inlined_rows(spark, cat, table_id, end, columns, [b for b in cat.rows("SELECT * FROM inlined_batch WHERE table_id = ?", table_id) if b["batch_uuid"] in own], meta=True, dead=set())
    if rows is not None:
        when = spark.createDataFrame([(d["batch_uuid"], d["place"], d["begin_snapshot"]) for d in dead], "batch string, place long, snapshot_id long")
        parts.append(rows.join(F.broadcast(when), (F.col("_path") == F.col("batch")) & (F.col("_pos") == F.col("place"))).select("snapshot_id", F.col("_row_id").alias("rowid"), *names))
    out = _union(parts)
    return out if out is not None else _none(spark, columns)


def _none(spark: SparkSession, columns: list[dict]) -> DataFrame:
    names = [c["column_name"] for c in columns]
    return empty(spark, columns).select(F.lit(None).cast("long").alias("snapshot_id"), F.lit(None).cast("long").alias("rowid"), *names)


def changes(spark: SparkSession, cat: Catalog, data_path: str, table: dict, start: int, end: int) -> DataFrame:
    """Both, with change_type; a row id that goes and comes in one snapshot is an update's two images."""
    came = insertions(spark, cat, data_path, table, start, end)
    went = deletions(spark, cat, data_path, table, start, end)
    names = [c for c in came.columns if c not in SYSTEM]
    both = came.withColumn("_came", F.lit(1)).unionByName(went.withColumn("_came", F.lit(0)))
    images = Window.partitionBy("snapshot_id", "rowid")
    updated = F.min("_came").over(images) < F.max("_came").over(images)
    kind = F.when(F.col("_came") == 1, F.when(updated, "update_postimage").otherwise("insert")).otherwise(F.when(updated, "update_preimage").otherwise("delete"))
    return both.select("snapshot_id", "rowid", kind.alias("change_type"), *names)
