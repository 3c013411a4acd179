"""Queries on lake tables: each builds its lake from the plain tables and is checked against plain SQL on these."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import Lake
from ..streaming.streams import FeedReader, to_lake
from .relational import table

_made: list[str] = []


@atexit.register
def _clean() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


def _local() -> str:
    path = tempfile.mkdtemp(prefix="strata-lake-")
    _made.append(path)
    return path


def scratch(spark: SparkSession) -> str:
    """A new folder for data below spark.checkpoint.dir, which all machines share; only without that setting a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/lake-{uuid.uuid4().hex}" if shared else _local()


def new_lake(spark: SparkSession) -> Lake:
    """A lake with its catalog on the driver's disk and its data in the shared folder."""
    return Lake.open(spark, _local(), scratch(spark))


def _with(spark: SparkSession, sf_dir: str, *names: str) -> Lake:
    lake = new_lake(spark)
    for name in names:
        lake.create_table_as(name, table(spark, sf_dir, name))
    return lake


def scan_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "lineitem")
    return lake.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus")


def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "lineitem")
    lake.sql("DELETE FROM lineitem WHERE l_quantity < 5")
    return lake.sql("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag")


def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "orders")
    lake.sql("UPDATE orders SET o_orderstatus = 'X', o_totalprice = o_totalprice + 1 WHERE o_totalprice > 200000")
    return lake.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY o_orderstatus")


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "nation")
    table(spark, sf_dir, "nation").selectExpr("n_nationkey + 10 AS k", "upper(n_name) AS name").createOrReplaceTempView("nation_news")
    lake.sql("MERGE INTO nation t USING nation_news s ON t.n_nationkey = s.k WHEN MATCHED THEN UPDATE SET n_name = s.name WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name, n_regionkey) VALUES (s.k, s.name, 0)")
    return lake.table("nation")


def time_travel_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "customer")
    v = lake.current_snapshot()
    lake.sql("DELETE FROM customer WHERE c_acctbal < 0")
    return lake.sql(f"SELECT c_mktsegment, count(*) AS n FROM time_travel('customer', {v}) GROUP BY c_mktsegment")


def time_travel_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    lake = _with(spark, sf_dir, "customer")
    when = dt.datetime.now(dt.timezone.utc)
    lake.sql("DELETE FROM customer WHERE c_acctbal < 0")
    return lake.table("customer", timestamp=when).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def time_travel_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "region")
    v = lake.current_snapshot()
    lake.sql("ALTER TABLE region ADD COLUMN r_note string DEFAULT 'none'")
    lake.sql("ALTER TABLE region RENAME COLUMN r_name TO r_title")
    return lake.table("region", version=v)


def _fed(spark: SparkSession, sf_dir: str) -> tuple[Lake, int]:
    lake = new_lake(spark)
    orders = table(spark, sf_dir, "orders")
    lake.create_table("orders", orders.schema)
    v = lake.current_snapshot()
    lake.insert("orders", orders.where("o_orderkey % 2 = 0"))
    lake.insert("orders", orders.where("o_orderkey % 2 = 1"))
    lake.sql("DELETE FROM orders WHERE o_totalprice < 50000")
    lake.sql("UPDATE orders SET o_orderstatus = 'U' WHERE o_totalprice > 300000")
    return lake, v


def table_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, v = _fed(spark, sf_dir)
    return lake.table_insertions("orders", v, v + 2).select("o_orderkey", "o_totalprice")


def table_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, v = _fed(spark, sf_dir)
    return lake.table_deletions("orders", v + 3, v + 3).select("o_orderkey", "o_totalprice")


def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, v = _fed(spark, sf_dir)
    lake.vacuum("orders")
    return lake.table_changes("orders", v, lake.current_snapshot()).select("change_type", "o_orderkey", "o_orderstatus")


def add_column_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "supplier")
    lake.sql("ALTER TABLE supplier ADD COLUMN s_rank int DEFAULT 20")
    lake.insert("supplier", table(spark, sf_dir, "supplier").where("s_suppkey <= 10").selectExpr("s_suppkey + 100000 AS s_suppkey", "s_name", "s_nationkey", "s_acctbal", "7 AS s_rank"))
    return lake.sql("SELECT s_suppkey, s_name, s_rank FROM supplier")


def rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "nation")
    lake.sql("ALTER TABLE nation RENAME COLUMN n_name TO title")
    lake.sql("INSERT INTO nation VALUES (100, 'ATLANTIS', 1)")
    return lake.sql("SELECT n_nationkey, title FROM nation")


def widen_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "nation")
    lake.sql("ALTER TABLE nation ALTER COLUMN n_regionkey TYPE bigint")
    lake.sql("INSERT INTO nation VALUES (100, 'ATLANTIS', 5000000000)")
    return lake.table("nation")


def drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "nation")
    lake.sql("ALTER TABLE nation DROP COLUMN n_name")
    return lake.table("nation")


def _partitioned(spark: SparkSession, sf_dir: str, *keys: str) -> Lake:
    lake = new_lake(spark)
    orders = table(spark, sf_dir, "orders")
    lake.create_table("orders", orders.schema)
    lake.set_partition("orders", *keys)
    lake.insert("orders", orders)
    return lake


def partition_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _partitioned(spark, sf_dir, "o_orderstatus")
    return lake.table("orders", filters=[("o_orderstatus", "=", "F")]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def partition_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _partitioned(spark, sf_dir, "year(o_orderdate)", "month(o_orderdate)")
    values = lake.metadata_table("file_partition_value").select("partition_key_index", "partition_value").distinct()
    return values.groupBy("partition_key_index").agg(F.count(F.lit(1)).alias("n"))


def partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _partitioned(spark, sf_dir, "year(o_orderdate)")
    lake.set_sort("orders", "o_totalprice")
    return lake.table("orders", filters=[("o_totalprice", ">=", 250000.0)]).select("o_orderkey", "o_totalprice")


def get_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitioned(spark, sf_dir, "o_orderstatus", "year(o_orderdate)").get_partition("orders")


def get_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "nation")
    lake.sql("CREATE INDEX by_name ON nation USING strata_sorted (n_name DESC, n_nationkey NULLS FIRST)")
    return lake.get_sort("nation")


def inline_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "region")
    lake.set_option("data_inlining_row_limit", 100)
    lake.sql("INSERT INTO region VALUES (100, 'ATLANTIS'), (101, 'LEMURIA'), (102, 'MU')")
    lake.sql("DELETE FROM region WHERE r_regionkey = 101")
    lake.sql("UPDATE region SET r_name = 'mu' WHERE r_regionkey = 102")
    lake.flush_inlined_data("region")
    return lake.table("region")


def insert_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = new_lake(spark)
    lake.create_table("t", "id int, val string")
    lake.set_option("data_inlining_row_limit", 100000)
    lake.insert_arrays("t", {"id": list(range(1000)), "val": [f"v{i}" for i in range(1000)]})
    lake.insert_arrays("t", {"id": [1000, 1001], "val": ["x", None]})
    return lake.sql("SELECT id, val FROM t")


def vacuum_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = new_lake(spark)
    nation = table(spark, sf_dir, "nation")
    lake.create_table("nation", nation.schema)
    for i in range(5):
        lake.insert("nation", nation.where(f"n_nationkey % 5 = {i}"))
    lake.sql("VACUUM nation")
    return lake.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def vacuum_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "lineitem")
    lake.sql("DELETE FROM lineitem WHERE l_linenumber = 1")
    lake.sql("VACUUM lineitem")
    return lake.sql("SELECT l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_linenumber")


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files and delete files before and after a vacuum."""
    lake = new_lake(spark)
    nation = table(spark, sf_dir, "nation").coalesce(1)
    lake.create_table("nation", nation.schema)
    for i in range(5):
        lake.insert("nation", nation.where(f"n_nationkey % 5 = {i}").coalesce(1))
    lake.sql("DELETE FROM nation WHERE n_nationkey = 0")
    counts = []
    for when in ("before", "after"):
        files = lake.list_files("nation").agg(F.count(F.lit(1)).alias("f"), F.sum("delete_files").alias("d")).first()
        counts.append((when, files.f, files.d))
        lake.sql("VACUUM nation")
        lake.sql("VACUUM nation")
    return spark.createDataFrame(counts, "step string, data_files long, delete_files long")


def freeze_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "customer")
    file = os.path.join(_local(), "frozen.db")
    lake.freeze(file)
    lake.sql("DELETE FROM customer")
    other = new_lake(spark)
    other.attach("old", file, lake.data_path, frozen=True)
    return other.sql("SELECT count(*) AS n, round(avg(c_acctbal), 4) AS a FROM old.customer")


def foreign_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, other = _with(spark, sf_dir, "nation"), _with(spark, sf_dir, "region")
    lake.attach("far", os.path.dirname(other.path), other.data_path)
    return lake.sql("SELECT n.n_name, r.r_name FROM nation n JOIN far.region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey > 3")


def hybrid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("heap_customer")
    return lake.sql("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o JOIN heap_customer c ON o.o_custkey = c.c_custkey GROUP BY c_mktsegment")


def lake_exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "customer", "orders")
    return lake.sql("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")


def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _with(spark, sf_dir, "orders")
    lake.sql("BEGIN")
    lake.sql("DELETE FROM orders")
    lake.sql("ROLLBACK")
    lake.sql("BEGIN")
    lake.sql("DELETE FROM orders WHERE o_orderstatus = 'F'")
    lake.sql("UPDATE orders SET o_orderpriority = 'none' WHERE o_totalprice < 1000000")
    lake.sql("COMMIT")
    return lake.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")


def stream_to_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events streamed into a lake table, and its change feed polled."""
    lake = new_lake(spark)
    events = table(spark, sf_dir, "events")
    lake.create_table("events", events.schema)
    reader = FeedReader(lake, "events")
    folder = os.path.join(scratch(spark), "in")
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    to_lake(lake, stream, "events", os.path.join(scratch(spark), "check")).awaitTermination()
    return reader.poll().groupBy("change_type", "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "lake_scan_agg": (scan_agg, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL"),
    "lake_delete": (delete, "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE NOT l_quantity < 5 GROUP BY ALL"),
    "lake_update": (update, "SELECT CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_totalprice > 200000 THEN o_totalprice + 1 ELSE o_totalprice END), 2) AS price FROM orders GROUP BY 1"),
    "lake_merge": (merge, "SELECT n.n_nationkey, coalesce(upper(s.n_name), n.n_name) AS n_name, n.n_regionkey FROM nation n LEFT JOIN nation s ON n.n_nationkey = s.n_nationkey + 10 UNION ALL SELECT n_nationkey + 10, upper(n_name), 0 FROM nation WHERE n_nationkey + 10 NOT IN (SELECT n_nationkey FROM nation)"),
    "time_travel_version": (time_travel_version, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "time_travel_timestamp": (time_travel_timestamp, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "time_travel_schema": (time_travel_schema, "SELECT * FROM region"),
    "table_insertions": (table_insertions, "SELECT o_orderkey, o_totalprice FROM orders"),
    "table_deletions": (table_deletions, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000"),
    "table_changes": (table_changes, "SELECT 'insert' AS change_type, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 'delete', o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT 'update_preimage', o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'update_postimage', o_orderkey, 'U' FROM orders WHERE o_totalprice > 300000"),
    "add_column_default": (add_column_default, "SELECT s_suppkey, s_name, 20 AS s_rank FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name, 7 FROM supplier WHERE s_suppkey <= 10"),
    "rename_column": (rename_column, "SELECT n_nationkey, n_name AS title FROM nation UNION ALL SELECT 100, 'ATLANTIS'"),
    "widen_type": (widen_type, "SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 5000000000"),
    "drop_column": (drop_column, "SELECT n_nationkey, n_regionkey FROM nation"),
    "partition_identity": (partition_identity, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "partition_year_month": (partition_year_month, "SELECT 0::BIGINT AS partition_key_index, count(DISTINCT year(o_orderdate)) AS n FROM orders UNION ALL SELECT 1, count(DISTINCT month(o_orderdate)) FROM orders"),
    "partition_prune": (partition_prune, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000"),
    "get_partition": (get_partition, "SELECT * FROM (VALUES (0::BIGINT, 'o_orderstatus', 'identity'), (1, 'o_orderdate', 'year')) t(partition_key_index, column_name, transform)"),
    "get_sort": (get_sort, "SELECT * FROM (VALUES (0::BIGINT, 'n_name', 'DESC', 'NULLS_LAST'), (1, 'n_nationkey', 'ASC', 'NULLS_FIRST')) t(sort_key_index, expression, direction, null_order)"),
    "inline_flush": (inline_flush, "SELECT * FROM region UNION ALL VALUES (100, 'ATLANTIS'), (102, 'mu')"),
    "insert_arrays": (insert_arrays, "SELECT CAST(i AS INT) AS id, 'v' || i AS val FROM range(1000) t(i) UNION ALL VALUES (1000, 'x'), (1001, NULL)"),
    "vacuum_merge": (vacuum_merge, "SELECT * FROM nation"),
    "vacuum_rewrite": (vacuum_rewrite, "SELECT l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1"),
    "file_count_after_vacuum": (file_counts, "SELECT * FROM (VALUES ('before', 5::BIGINT, 1::BIGINT), ('after', 1, 0)) t(step, data_files, delete_files)"),
    "freeze_attach": (freeze_attach, "SELECT count(*) AS n, round(avg(c_acctbal), 4) AS a FROM customer"),
    "foreign_join": (foreign_join, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3"),
    "hybrid_join": (hybrid_join, "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "lake_exists_semi": (lake_exists_semi, "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)"),
    "transaction": (transaction, "SELECT o_orderstatus, CASE WHEN o_totalprice < 1000000 THEN 'none' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2"),
    "stream_to_lake": (stream_to_lake, "SELECT 'insert' AS change_type, event_type, count(*) AS n FROM events GROUP BY event_type"),
}


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
