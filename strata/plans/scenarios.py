"""Short histories of lake tables, one for each thing that the lake promises, with the plain SQL of their outcome."""

from __future__ import annotations

import datetime as dt
import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import Lake
from ..sources.catalog import Conflict, LakeError
from ..streaming import streams
from .lakes import _local, _with, new_lake, scratch
from .relational import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def outcome(sql: str):
    """Registers a scenario under its own name with the DuckDB SQL of its rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _said(lake: Lake, *statements: str) -> DataFrame:
    """What each statement answers: its tag, or the kind of error."""
    rows = []
    for i, text in enumerate(statements):
        try:
            rows.append((i, lake.sql(text).first()[0]))
        except LakeError as e:
            rows.append((i, f"error: {e}"))
    return lake.spark.createDataFrame(rows, "step int, said string")


def _steps(*said: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(said)) + ") t(step, said)"


def _one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


# Scans.


@outcome("SELECT count(*) AS n FROM nation")
def scan_session_as_of(spark, sf_dir):
    lake = _with(spark, sf_dir, "nation")
    lake.set("as_of_timestamp", dt.datetime.now(dt.timezone.utc).isoformat())
    when = lake.settings["as_of_timestamp"]
    lake.reset("as_of_timestamp")
    lake.sql("DELETE FROM nation WHERE n_nationkey < 10")
    lake.set("as_of_timestamp", when)
    return lake.sql("SELECT count(*) AS n FROM nation")


@outcome("SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(name, kind)")
def scan_foreign_columns(spark, sf_dir):
    """The columns of an attached table come from its own catalog."""
    far, lake = _with(spark, sf_dir, "nation"), new_lake(spark)
    lake.attach("far", os.path.dirname(far.path), far.data_path)
    return spark.createDataFrame(lake.table("far.nation").dtypes, "name string, kind string")


@outcome(_steps(*["error: attached tables are read-only"] * 3))
def scan_read_only(spark, sf_dir):
    far, lake = _with(spark, sf_dir, "nation"), new_lake(spark)
    lake.attach("far", os.path.dirname(far.path), far.data_path)
    return _said(lake, "DELETE FROM far.nation", "UPDATE far.nation SET n_name = 'x'", "INSERT INTO far.nation VALUES (1, 'x', 1)")


@outcome("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' AND n_nationkey > 2")
def scan_two_foreign_lakes(spark, sf_dir):
    one, two, lake = _with(spark, sf_dir, "nation"), _with(spark, sf_dir, "region"), new_lake(spark)
    lake.attach("east", os.path.dirname(one.path), one.data_path)
    lake.attach("west", os.path.dirname(two.path), two.data_path)
    return lake.sql("SELECT n_name, r_name FROM east.nation JOIN west.region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' AND n_nationkey > 2")


@outcome("SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def scan_read_parquet(spark, sf_dir):
    return new_lake(spark).sql(f"SELECT s_nationkey, count(*) AS n FROM read_parquet('{sf_dir}/supplier.parquet') WHERE s_acctbal > 0 GROUP BY s_nationkey")


@outcome("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2")
def scan_uri(spark, sf_dir):
    """Data files under a URI instead of a path."""
    place = scratch(spark)
    lake = Lake.open(spark, _local(), place if ":/" in place else f"file://{place}")
    lake.create_table_as("region", table(spark, sf_dir, "region"))
    lake.sql("DELETE FROM region WHERE r_regionkey = 2")
    return lake.sql("SELECT r_regionkey, r_name FROM region")


@outcome("SELECT unnest([3, 1, 2]) * 2 AS v")
def scan_from_unnest(spark, sf_dir):
    return new_lake(spark).sql("SELECT col * 2 AS v FROM UNNEST(ARRAY[3, 1, 2])")


@outcome("SELECT CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high, count(*) AS n FROM lineitem")
def scan_footer_statistics(spark, sf_dir):
    lake = _with(spark, sf_dir, "lineitem")
    column = next(c["column_id"] for c in lake.cat.columns(lake._table("lineitem")["table_id"], lake._at()) if c["column_name"] == "l_quantity")
    stats = lake.metadata_table("file_column_stats").where(F.col("column_id") == column)
    return stats.agg(F.min(F.col("min_value").cast("double")).alias("low"), F.max(F.col("max_value").cast("double")).alias("high"), F.sum("value_count").alias("n"))


@outcome("SELECT o_orderstatus, count(*) AS n, 1 AS files FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def scan_sql_prune(spark, sf_dir):
    """A filter in SQL reads only the files that may hold its rows."""
    lake = new_lake(spark)
    orders = table(spark, sf_dir, "orders")
    lake.create_table("orders", orders.schema)
    lake.set_partition("orders", "o_orderstatus")
    lake.insert("orders", orders)
    found = lake.sql("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
    return found.withColumn("files", F.lit(len(found.inputFiles())))


# Changes.


@outcome(_steps("CREATE TABLE", "INSERT 0 3", "UPDATE 2", "DELETE 1", "UPDATE 0", "DROP TABLE"))
def dml_row_count_tags(spark, sf_dir):
    return _said(new_lake(spark), "CREATE TABLE cups (a int, b string)", "INSERT INTO cups VALUES (4, 'p'), (5, 'q'), (6, 'r')", "UPDATE cups SET b = 'z' WHERE a > 4", "DELETE FROM cups WHERE a = 6", "UPDATE cups SET b = 'y' WHERE a = 99", "DROP TABLE cups")


@outcome("SELECT * FROM (VALUES ('in catalog', 2::BIGINT), ('too many', 0::BIGINT), ('switched off', 0::BIGINT)) t(what, batches)")
def dml_direct_insert_preconditions(spark, sf_dir):
    out = []
    for what, limit, on, rows in (("in catalog", 10, True, 5), ("too many", 3, True, 5), ("switched off", 0, False, 5)):
        lake = new_lake(spark)
        lake.create_table("t", "a int")
        lake.set_option("data_inlining_row_limit", limit)
        lake.set("enable_direct_insert", on)
        for _ in range(2):
            lake.insert_arrays("t", {"a": list(range(rows))})
        out.append((what, lake.metadata_table("inlined_batch").count()))
    return spark.createDataFrame(out, "what string, batches long")


@outcome("SELECT * FROM (VALUES (1, 'inlined_insert:\"t\"')) t(snapshots, changes)")
def dml_direct_insert_snapshot(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("t", "a int")
    lake.set_option("data_inlining_row_limit", 10)
    before = lake.current_snapshot()
    lake.insert_arrays("t", {"a": [1, 2]})
    new = lake.snapshots().where(F.col("snapshot_id") > before)
    return new.agg(F.count(F.lit(1)).cast("int").alias("snapshots"), F.max("changes").alias("changes"))


@outcome("SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) - 1 AS place FROM nation")
def dml_sort_on_flush(spark, sf_dir):
    """Rows lie in the file in the table's sort order."""
    lake = new_lake(spark)
    nation = table(spark, sf_dir, "nation")
    lake.create_table("nation", nation.schema)
    lake.set_option("data_inlining_row_limit", 1000)
    lake.set_sort("nation", "n_name DESC")
    for i in range(3):
        lake.insert("nation", nation.where(f"n_nationkey % 3 = {i}"))
    lake.flush_inlined_data("nation")
    return lake.scanned("nation", meta=True).select("n_nationkey", F.col("_pos").alias("place"))


@outcome("SELECT n_nationkey, CASE WHEN r_name LIKE 'A%' THEN r_name ELSE n_name END AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dml_update_from(spark, sf_dir):
    lake = _with(spark, sf_dir, "nation", "region")
    lake.sql("UPDATE nation n SET n_name = r.r_name FROM region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name LIKE 'A%'")
    return lake.sql("SELECT n_nationkey, n_name FROM nation")


@outcome("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def dml_delete_using(spark, sf_dir):
    lake = _with(spark, sf_dir, "nation", "region")
    lake.sql("DELETE FROM nation USING region WHERE nation.n_regionkey = region.r_regionkey AND region.r_name LIKE 'A%'")
    return lake.sql("SELECT n_nationkey FROM nation")


@outcome("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 4")
def dml_merge_conditions(spark, sf_dir):
    lake = _with(spark, sf_dir, "nation")
    lake.create_table_as("news", table(spark, sf_dir, "nation").selectExpr("n_nationkey", "lower(n_name) AS n_name").union(table(spark, sf_dir, "nation").selectExpr("n_nationkey + 100", "n_name")))
    lake.sql("""MERGE INTO nation AS target USING (SELECT * FROM news) AS src ON target.n_nationkey = src.n_nationkey
      WHEN MATCHED AND target.n_nationkey % 3 = 0 THEN DELETE
      WHEN MATCHED AND target.n_nationkey % 3 = 1 THEN UPDATE SET n_name = src.n_name
      WHEN NOT MATCHED AND src.n_nationkey < 104 THEN INSERT (n_nationkey, n_name) VALUES (src.n_nationkey, src.n_name)""")
    return lake.sql("SELECT n_nationkey, n_name FROM nation")


# Definitions.


@outcome(_steps("DROP TABLE", 'error: table "region" is not a lake table', "DROP TABLE"))
def ddl_drop_table(spark, sf_dir):
    return _said(_with(spark, sf_dir, "region"), "DROP TABLE region", "DROP TABLE region", "DROP TABLE IF EXISTS region")


@outcome("SELECT r_regionkey, r_name FROM region")
def ddl_rename_table(spark, sf_dir):
    lake = _with(spark, sf_dir, "region")
    lake.sql("ALTER TABLE region RENAME TO continent")
    return lake.sql("SELECT r_regionkey, r_name FROM continent")


@outcome("SELECT * FROM (VALUES (1, 'old'), (2, 'new'), (3, NULL)) t(a, b)")
def ddl_set_default(spark, sf_dir):
    lake = new_lake(spark)
    lake.sql("CREATE TABLE t (a int, b string DEFAULT 'old')")
    lake.sql("INSERT INTO t (a) VALUES (1)")
    lake.sql("ALTER TABLE t ALTER COLUMN b SET DEFAULT 'new'")
    lake.sql("INSERT INTO t (a) VALUES (2)")
    lake.sql("ALTER TABLE t ALTER COLUMN b DROP DEFAULT")
    lake.sql("INSERT INTO t (a) VALUES (3)")
    return lake.table("t")


@outcome(_steps("error: temporary lake tables are not supported", 'error: table "heap_region" is not a lake table'))
def ddl_errors(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("heap_region")
    return _said(new_lake(spark), "CREATE TEMP TABLE t (a int)", "DROP TABLE heap_region")


@outcome("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'from elsewhere'")
def ddl_other_client(spark, sf_dir):
    """A second session's commits, and a lake that was closed, are seen as they are."""
    lake = _with(spark, sf_dir, "nation")
    other = Lake.open(spark, os.path.dirname(lake.path), lake.data_path)
    other.sql("INSERT INTO nation VALUES (100, 'from elsewhere', 0)")
    other.close()
    seen = lake.sql("SELECT count(*) FROM nation").first()[0]
    lake.close()
    again = Lake.open(spark, os.path.dirname(lake.path), lake.data_path)
    assert again.sql("SELECT count(*) FROM nation").first()[0] == seen
    return again.sql("SELECT n_nationkey, n_name FROM nation")


@outcome("SELECT n_name AS \"Name of it\", n_regionkey AS \"select\" FROM nation")
def sql_quoted_identifiers(spark, sf_dir):
    lake = _with(spark, sf_dir, "nation")
    return lake.sql('SELECT n_name AS "Name of it", n_regionkey AS "select" FROM "nation"')


# Queries.


@outcome("SELECT n_name, x FROM (SELECT 1 AS x UNION ALL SELECT 2) y, nation")
def sql_subquery_then_table(spark, sf_dir):
    return _with(spark, sf_dir, "nation").sql("SELECT n_name, x FROM (SELECT 1 AS x UNION ALL SELECT 2) y, nation")


@outcome("SELECT a, row_number() OVER (ORDER BY a NULLS LAST) AS place FROM (VALUES (2), (NULL), (1)) t(a)")
def sql_order_nulls(spark, sf_dir):
    """Nulls come last where an order doesn't say."""
    lake = new_lake(spark)
    lake.sql("CREATE TABLE t (a int)")
    lake.sql("INSERT INTO t VALUES (2), (NULL), (1)")
    rows = lake.sql("SELECT a FROM t ORDER BY a").collect()
    return spark.createDataFrame([(r.a, i + 1) for i, r in enumerate(rows)], "a int, place long")


@outcome("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def sql_qualify(spark, sf_dir):
    return _with(spark, sf_dir, "orders").sql("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")


@outcome("SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name")
def sql_distinct_on(spark, sf_dir):
    return _with(spark, sf_dir, "nation").sql("SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name")


@outcome("""WITH c AS (SELECT user_id, ts, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT e.event_id, c.click FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def sql_asof_join(spark, sf_dir):
    lake = _with(spark, sf_dir, "events")
    return lake.sql("""WITH c AS (SELECT user_id, ts, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY 1, 2)
      SELECT e.event_id, c.click FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")


@outcome("SELECT count(*) AS n FROM supplier")
def sql_tablesample(spark, sf_dir):
    return _with(spark, sf_dir, "supplier").sql("SELECT count(*) AS n FROM supplier TABLESAMPLE (100 PERCENT) s WHERE s.s_suppkey IS NOT NULL")


@outcome("SELECT n_name AS a, upper(n_name) AS b FROM nation")
def sql_convert_from(spark, sf_dir):
    return _with(spark, sf_dir, "nation").sql("SELECT convert_from(CAST(n_name AS BINARY), 'UTF-8') AS a, upper(convert_from(encode(n_name, 'UTF-8'), 'UTF-8')) AS b FROM nation")


@outcome("SELECT true AS today, INTERVAL 1 DAY + DATE '2024-02-28' AS next_day, 129600 AS seconds")
def sql_now_intervals(spark, sf_dir):
    return new_lake(spark).sql("SELECT now() > TIMESTAMP '2020-01-01 00:00:00' AS today, CAST(DATE '2024-02-28' + INTERVAL 1 DAY AS timestamp_ntz) AS next_day, CAST(unix_timestamp(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 36 HOURS) - unix_timestamp(TIMESTAMP '2024-01-01 00:00:00') AS INT) AS seconds")


@outcome("SELECT n_name, length(n_name) * 2 AS twice FROM nation")
def sql_udf(spark, sf_dir):
    """Functions that a user registers with Spark serve in the lake's SQL."""
    from pyspark.sql.functions import pandas_udf

    spark.udf.register("twice_as_long", pandas_udf(lambda words: words.str.len() * 2, "long"))
    return _with(spark, sf_dir, "nation").sql("SELECT n_name, twice_as_long(n_name) AS twice FROM nation")


# Functions of the lake.


@outcome("SELECT * FROM (VALUES (0::BIGINT, 'created_schema:\"public\"', NULL), (1, 'created_table:\"t\"', NULL), (2, 'inserted_into_table:\"t\"', 'first rows')) t(id, changes, message)")
def meta_snapshots(spark, sf_dir):
    lake = new_lake(spark)
    lake.sql("CREATE TABLE t (a int)")
    lake.sql("CALL set_commit_message('first rows')")
    lake.sql("INSERT INTO t VALUES (1)")
    return lake.sql("SELECT snapshot_id AS id, changes, commit_message AS message FROM snapshots()")


@outcome("SELECT 2::BIGINT AS here, 2::BIGINT AS last")
def meta_current_snapshot(spark, sf_dir):
    lake = new_lake(spark)
    lake.sql("CREATE TABLE t (a int)")
    lake.sql("INSERT INTO t VALUES (1)")
    return lake.sql("SELECT c.id AS here, l.id AS last FROM current_snapshot() c, last_committed_snapshot() l")


@outcome("SELECT 'public' AS schema_name, 'nation' AS table_name, 1::BIGINT AS delete_files, count(*) AS deleted FROM nation WHERE n_nationkey < 5")
def meta_table_info(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("nation", table(spark, sf_dir, "nation").coalesce(1))
    lake.sql("DELETE FROM nation WHERE n_nationkey < 5")
    return lake.sql("SELECT schema_name, table_name, delete_file_count AS delete_files, deleted_rows AS deleted FROM table_info()")


@outcome("SELECT * FROM (VALUES ('global', '7', NULL), ('table', '9', 'public.t')) t(scope, value, entry)")
def meta_options(spark, sf_dir):
    lake = new_lake(spark)
    lake.sql("CREATE TABLE t (a int)")
    lake.sql("CALL set_option('data_inlining_row_limit', 7)")
    lake.sql("CALL set_option('data_inlining_row_limit', 9, 't')")
    return lake.sql("SELECT scope, value, scope_entry AS entry FROM options() WHERE option_name = 'data_inlining_row_limit'")


@outcome(_steps('error: Unsupported option "colour"', "error: rewrite_delete_threshold must lie between 0 and 1", "CALL"))
def meta_set_option_errors(spark, sf_dir):
    return _said(new_lake(spark), "CALL set_option('colour', 'red')", "CALL set_option('rewrite_delete_threshold', 3)", "CALL set_option('parquet_compression', 'zstd')")


@outcome("SELECT 1::BIGINT AS files, count(*) AS n FROM region")
def meta_schema_table_names(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("region", table(spark, sf_dir, "region").coalesce(1))
    files = lake.sql("SELECT * FROM list_files('public', 'region')").count()
    lake.set_sort("public.region", "r_name")
    assert lake.sql("SELECT * FROM get_sort('public.region')").count() == 1
    return lake.sql("SELECT count(*) AS n FROM public.region").select(F.lit(files).cast("long").alias("files"), "n")


# Layout.


@outcome("SELECT DISTINCT CAST(day(ts) AS VARCHAR) AS d, CAST(hour(ts) AS VARCHAR) AS h FROM events")
def layout_day_hour(spark, sf_dir):
    lake = new_lake(spark)
    events = table(spark, sf_dir, "events")
    lake.create_table("events", events.schema)
    lake.set_partition("events", "day(ts)", "hour(ts)")
    lake.insert("events", events)
    values = lake.metadata_table("file_partition_value")
    one = lambda i, name: values.where(F.col("partition_key_index") == i).select("data_file_id", F.col("partition_value").alias(name))
    return one(0, "d").join(one(1, "h"), "data_file_id").select("d", "h").distinct()


@outcome("SELECT * FROM (VALUES ('before', false), ('keyed', true), ('after', false)) t(step, keyed)")
def layout_reset_partition(spark, sf_dir):
    """Keys hold for files written while they are set."""
    lake = new_lake(spark)
    region = table(spark, sf_dir, "region").coalesce(1)
    lake.create_table("region", region.schema)
    out = []
    for step in ("before", "keyed", "after"):
        if step == "keyed":
            lake.set_partition("region", "r_name")
        if step == "after":
            lake.reset_partition("region")
        at = lake.current_snapshot()
        lake.insert("region", region)
        new = lake.cat.rows("SELECT partition_id FROM data_file WHERE begin_snapshot > ?", at)
        out.append((step, all(f["partition_id"] is not None for f in new)))
    return spark.createDataFrame(out, "step string, keyed boolean")


@outcome("SELECT * FROM (VALUES ('set', 2::BIGINT), ('reset', 0::BIGINT), ('column dropped', 0::BIGINT)) t(step, keys)")
def layout_reset_sort(spark, sf_dir):
    lake = _with(spark, sf_dir, "nation")
    out = []
    lake.set_sort("nation", "n_name", "n_nationkey DESC")
    out.append(("set", lake.get_sort("nation").count()))
    lake.reset_sort("nation")
    out.append(("reset", lake.get_sort("nation").count()))
    lake.set_sort("nation", "n_name")
    lake.sql("ALTER TABLE nation DROP COLUMN n_name")
    out.append(("column dropped", lake.get_sort("nation").count()))
    return spark.createDataFrame(out, "step string, keys long")


@outcome(_steps("error: sorted indexes do not support UNIQUE", "error: sorted indexes do not support CONCURRENTLY", "error: sorted indexes do not support WHERE", "CREATE INDEX", "DROP INDEX", 'error: index "by_name" does not exist', "DROP INDEX"))
def layout_indexes(spark, sf_dir):
    using = "ON region USING strata_sorted (r_name)"
    return _said(_with(spark, sf_dir, "region"), f"CREATE UNIQUE INDEX i {using}", f"CREATE INDEX CONCURRENTLY i {using}", f"CREATE INDEX i {using} WHERE r_name > 'B'", f"CREATE INDEX by_name {using}", "DROP INDEX by_name", "DROP INDEX by_name", "DROP INDEX IF EXISTS by_name")


# Maintenance.


@outcome("SELECT * FROM (VALUES ('expired', 3::BIGINT), ('files gone', 1::BIGINT), ('rows left', (SELECT count(*) FROM region))) t(what, n)")
def keep_expire_and_cleanup(spark, sf_dir):
    lake = new_lake(spark)
    region = table(spark, sf_dir, "region").coalesce(1)
    lake.create_table_as("region", region)
    lake.sql("DELETE FROM region")
    lake.insert("region", region)
    gone = lake.expire_snapshots(older_than=dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=1))
    files = lake.sql("SELECT * FROM cleanup_old_files()").count()
    return spark.createDataFrame([("expired", len(gone)), ("files gone", files), ("rows left", lake.table("region").count())], "what string, n long")


# Transactions.


@outcome("SELECT who, more + (SELECT count(*) FROM region) AS n FROM (VALUES ('own', 1), ('other, before', 0), ('other, after', 1)) t(who, more)")
def tx_isolation(spark, sf_dir):
    lake = _with(spark, sf_dir, "region")
    other = Lake.open(spark, os.path.dirname(lake.path), lake.data_path)
    count = lambda x: x.sql("SELECT count(*) FROM region").first()[0]
    lake.begin()
    lake.sql("INSERT INTO region VALUES (100, 'MU')")
    out = [("own", count(lake)), ("other, before", count(other))]
    lake.commit()
    out.append(("other, after", count(other)))
    return spark.createDataFrame(out, "who string, n long")


@outcome("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (100, 'MU'), (101, 'LEMURIA')")
def tx_appends_replay(spark, sf_dir):
    """Two transactions that only append both commit, the later one on top of the other."""
    lake = _with(spark, sf_dir, "region")
    other = Lake.open(spark, os.path.dirname(lake.path), lake.data_path)
    lake.begin()
    other.begin()
    lake.sql("INSERT INTO region VALUES (100, 'MU')")
    other.sql("INSERT INTO region VALUES (101, 'LEMURIA')")
    lake.commit()
    other.commit()
    return lake.sql("SELECT r_regionkey, r_name FROM region")


@outcome("SELECT 'conflict' AS second, count(*) - 1 AS n FROM region")
def tx_same_rows_conflict(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("region", table(spark, sf_dir, "region").coalesce(1))
    other = Lake.open(spark, os.path.dirname(lake.path), lake.data_path)
    lake.begin()
    other.begin()
    lake.sql("DELETE FROM region WHERE r_regionkey = 0")
    other.sql("DELETE FROM region WHERE r_regionkey = 0")
    lake.commit()
    try:
        other.commit()
        second = "committed"
    except Conflict:
        second = "conflict"
    return lake.sql("SELECT count(*) AS n FROM region").select(F.lit(second).alias("second"), "n")


@outcome("SELECT 'region' AS t, count(*) AS n, count(DISTINCT r_regionkey) AS d FROM region UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation")
def tx_cross_table_writes(spark, sf_dir):
    """Two sessions at once, each deleting and writing again the rows of a table of its own."""
    lake = _with(spark, sf_dir, "region", "nation")

    def rewrite(name: str, key: str) -> None:
        own = Lake.open(spark, os.path.dirname(lake.path), lake.data_path)
        with own.transaction():
            own.sql(f"DELETE FROM {name} WHERE {key} >= 0")
            own.insert(name, table(spark, sf_dir, name))
        own.close()

    at_once = [threading.Thread(target=rewrite, args=x) for x in (("region", "r_regionkey"), ("nation", "n_nationkey"))]
    for x in at_once:
        x.start()
    for x in at_once:
        x.join()
    return lake.sql("SELECT 'region' AS t, count(*) AS n, count(DISTINCT r_regionkey) AS d FROM region UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation")


@outcome(_steps("COMMIT", "BEGIN", "COMMIT", "ROLLBACK"))
def tx_harmless_commit(spark, sf_dir):
    return _said(new_lake(spark), "COMMIT", "BEGIN", "COMMIT", "ROLLBACK")


# Settings.


@outcome("SELECT true AS there, count(*) AS n FROM region")
def set_default_table_path(spark, sf_dir):
    lake = new_lake(spark)
    place = scratch(spark)
    lake.set("default_table_path", place)
    lake.create_table_as("region", table(spark, sf_dir, "region"))
    there = lake.list_files("region").where(~F.col("data_file").startswith(place)).isEmpty()
    return lake.sql("SELECT count(*) AS n FROM region").select(F.lit(there).alias("there"), "n")


@outcome("SELECT * FROM (VALUES ('strict', 0::BIGINT), ('lax', 1::BIGINT)) t(threshold, delete_files)")
def set_vacuum_delete_threshold(spark, sf_dir):
    out = []
    for name, value in (("strict", 0.01), ("lax", 0.9)):
        lake = new_lake(spark)
        lake.create_table_as("nation", table(spark, sf_dir, "nation").coalesce(1))
        lake.sql("DELETE FROM nation WHERE n_nationkey = 3")
        lake.sql(f"SET lake.vacuum_delete_threshold = {value}")
        lake.sql("VACUUM nation")
        out.append((name, lake.list_files("nation").agg(F.sum("delete_files")).first()[0]))
    return spark.createDataFrame(out, "threshold string, delete_files long")


@outcome(_steps("error: 2.0 is outside the valid range for vacuum_delete_threshold (0 .. 1)", "error: unknown setting colour", "SET", "RESET"))
def set_validation(spark, sf_dir):
    return _said(new_lake(spark), "SET lake.vacuum_delete_threshold = 2.0", "SET lake.colour = 'red'", "SET lake.enable_direct_insert = off", "RESET lake.enable_direct_insert")


@outcome("SELECT 0::BIGINT AS n, 2::BIGINT AS columns")
def set_ctas_skip_data(spark, sf_dir):
    lake = new_lake(spark)
    lake.set("ctas_skip_data", True)
    lake.create_table_as("region", table(spark, sf_dir, "region"))
    return lake.sql("SELECT count(*) AS n FROM region").withColumn("columns", F.lit(len(lake.table("region").columns)).cast("long"))


@outcome("SELECT 'ZSTD' AS codec, true AS several_groups")
def set_parquet_options(spark, sf_dir):
    import pyarrow.parquet as pq

    from ..sources.scan import filesystem, located

    lake = new_lake(spark)
    for key, value in (("parquet_compression", "zstd"), ("parquet_compression_level", 5), ("parquet_version", 2), ("parquet_row_group_size", 100)):
        lake.set_option(key, value)
    lake.create_table_as("t", spark.range(0, 50_000, 1, 1).selectExpr("id", "CAST(id AS STRING) AS s"))
    files, name = filesystem(located(lake.data_path, lake.list_files("t").first().data_file))
    with files.open_input_file(name) as file:
        meta = pq.ParquetFile(file).metadata
    return _one(spark, "codec string, several_groups boolean", meta.row_group(0).column(0).compression, meta.num_row_groups > 1)


@outcome("SELECT true AS split, 20000::BIGINT AS n")
def set_target_file_size(spark, sf_dir):
    """A partition value with many rows is written in files of about the target size."""
    lake = new_lake(spark)
    lake.sql("CREATE TABLE t (k int, s string)")
    lake.set_partition("t", "k")
    lake.set_option("target_file_size", 100_000, "t")
    lake.insert("t", spark.range(0, 20_000, 1, 4).selectExpr("1 AS k", "sha2(CAST(id AS STRING), 256) AS s"))
    return lake.sql("SELECT count(*) AS n FROM t").select(F.lit(lake.list_files("t").count() > 3).alias("split"), "n")


# Streams.


@outcome("SELECT * FROM (VALUES (TIMESTAMP '2024-01-01 00:00:00', 2::BIGINT), (TIMESTAMP '2024-01-01 01:00:00', 1), (TIMESTAMP '2024-01-01 03:00:00', 2)) t(start, n)")
def stream_late_data(spark, sf_dir):
    """A row later than the watermark allows isn't counted; one that is late within it is."""
    from pyspark.sql import types as T

    folder, place = os.path.join(scratch(spark), "in"), scratch(spark)
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("v", T.IntegerType())])
    batches = [["00:10", "01:30"], ["00:50", "03:30"], ["00:20", "03:10"], ["09:00"]]
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    name = f"late_{os.urandom(4).hex()}"
    for i, times in enumerate(batches):
        rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, int(t[:2]), int(t[3:])), i) for t in times], schema)
        rows.coalesce(1).write.mode("append").parquet(folder)
        counts = streams.tumbling(read.parquet(folder), "ts", "1 hour", [], F.count(F.lit(1)).alias("n"), late="1 hour")
        run = counts.select(F.col("window.start").alias("start"), "n").writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(os.path.join(place, name))).option("checkpointLocation", os.path.join(place, "check")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    found = spark.read.schema("start timestamp, n long").parquet(os.path.join(place, name))
    return found.where("start < TIMESTAMP '2024-01-01 08:00:00'").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
