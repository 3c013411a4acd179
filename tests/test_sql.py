"""The lake's SQL beyond Spark's, and the shape of its plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.operators.joins import asof_join
from strata.plans.dialect import rewritten
from strata.sources.catalog import LakeError


def values(df):
    return [tuple(r) for r in df.collect()]


def files_read(df):
    return len(df.inputFiles())


@pytest.fixture()
def harbour(lake, spark):
    """A table of five files by key, with nulls."""
    lake.sql("CREATE TABLE ships (k int, name string, tons double, seen date, at timestamp_ntz)")
    lake.set_partition("ships", "k")
    rows = [(i % 5, f"ship {i}", float(i), dt.date(2020, 1, 1 + i), dt.datetime(2020, 1, 1 + i, 12)) for i in range(20)]
    lake.insert("ships", spark.createDataFrame(rows, "k int, name string, tons double, seen date, at timestamp_ntz"))
    return lake


@pytest.mark.parametrize(
    ("where", "files", "rows"),
    [
        ("k = 3", 1, 4),
        ("3 = k AND tons > 0", 1, 4),
        ("k IN (1, 2)", 2, 8),
        ("k > 3 OR k < 0", 5, 4),
        ("k >= 4", 1, 4),
        ("tons < 1", 1, 1),
        ("name = 'ship 7'", 5, 1),
        ("seen = DATE '2020-01-01'", 1, 1),
        ("at < TIMESTAMP_NTZ '2020-01-02 00:00:00'", 1, 1),
        ("k + 1 = 4", 5, 4),
    ],
)
def test_sql_reads_only_the_files_that_its_filters_need(harbour, where, files, rows):
    found = harbour.sql(f"SELECT * FROM ships WHERE {where}")
    assert found.count() == rows and files_read(found) <= files
    if files == 1 and where == "k = 3":
        assert files_read(harbour.table("ships", filters=[("k", "=", 3)])) == files_read(found)


def test_files_of_one_name_in_several_folders(spark, tmp_path):
    """A task that writes several partition values gives their files one name."""
    from strata.lake import Lake

    lake = Lake.open(spark, str(tmp_path / "a lake, 100% blue"))
    lake.sql("CREATE TABLE t (k int, v int)")
    lake.set_partition("t", "k")
    lake.insert("t", spark.range(12).coalesce(1).selectExpr("CAST(id % 3 AS INT) AS k", "CAST(id AS INT) AS v"))
    lake.sql("DELETE FROM t WHERE v = 4")
    assert sorted(r.v for r in lake.table("t").collect()) == [i for i in range(12) if i != 4]
    lake.sql("UPDATE t SET v = v + 100 WHERE v > 8")
    assert sorted(r.v for r in lake.table("t").collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 109, 110, 111]
    lake.close()


def test_pruning_looks_at_every_use_of_a_table(harbour):
    both = harbour.sql("SELECT a.name, b.name AS other FROM ships a JOIN ships b ON a.tons = b.tons + 1 WHERE a.k = 1 AND b.k = 0")
    assert both.count() == 4 and files_read(both) == 2
    nested = harbour.sql("SELECT name FROM ships WHERE k = 2 AND tons > (SELECT avg(tons) FROM ships)")
    assert sorted(values(nested)) == [("ship 12",), ("ship 17",)]
    cte = harbour.sql("WITH ships2 AS (SELECT * FROM ships WHERE k = 4) SELECT count(*) FROM ships2")
    assert values(cte) == [(4,)] and files_read(cte) == 1
    harbour.sql("DELETE FROM ships WHERE tons = 4")
    after = harbour.sql("SELECT count(*) FROM ships WHERE k = 4")
    assert values(after) == [(3,)]


def test_changes_read_only_the_files_that_they_need(harbour, monkeypatch):
    from strata import lake as module

    seen = []
    plain = module.scan
    monkeypatch.setattr(module, "scan", lambda *a, **how: seen.append(how.get("alternatives")) or plain(*a, **how))
    assert values(harbour.sql("UPDATE ships SET name = 'x' WHERE k = 1 AND tons > 3")) == [("UPDATE 3",)]
    assert seen[-1] and ("k", "=", 1) in seen[-1][0]
    assert values(harbour.sql("DELETE FROM ships s WHERE s.k = 2")) == [("DELETE 4",)]
    assert seen[-1] and ("k", "=", 2) in seen[-1][0]
    assert values(harbour.sql("SELECT count(*), count_if(name = 'x') FROM ships")) == [(16, 3)]


def test_nulls_come_last(lake):
    lake.sql("CREATE TABLE depth (a int, b int)")
    lake.sql("INSERT INTO depth VALUES (2, 1), (NULL, 2), (1, 3)")
    assert [r[0] for r in values(lake.sql("SELECT a FROM depth ORDER BY a"))] == [1, 2, None]
    assert [r[0] for r in values(lake.sql("SELECT a FROM depth ORDER BY a DESC"))] == [2, 1, None]
    assert [r[0] for r in values(lake.sql("SELECT a FROM depth ORDER BY a NULLS FIRST"))] == [None, 1, 2]
    assert values(lake.sql("SELECT b, row_number() OVER (ORDER BY a) AS n FROM depth ORDER BY b")) == [(1, 2), (2, 3), (3, 1)]
    assert values(lake.sql("SELECT '😀' AS x, a FROM depth ORDER BY a LIMIT 1")) == [("😀", 1)]


def test_qualify_and_distinct_on(harbour):
    top = "SELECT k, name FROM ships QUALIFY row_number() OVER (PARTITION BY k ORDER BY tons DESC) = 1 ORDER BY k"
    assert values(harbour.sql(top)) == [(i, f"ship {15 + i}") for i in range(5)]
    named = "SELECT k, name, rank() OVER (PARTITION BY k ORDER BY tons) AS r FROM ships WHERE k < 2 QUALIFY r = 2"
    assert sorted(values(harbour.sql(named))) == [(0, "ship 5", 2), (1, "ship 6", 2)]
    inside = "SELECT count(*) FROM (SELECT k FROM ships QUALIFY row_number() OVER (PARTITION BY k ORDER BY tons) <= 2) t"
    assert values(harbour.sql(inside)) == [(10,)]
    first = "SELECT DISTINCT ON (k) k, name FROM ships ORDER BY k"
    assert [r[0] for r in values(harbour.sql(first))] == [0, 1, 2, 3, 4]
    assert rewritten("SELECT a FROM t") == "SELECT a FROM t"


def test_asof_join_in_sql(lake):
    lake.sql("CREATE TABLE quotes (sym string, t int, price int)")
    lake.sql("CREATE TABLE trades (sym string, t int, n int)")
    lake.sql("INSERT INTO quotes VALUES ('a', 1, 10), ('a', 5, 50), ('b', 3, 30), ('a', NULL, 99)")
    lake.sql("INSERT INTO trades VALUES ('a', 0, 1), ('a', 1, 2), ('a', 7, 3), ('b', 9, 4), ('c', 9, 5), ('a', NULL, 6)")
    text = "SELECT x.n, q.price FROM trades x ASOF {}JOIN quotes q ON x.sym = q.sym AND x.t {} q.t ORDER BY x.n"
    assert values(lake.sql(text.format("LEFT ", ">="))) == [(1, None), (2, 10), (3, 50), (4, 30), (5, None), (6, None)]
    assert values(lake.sql(text.format("", ">="))) == [(2, 10), (3, 50), (4, 30)]
    assert values(lake.sql(text.format("LEFT ", ">"))) == [(1, None), (2, None), (3, 50), (4, 30), (5, None), (6, None)]
    assert values(lake.sql(text.format("", "<="))) == [(1, 10), (2, 10)]


def test_asof_join_by_slices_is_the_whole_join(spark):
    left = spark.createDataFrame([("a", i, i) for i in (1, 15, 25, 99)] + [("b", 50, 5), ("a", None, 7)], "k string, t int, n int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 22, "y"), ("a", 24, "z"), ("c", 1, "w"), ("a", None, "v")], "k string, rt int, what string")
    plain = asof_join(left, right, ["k"], "t", "rt", ["what"])
    sliced = asof_join(left, right, ["k"], "t", "rt", ["what"], slices=F.floor(F.col("_t") / 10))
    want = [("a", 1, None), ("a", 7, None), ("a", 15, "x"), ("a", 25, "z"), ("a", 99, "z"), ("b", 5, None)]
    assert sorted(values(plain.select("k", "n", "what"))) == want
    assert sorted(values(sliced.select("k", "n", "what"))) == want


def test_lists_of_tables_and_samples(harbour):
    text = "SELECT count(*) FROM (SELECT 1 AS one UNION ALL SELECT 2) x, ships"
    assert values(harbour.sql(text)) == [(40,)]
    assert values(harbour.sql("SELECT count(*) FROM ships, (SELECT 1) y, ships z WHERE ships.k = z.k")) == [(80,)]
    assert values(harbour.sql("SELECT count(*) FROM ships TABLESAMPLE (100 PERCENT) WHERE ships.k = 1")) == [(4,)]
    assert values(harbour.sql("SELECT count(*) FROM ships TABLESAMPLE (100 PERCENT) s WHERE s.k = 1")) == [(4,)]
    assert values(harbour.sql("SELECT convert_from(CAST('abc' AS BINARY), 'UTF-8') AS x")) == [("abc",)]


def test_update_from_and_delete_using(harbour):
    harbour.sql("CREATE TABLE names (k int, title string)")
    harbour.sql("INSERT INTO names VALUES (1, 'one'), (3, 'three')")
    assert values(harbour.sql("UPDATE ships s SET name = n.title FROM names n WHERE s.k = n.k AND s.tons < 4")) == [("UPDATE 2",)]
    assert sorted(values(harbour.sql("SELECT name FROM ships WHERE tons < 4"))) == [("one",), ("ship 0",), ("ship 2",), ("three",)]
    assert values(harbour.sql("DELETE FROM ships USING names WHERE ships.k = names.k")) == [("DELETE 8",)]
    assert values(harbour.sql("DELETE FROM ships WHERE k IN (SELECT k + 1 FROM names)")) == [("DELETE 8",)]
    assert values(harbour.sql("SELECT count(*) FROM ships")) == [(4,)]


def test_merge_with_any_names_and_conditions(lake):
    lake.sql("CREATE TABLE stock (id int, n int)")
    lake.sql("INSERT INTO stock VALUES (1, 10), (2, 20), (3, 30)")
    lake.sql("CREATE TABLE news (id int, n int)")
    lake.sql("INSERT INTO news VALUES (1, 0), (2, 5), (3, 7), (4, 40), (5, -1)")
    text = """MERGE INTO stock AS tgt USING (SELECT * FROM news) AS so ON tgt.id = so.id
      WHEN MATCHED AND so.n = 0 THEN DELETE
      WHEN MATCHED AND so.id = 2 THEN UPDATE SET n = tgt.n + so.n
      WHEN NOT MATCHED AND so.n > 0 THEN INSERT (id, n) VALUES (so.id, so.n)"""
    assert values(lake.sql(text)) == [("MERGE 3",)]
    assert values(lake.sql("SELECT id, n FROM stock ORDER BY id")) == [(2, 25), (3, 30), (4, 40)]
    lake.sql("INSERT INTO news VALUES (2, 6)")
    with pytest.raises(LakeError):
        lake.sql("MERGE INTO stock USING news ON stock.id = news.id WHEN MATCHED THEN UPDATE SET n = news.n")
    assert values(lake.sql("MERGE INTO stock USING news ON stock.id = news.id WHEN MATCHED THEN DELETE")) == [("MERGE 3",)]


def test_a_random_condition_is_settled_once(lake):
    lake.create_table_as("dice", lake.spark.range(200).selectExpr("id", "0 AS hit"))
    said = values(lake.sql("UPDATE dice SET hit = 1 WHERE rand() < 0.5"))[0][0]
    assert values(lake.sql("SELECT count(*), count(DISTINCT id), sum(hit) FROM dice")) == [(200, 200, int(said.split()[1]))]


def test_index_names_outlive_the_session(lake, spark, tmp_path):
    from strata.lake import Lake

    lake.sql("CREATE TABLE logs (a int)")
    lake.sql("CREATE INDEX by_a ON logs USING strata_sorted (a)")
    again = Lake.open(spark, str(tmp_path / "lake"))
    again.sql("DROP INDEX by_a")
    assert again.get_sort("logs").count() == 0
    with pytest.raises(LakeError):
        again.sql("DROP INDEX by_a")
    again.close()


def branches(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_plans_do_not_grow_with_batches_or_ended_files(lake, spark):
    lake.sql("CREATE TABLE drops (a int)")
    lake.set_option("data_inlining_row_limit", 10)
    first = lake.current_snapshot()
    for i in range(6):
        lake.insert_arrays("drops", {"a": [i]})
    few = lake.table("drops")
    assert few.count() == 6 and few._jdf.queryExecution().optimizedPlan().toString().count("\n") <= 4
    assert lake.table_insertions("drops", first, lake.current_snapshot()).count() == 6
    lake.sql("DELETE FROM drops WHERE a > 3")
    assert sorted(r.a for r in lake.table_deletions("drops", first, lake.current_snapshot()).collect()) == [4, 5]
    lake.set_option("data_inlining_row_limit", 0)
    lake.sql("CREATE TABLE boxes (k int, v int)")
    lake.set_partition("boxes", "k")
    lake.insert("boxes", spark.range(40).selectExpr("CAST(id % 10 AS INT) AS k", "CAST(id AS INT) AS v"))
    start = lake.current_snapshot()
    lake.sql("DELETE FROM boxes WHERE v = 5")
    lake.sql("DELETE FROM boxes WHERE k < 8")
    gone = lake.table_deletions("boxes", start + 1, lake.current_snapshot())
    assert sorted(r.v for r in gone.collect()) == sorted(v for v in range(40) if v % 10 < 8)
    assert gone._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 5


def test_one_partition_value_is_written_by_several_tasks(lake, spark):
    lake.sql("CREATE TABLE wide (k int, text string)")
    lake.set_partition("wide", "k")
    lake.set_option("target_file_size", 100_000, "wide")
    rows = spark.range(0, 20_000, 1, 4).selectExpr("CAST(1 AS INT) AS k", "sha2(CAST(id AS STRING), 256) AS text")
    lake.insert("wide", rows)
    assert lake.list_files("wide").count() > 3
    assert values(lake.sql("SELECT count(*), count(DISTINCT text) FROM wide WHERE k = 1")) == [(20_000, 20_000)]


def test_footers_by_tasks_are_those_of_the_driver(lake, spark, monkeypatch):
    from strata.operators import write

    monkeypatch.setattr(write, "DRIVER_FOOTERS", 1)
    lake.create_table_as("many", spark.range(0, 30, 1, 5).selectExpr("id", "CAST(id AS STRING) AS s", "CAST(NULL AS INT) AS n"))
    found = lake.sql("SELECT * FROM many WHERE id = 29")
    assert found.count() == 1 and files_read(found) == 1


def test_defaults_in_values_and_assignments(lake):
    lake.sql("CREATE TABLE crew (id int, name text DEFAULT 'none, yet', rank int)")
    assert values(lake.sql("INSERT INTO crew VALUES (1, DEFAULT, 5), (2, 'DEFAULT', DEFAULT)")) == [("INSERT 0 2",)]
    lake.sql("INSERT INTO crew DEFAULT VALUES")
    lake.sql("INSERT INTO crew (rank, id) VALUES (DEFAULT, 3)")
    lake.sql("INSERT INTO crew (id, name) (SELECT id + 10, name FROM crew WHERE id = 1)")
    everyone = [(1, "none, yet", 5), (2, "DEFAULT", None), (3, "none, yet", None), (11, "none, yet", None), (None, "none, yet", None)]
    assert values(lake.sql("SELECT * FROM crew ORDER BY id")) == everyone
    lake.sql("UPDATE crew SET (name, rank) = ('first, (second)', id + 1) WHERE id = 3")
    lake.sql("UPDATE crew SET name = DEFAULT, rank = DEFAULT WHERE id IN (1, 2)")
    assert values(lake.sql("SELECT name, rank FROM crew WHERE id < 4 ORDER BY id")) == [("none, yet", None), ("none, yet", None), ("first, (second)", 4)]


def test_statements_on_several_tables_or_columns(lake):
    lake.sql("CREATE TABLE a (x int)")
    lake.sql("INSERT INTO a VALUES (1), (2)")
    assert values(lake.sql("CREATE TABLE IF NOT EXISTS a AS SELECT 7 AS x")) == [("CREATE TABLE AS",)]
    before = lake.current_snapshot()
    lake.sql("ALTER TABLE a ADD COLUMN y decimal(10, 2) DEFAULT 5, ADD COLUMN z text")
    assert lake.current_snapshot() == before + 1
    lake.sql("ALTER TABLE a ADD COLUMN IF NOT EXISTS y int")
    lake.sql("ALTER TABLE a DROP COLUMN IF EXISTS w, DROP COLUMN IF EXISTS z")
    lake.sql("ALTER TABLE IF EXISTS missing ADD COLUMN y int")
    assert [(c, k) for c, k in lake.table("a").dtypes] == [("x", "int"), ("y", "decimal(10,2)")]
    assert values(lake.sql("SELECT x, y::float8 FROM a ORDER BY x")) == [(1, 5.0), (2, 5.0)]
    with pytest.raises(LakeError):
        lake.sql("ALTER TABLE a ADD COLUMN v int, DROP COLUMN missing")
    assert lake.table("a").columns == ["x", "y"]
    lake.sql("CREATE SCHEMA IF NOT EXISTS port")
    lake.sql("CREATE SCHEMA IF NOT EXISTS port")
    lake.sql("CREATE TABLE port.a (x int)")
    lake.sql("INSERT INTO port.a VALUES (9)")
    assert values(lake.sql("SELECT a.x, b.x FROM a JOIN port.a b ON a.x < b.x ORDER BY a.x")) == [(1, 9), (2, 9)]
    lake.sql("VACUUM")
    assert values(lake.sql("TRUNCATE TABLE a, port.a")) == [("TRUNCATE TABLE",)]
    assert values(lake.sql("SELECT count(*) FROM a")) == values(lake.sql("SELECT count(*) FROM port.a")) == [(0,)]
    with pytest.raises(LakeError):
        lake.sql("DROP TABLE a, missing")
    lake.sql("DROP TABLE a, port.a CASCADE")
    with pytest.raises(LakeError):
        lake.table("a")


def test_types_by_other_names(lake):
    lake.sql("CREATE TABLE n (i int, s text)")
    lake.sql("INSERT INTO n VALUES (1, '::text'), (2, '20')")
    assert values(lake.sql("SELECT i::text || 'k', CAST(s AS varchar), CAST(abs(i) AS int8) AS text FROM n ORDER BY i")) == [("1k", "::text", 1), ("2k", "20", 2)]
    assert values(lake.sql("DELETE FROM n WHERE s::text = i::text || '0'")) == [("DELETE 1",)]
