import datetime as dt

import pytest

from strata.lake import Lake
from strata.sources.catalog import Conflict, LakeError


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tag(lake, text):
    return lake.sql(text).first()[0]


def test_create_insert_filter(lake):
    lake.sql("CREATE TABLE wells (no int, depth int) USING strata")
    assert tag(lake, "INSERT INTO wells VALUES (7, 40), (8, 55), (9, 61)") == "INSERT 0 3"
    assert rows(lake.sql("SELECT * FROM wells ORDER BY depth")) == [(7, 40), (8, 55), (9, 61)]
    assert rows(lake.sql("SELECT no FROM public.wells WHERE depth > 50")) == [(8,), (9,)]


def test_ctas_top_k(lake):
    assert tag(lake, "CREATE TABLE squares USING strata AS SELECT generate_series AS k, generate_series * generate_series AS sq FROM generate_series(1, 700)") == "SELECT 700"
    assert rows(lake.sql("SELECT sq FROM squares ORDER BY k DESC LIMIT 2")) == [(699 * 699,), (700 * 700,)]


def test_row_counts(lake):
    lake.sql("CREATE TABLE berths (quay string, metres double)")
    assert tag(lake, "INSERT INTO berths VALUES ('north', 120.5)") == "INSERT 0 1"
    assert tag(lake, "INSERT INTO berths VALUES ('south', 80), ('south', 95), ('west', 200), ('west', 60)") == "INSERT 0 4"
    assert tag(lake, "UPDATE berths SET metres = metres + 5 WHERE quay <> 'north'") == "UPDATE 4"
    assert tag(lake, "DELETE FROM berths WHERE metres < 90") == "DELETE 2"
    assert tag(lake, "DELETE FROM berths WHERE quay = 'east'") == "DELETE 0"
    assert rows(lake.table("berths")) == [("north", 120.5), ("south", 100.0), ("west", 205.0)]


def test_schema_evolution(lake):
    lake.sql("CREATE TABLE probe (station int, reading string)")
    lake.sql("INSERT INTO probe VALUES (11, 'calm')")
    before = lake.current_snapshot()
    lake.sql("ALTER TABLE probe ADD COLUMN gusts double DEFAULT 0.5")
    lake.sql("ALTER TABLE probe RENAME COLUMN reading TO sky")
    lake.sql("INSERT INTO probe VALUES (12, 'storm', 31.25)")
    lake.sql("ALTER TABLE probe RENAME TO weather")
    lake.sql("ALTER TABLE weather ALTER COLUMN station TYPE bigint")
    lake.sql("INSERT INTO weather VALUES (9000000000, 'fog', NULL)")
    assert lake.table("weather").dtypes == [("station", "bigint"), ("sky", "string"), ("gusts", "double")]
    assert rows(lake.table("weather").where("gusts IS NOT NULL")) == [(11, "calm", 0.5), (12, "storm", 31.25)]
    assert rows(lake.sql(f"SELECT * FROM time_travel('probe', {before})")) == [(11, "calm")]
    assert rows(lake.sql("SELECT station FROM weather WHERE gusts < 1")) == [(11,)]
    lake.sql("ALTER TABLE weather DROP COLUMN gusts")
    assert rows(lake.table("weather")) == [(11, "calm"), (12, "storm"), (9000000000, "fog")]
    with pytest.raises(LakeError):
        lake.sql("ALTER TABLE weather ALTER COLUMN sky TYPE int")
    lake.sql("ALTER TABLE weather ALTER COLUMN sky SET DEFAULT 'unknown'")
    lake.sql("INSERT INTO weather (station) VALUES (13)")
    assert rows(lake.sql("SELECT sky FROM weather WHERE station = 13")) == [("unknown",)]


def test_not_null(lake):
    lake.sql("CREATE TABLE n (a int NOT NULL, p numeric(10,2))")
    with pytest.raises(Exception, match="not-null"):
        lake.sql("INSERT INTO n VALUES (NULL, 1.5)")
    lake.sql("INSERT INTO n VALUES (1, 1.5)")
    assert lake.table("n").count() == 1


def test_time_travel(lake):
    lake.sql("CREATE TABLE t (a int)")
    lake.sql("INSERT INTO t VALUES (1)")
    v = lake.current_snapshot()
    when = dt.datetime.now(dt.timezone.utc)
    lake.sql("INSERT INTO t VALUES (2)")
    lake.sql("DELETE FROM t WHERE a = 1")
    assert rows(lake.table("t", version=v)) == [(1,)]
    assert rows(lake.table("t", timestamp=when)) == [(1,)]
    assert rows(lake.sql(f"SELECT * FROM t VERSION AS OF {v}")) == [(1,)]
    assert rows(lake.sql("SELECT * FROM time_travel('t', now())")) == [(2,)]
    with pytest.raises(LakeError, match="No snapshot found at version 99"):
        lake.sql("SELECT * FROM time_travel('t', 99)")
    with pytest.raises(LakeError, match="cannot be NULL"):
        lake.sql("SELECT * FROM time_travel(NULL, 1)")
    lake.set("as_of_timestamp", when.isoformat())
    assert rows(lake.table("t")) == [(1,)]
    with pytest.raises(LakeError):
        lake.sql("INSERT INTO t VALUES (3)")
    lake.reset("as_of_timestamp")


def test_change_feed(lake):
    lake.sql("CREATE TABLE f (a int, b string)")
    v0 = lake.current_snapshot()
    lake.sql("INSERT INTO f VALUES (1, 'x')")
    lake.sql("INSERT INTO f VALUES (2, 'y')")
    v2 = lake.current_snapshot()
    lake.sql("DELETE FROM f WHERE a = 1")
    v3 = lake.current_snapshot()
    assert lake.table_insertions("f", v0, v2).count() == 2
    assert lake.table_deletions("public.f", v2, v3).count() == 1
    lake.sql("UPDATE f SET b = 'z' WHERE a = 2")
    v4 = lake.current_snapshot()
    found = rows(lake.sql(f"SELECT change_type, a, b FROM table_changes('f', {v4}, {v4})"))
    assert found == [("update_postimage", 2, "z"), ("update_preimage", 2, "y")]
    lake.sql("INSERT INTO f VALUES (5, 'p'), (6, 'q')")
    total = rows(lake.table_changes("f", v0, lake.current_snapshot()))
    lake.vacuum("f")
    assert rows(lake.table_changes("f", v0, lake.current_snapshot())) == total
    assert rows(lake.table("f")) == [(2, "z"), (5, "p"), (6, "q")]


def test_inlining_and_flush(lake):
    lake.sql("CREATE TABLE i (a int, b string)")
    lake.sql("CALL set_option('data_inlining_row_limit', 10)")
    v0 = lake.current_snapshot()
    lake.sql("INSERT INTO i VALUES (1, 'x'), (2, 'y')")
    assert lake.list_files("i").count() == 0
    assert lake.insert_arrays("i", {"a": [3, 4], "b": ["z", None]}) == 2
    lake.sql("INSERT INTO i SELECT id, 'big' FROM range(10, 40)")
    assert lake.list_files("i").count() > 0
    lake.sql("DELETE FROM i WHERE a = 2")
    lake.sql("UPDATE i SET b = 'w' WHERE a = 3")
    before = rows(lake.sql("SELECT * FROM i WHERE a < 10"))
    assert before == [(1, "x"), (3, "w"), (4, None)]
    v1 = lake.current_snapshot()
    feed = rows(lake.table_changes("i", v0, v1).drop("b"))
    assert [tuple(r) for r in lake.sql("SELECT * FROM flush_inlined_data()").collect()] == [("public", "i", 2)]
    assert rows(lake.sql("SELECT * FROM i WHERE a < 10")) == before
    assert rows(lake.table("i", version=v1).where("a < 10")) == before
    assert rows(lake.table_changes("i", v0, lake.current_snapshot()).drop("b")) == feed
    assert lake.table("i").count() == 33
    with pytest.raises(LakeError):
        lake.insert_arrays("i", {"a": [1], "b": []})


def test_partition(lake):
    lake.sql("CREATE TABLE logbook (entry int, ship string, noted timestamp, miles int)")
    lake.sql("INSERT INTO logbook VALUES (0, 'Anna', timestamp_ntz'1999-12-31 23:00:00', 3)")
    lake.sql("CALL set_partition('logbook', 'ship', 'year(noted)')")
    lake.sql("INSERT INTO logbook VALUES (5, 'Anna', timestamp_ntz'2011-03-04 05:00:00', 17), (6, 'Berta', timestamp_ntz'2011-09-08 07:00:00', 29), (7, NULL, timestamp_ntz'2012-01-02 03:00:00', 71)")
    assert rows(lake.get_partition("logbook")) == [(0, "ship", "identity"), (1, "noted", "year")]
    values = rows(lake.metadata_table("file_partition_value").select("partition_key_index", "partition_value").where("partition_value is not null"))
    assert values == [(0, "Anna"), (0, "Berta"), (1, "2011"), (1, "2011"), (1, "2012")]
    assert lake.list_files("logbook").count() == 4
    few = lake.table("logbook", filters=[("ship", "=", "Berta")])
    assert rows(few.select("entry")) == [(6,)] and len(few.inputFiles()) == 1
    assert len(lake.table("logbook", filters=[("miles", ">=", 70)]).inputFiles()) == 1
    lake.sql("CALL reset_partition('logbook')")
    lake.sql("INSERT INTO logbook VALUES (8, 'Clara', timestamp_ntz'2013-01-01 00:00:00', 1)")
    assert lake.table("logbook").count() == 5
    for bad in ("CALL set_partition('logbook', NULL)", "CALL set_partition('logbook', 'nope')", "CALL set_partition('missing', 'entry')", "CALL set_partition('logbook', 'week(noted)')"):
        with pytest.raises(LakeError):
            lake.sql(bad)


def test_sorted(lake):
    lake.sql("CREATE TABLE s (a int, b string, ts timestamp)")
    lake.sql("CREATE INDEX ix ON s USING strata_sorted (a DESC, b ASC NULLS FIRST, date_trunc('day', ts))")
    assert rows(lake.get_sort("s")) == [(0, "a", "DESC", "NULLS_LAST"), (1, "b", "ASC", "NULLS_FIRST"), (2, "date_trunc('day', ts)", "ASC", "NULLS_LAST")]
    for i in range(3):
        lake.sql(f"INSERT INTO s VALUES ({i}, 'x', timestamp_ntz'2024-01-01 00:00:00')")
    lake.vacuum("s")
    assert lake.list_files("s").count() == 1
    assert [r.a for r in lake.table("s").collect()] == [2, 1, 0]
    for bad in ("CREATE UNIQUE INDEX u ON s USING strata_sorted (a)", "CREATE INDEX CONCURRENTLY u ON s USING strata_sorted (a)", "CREATE INDEX u ON s USING strata_sorted (a) WHERE a > 1", "CREATE INDEX u ON s USING strata_sorted (a) INCLUDE (b)"):
        with pytest.raises(LakeError):
            lake.sql(bad)
    lake.sql("ALTER TABLE s DROP COLUMN b")
    assert rows(lake.get_sort("s")) == []
    lake.set_sort("s", "a")
    lake.sql("DROP INDEX IF EXISTS ix")
    assert rows(lake.get_sort("s")) == []


def test_vacuum(lake):
    lake.sql("CREATE TABLE tides (day int, height double)")
    for day in range(7):
        lake.sql(f"INSERT INTO tides VALUES ({day}, {day}.25)")
    assert lake.list_files("tides").count() == 7
    said = lake.sql("VACUUM VERBOSE tides").collect()
    assert len(said) == 3 and lake.list_files("tides").count() == 1
    lake.sql("CREATE TABLE gauge (minute int, mark string)")
    lake.insert("gauge", lake.spark.range(60).selectExpr("cast(id as int) minute", "concat('m', id) mark").coalesce(1))
    lake.sql("DELETE FROM gauge WHERE minute % 4 = 0")
    v = lake.current_snapshot()
    files = lake.list_files("gauge").first()
    assert (files.record_count, files.delete_files, files.deleted_rows) == (60, 1, 15)
    lake.sql("VACUUM gauge")
    files = lake.list_files("gauge").first()
    assert (files.record_count, files.delete_files) == (45, 0)
    assert lake.table("gauge").count() == 45 == lake.table("gauge", version=v).count()
    lake.expire_snapshots(older_than=dt.datetime.now(dt.timezone.utc))
    gone = lake.sql("SELECT * FROM cleanup_old_files()").count()
    assert gone >= 9 and lake.table("gauge").count() == 45 and lake.table("tides").count() == 7
    with pytest.raises(LakeError):
        lake.table("gauge", version=v)


def test_transactions(spark, lake):
    lake.sql("CREATE TABLE x (id int)")
    other = Lake.open(spark, lake.path.rsplit("/", 1)[0])
    lake.sql("BEGIN")
    lake.sql("INSERT INTO x VALUES (1)")
    other.sql("BEGIN")
    other.sql("INSERT INTO x VALUES (2)")
    assert rows(lake.table("x")) == [(1,)] and rows(other.table("x")) == [(2,)]
    lake.sql("COMMIT")
    assert rows(other.table("x")) == [(2,)]
    other.sql("COMMIT")
    assert rows(lake.table("x")) == [(1,), (2,)]
    lake.sql("BEGIN")
    lake.sql("DELETE FROM x")
    assert lake.table("x").count() == 0 and other.table("x").count() == 2
    lake.sql("ROLLBACK")
    assert lake.table("x").count() == 2
    lake.insert("x", spark.range(10, 20).selectExpr("cast(id as int) id").coalesce(1))
    lake.begin()
    other.begin()
    lake.delete("x", "id = 10")
    other.delete("x", "id = 11")
    lake.commit()
    with pytest.raises(Conflict):
        other.commit()
    assert lake.table("x").count() == 11
    lake.sql("COMMIT")
    with lake.transaction():
        lake.create_table("fresh", "a int")
        lake.insert_values("fresh", [(1,), (2,)])
        lake.delete("fresh", "a = 1")
    assert rows(other.table("fresh")) == [(2,)]
    other.close()


def test_direct_insert_guards(lake):
    lake.sql("CREATE TABLE tally (n int, who string)")
    assert lake.insert_arrays("tally", {"n": [12, 15, 18], "who": ["p", "q", None]}) == 3  # inlining is off: a file
    assert lake.list_files("tally").count() >= 1
    lake.set_option("data_inlining_row_limit", 40, "tally")
    before = lake.list_files("tally").count()
    lake.insert_arrays("tally", {"n": [21], "who": ["r"]})
    lake.set("enable_direct_insert", False)
    lake.insert_arrays("tally", {"n": [24], "who": ["s"]})
    assert lake.list_files("tally").count() == before and rows(lake.sql("SELECT sum(n) AS s FROM tally")) == [(90,)]


def test_options_and_settings(lake):
    lake.sql("CREATE TABLE knobs (turn int)")
    lake.set_option("target_file_size", 64_000_000)
    lake.set_option("target_file_size", 8_000_000, "knobs")
    found = {(r.scope, r.scope_entry): r.value for r in lake.options().where("option_name = 'target_file_size'").collect()}
    assert found == {("global", None): "64000000", ("table", "public.knobs"): "8000000"}
    with pytest.raises(LakeError, match="Unsupported option"):
        lake.set_option("no_such_knob", 1)
    with pytest.raises(LakeError):
        lake.set("vacuum_delete_threshold", 2)
    lake.set_option("require_commit_message", True)
    with pytest.raises(LakeError, match="message"):
        lake.sql("INSERT INTO knobs VALUES (3)")
    lake.set_commit_message("first turn", "me")
    lake.sql("INSERT INTO knobs VALUES (3)")
    assert lake.snapshots().orderBy("snapshot_id", ascending=False).first().commit_message == "first turn"


def test_freeze_and_attach(spark, lake, tmp_path):
    lake.sql("CREATE TABLE boats (hull int, port string, knots double)")
    lake.sql("INSERT INTO boats VALUES (40, 'Rostock', 11.5), (41, 'Brest', 14.0), (42, 'Cadiz', 9.5), (43, 'Hull', 17.0)")
    lake.sql(f"CALL freeze('{tmp_path}/still.db')")
    with pytest.raises(LakeError, match="cannot be NULL"):
        lake.sql("CALL freeze(NULL)")
    other = Lake.open(spark, str(tmp_path / "second"))
    other.attach("still", f"{tmp_path}/still.db", lake.data_path, frozen=True)
    other.attach("live", lake.path.rsplit("/", 1)[0])
    other.sql("CREATE TABLE crew (hull int, hands int)")
    other.sql("INSERT INTO crew VALUES (41, 6), (43, 9)")
    lake.sql("DELETE FROM boats WHERE port = 'Hull'")
    got = other.sql("SELECT count(*) AS n, avg(knots) AS k FROM still.boats").first()
    assert (got.n, got.k) == (4, 13.0)
    assert rows(other.sql("SELECT c.hands, b.port FROM crew c JOIN live.boats b ON c.hull = b.hull")) == [(6, "Brest")]
    assert rows(other.sql("SELECT port FROM still.boats b WHERE EXISTS (SELECT 1 FROM crew WHERE crew.hull = b.hull)")) == [("Brest",), ("Hull",)]
    for bad in ("INSERT INTO live.boats VALUES (9, 'z', 1.0)", "DELETE FROM live.boats", "UPDATE still.boats SET hull = 1"):
        with pytest.raises(LakeError, match="read-only"):
            other.sql(bad)
    other.close()


def test_hybrid_and_catalog(spark, lake):
    spark.range(5).selectExpr("id", "id * 2 AS twice").createOrReplaceTempView("plain_numbers")
    lake.sql("CREATE TABLE odd_ones (id bigint, word string)")
    lake.sql("INSERT INTO odd_ones VALUES (1, 'one'), (3, 'three')")
    assert rows(lake.sql("SELECT (SELECT max(twice) FROM plain_numbers) AS h, (SELECT min(word) FROM odd_ones) AS l")) == [(8, "one")]
    assert rows(lake.sql("SELECT word FROM odd_ones JOIN plain_numbers USING (id) WHERE twice > 4")) == [("three",)]
    assert [r.table_name for r in lake.table_info().collect()] == ["odd_ones"]
    assert lake.sql("SELECT * FROM meta.data_file").count() == lake.list_files("odd_ones").count()
    assert lake.sql("SELECT * FROM current_snapshot()").first()[0] == lake.last_committed_snapshot()
    with pytest.raises(LakeError):
        lake.sql("CREATE TEMP TABLE q (a int)")
    with pytest.raises(LakeError):
        lake.list_files("plain_numbers")
    again = Lake.open(spark, lake.path.rsplit("/", 1)[0])
    assert rows(again.table("odd_ones")) == [(1, "one"), (3, "three")]
    again.sql("DROP TABLE odd_ones")
    assert lake.table_info().count() == 0
    again.close()


def test_merge(spark, lake):
    lake.sql("CREATE TABLE m (k int, v string)")
    lake.sql("INSERT INTO m VALUES (1, 'a'), (2, 'b')")
    spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string").createOrReplaceTempView("news")
    assert tag(lake, "MERGE INTO m t USING news s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)") == "MERGE 2"
    assert rows(lake.table("m")) == [(1, "a"), (2, "B"), (3, "C")]


def test_types(spark, lake):
    lake.sql("CREATE TABLE ty (b boolean, i2 smallint, i4 int, i8 bigint, f4 float, f8 double, d date, ts timestamp, tz timestamptz, u uuid, t string, x binary, n decimal(12,3), l array<int>, s struct<a:int,b:string>, m map<string,int>)")
    values = "SELECT true, 1S, 2, 3L, 1.5F, 2.5D, date'2024-01-02', timestamp_ntz'2024-01-02 03:04:05', timestamp'2024-06-15 12:30:00+05:30', '0e37df36-f698-11e6-8dd4-cb9ced3df976', 'héllo', X'00ff', 12.345, array(1, 2), named_struct('a', 1, 'b', 'x'), map('k', 7)"
    for limit in (0, 100):
        lake.set_option("data_inlining_row_limit", limit, "ty")
        lake.sql(f"INSERT INTO ty {values}")
    first, second = lake.table("ty").collect()
    assert first == second and first.l == [1, 2] and first.m == {"k": 7} and bytes(first.x) == b"\x00\xff"
    lake.sql("CREATE TABLE va (id int, v variant)")
    lake.set_option("data_inlining_row_limit", 100, "va")
    lake.sql("""INSERT INTO va SELECT 1, CAST('{"name": "alice"}' AS variant)""")
    assert lake.sql("SELECT CAST(v AS string) AS s FROM va").first().s == '{"name": "alice"}'
    assert lake.list_files("va").count() == 1
    lake.create_table("odd", [{"name": "a", "type": "int32"}, {"name": "b", "type": "something_new"}])
    assert dict(lake.table("odd").dtypes) == {"a": "int", "b": "string"}


def test_writer_options_and_paths(lake, tmp_path):
    lake.set("default_table_path", str(tmp_path / "elsewhere"))
    lake.sql("CREATE TABLE el (a int, b string)")
    lake.reset("default_table_path")
    for key, value in (("parquet_compression", "zstd"), ("parquet_compression_level", 5), ("parquet_version", 2), ("parquet_row_group_size", 50), ("per_thread_output", False)):
        lake.set_option(key, value, "el")
    lake.insert("el", lake.spark.range(200).selectExpr("cast(id as int) a", "concat('x', id) b").repartition(4))
    files = lake.list_files("el").collect()
    assert len(files) == 1 and files[0].data_file.startswith(str(tmp_path / "elsewhere"))
    lake.sql("DELETE FROM el WHERE a < 100")
    assert lake.table("el").count() == 100
    lake.sql("VACUUM el")
    assert lake.table("el").count() == 100
    lake.set_option("expire_older_than", "0 seconds")
    assert lake.expire_snapshots() and lake.cleanup_old_files() and lake.table("el").count() == 100


def test_names_in_queries(spark, lake):
    lake.sql("CREATE TABLE t (a int, b string)")
    lake.sql("INSERT INTO t VALUES (1, 'from t'), (2, 'join u -- x')")
    lake.sql("CREATE TABLE u (a int, c int)")
    lake.sql("INSERT INTO u VALUES (1, 10), (3, 30)")
    assert rows(lake.sql("SELECT t.b, u.c FROM t, u WHERE t.a = u.a")) == [("from t", 10)]
    assert rows(lake.sql("SELECT x.b, y.c FROM t x, u AS y WHERE x.a = y.a")) == [("from t", 10)]
    assert rows(lake.sql("SELECT b FROM t WHERE b = 'join u -- x' -- FROM u")) == [("join u -- x",)]
    assert rows(lake.sql("WITH u AS (SELECT 5 AS a) SELECT * FROM u")) == [(5,)]
    assert rows(lake.sql("WITH w AS (SELECT a FROM t) SELECT count(*) AS n FROM w JOIN u ON w.a = u.a")) == [(1,)]
    assert rows(lake.sql("SELECT (SELECT max(c) FROM u) AS m, count(*) AS n FROM (SELECT * FROM t WHERE a IN (SELECT a FROM u)) s")) == [(30, 1)]
    assert rows(lake.sql("SELECT t.a FROM t LEFT JOIN u ON t.a = u.a WHERE u.a IS NULL")) == [(2,)]
    assert rows(lake.sql('SELECT "b" FROM t WHERE "a" = 1')) == [("from t",)]
    assert rows(lake.sql("SELECT a FROM t UNION ALL SELECT a FROM u")) == [(1,), (1,), (2,), (3,)]
    assert rows(lake.sql("SELECT b FROM t WHERE a = :k", {"k": 2})) == [("join u -- x",)]
    assert rows(lake.sql("SELECT extract(year FROM timestamp_ntz'2024-01-01 00:00:00') AS y, a FROM t WHERE a = 1")) == [(2024, 1)]
    lake.sql("UPDATE t SET b = 'where a = 1' WHERE a = (SELECT 1)")
    assert rows(lake.sql("SELECT b FROM public.t WHERE a = 1")) == [("where a = 1",)]
    lake.sql("DELETE FROM t WHERE a IN (1, 2) AND b LIKE 'join%'")
    assert lake.table("t").count() == 1
    lake.sql("INSERT INTO t SELECT a, cast(c AS string) FROM u WHERE a > 1")
    assert rows(lake.table("t")) == [(1, "where a = 1"), (3, "30")]


def test_unnest(lake):
    lake.sql("CREATE TABLE pairs (left_one int, right_one string)")
    assert tag(lake, "INSERT INTO pairs SELECT UNNEST(ARRAY[9, 8, 7, 6]), UNNEST(ARRAY['i', 'h', 'g', 'f'])") == "INSERT 0 4"
    assert tag(lake, "INSERT INTO pairs SELECT UNNEST(ARRAY[30, 20]) AS left_one, UNNEST(ARRAY['t', NULL]) AS right_one") == "INSERT 0 2"
    assert rows(lake.sql("SELECT * FROM pairs WHERE left_one > 10 AND right_one IS NOT NULL")) == [(30, "t")]
    assert rows(lake.sql("SELECT x * 3 AS y FROM UNNEST(ARRAY[1, 5]) AS q(x)")) == [(3,), (15,)]
    assert lake.table("pairs").count() == 6