"""What is broadcast, and how deleted places are left out, at any number of places."""

import random

import pytest

from strata.operators import maintenance
from strata.sources import scan


def below(df, node, after="executedPlan"):
    """The plan's lines below each node of a name, as one text a node."""
    lines = getattr(df._jdf.queryExecution(), after)().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if node in line:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out


@pytest.fixture()
def changed(spark, lake):
    """Two inserts, a delete and an update of columns named like the scan's own."""
    lake.create_table("t", "pos long, data_path string, amount double")
    rows = spark.range(0, 3000).selectExpr("id AS pos", "concat('v', id) AS data_path", "CAST(id AS double) AS amount")
    start = lake.current_snapshot()
    lake.insert("t", rows.where("pos % 2 = 0").coalesce(2))
    lake.insert("t", rows.where("pos % 2 = 1").coalesce(1))
    lake.delete("t", "amount < 100")
    lake.update("t", {"data_path": "'u'"}, "amount >= 2900")
    return lake, start


def test_changes_broadcast_no_rows(changed):
    lake, start = changed
    lake.vacuum("t")
    feed = lake.table_changes("t", start, lake.current_snapshot())
    sent = below(feed, "BroadcastExchange")
    assert sent and not any("amount" in s for s in sent)
    counts = {r["change_type"]: r["count"] for r in feed.groupBy("change_type").count().collect()}
    assert counts == {"insert": 3000, "delete": 100, "update_preimage": 100, "update_postimage": 100}


def test_places_of_several_bitmaps(spark, lake, monkeypatch):
    lake.create_table("t", "k long, pos string")
    n, rng = 3 * scan.BITMAP_ROWS + 11, random.Random(5)
    gone = sorted({0, 7, 8, scan.BITMAP_ROWS - 1, scan.BITMAP_ROWS, n - 1} | {rng.randrange(n) for _ in range(900)})
    lake.insert("t", spark.range(n).selectExpr("id AS k", "'p' AS pos").coalesce(1))
    for some in (gone[::2], gone[1::2]):
        lake.delete("t", f"k IN ({', '.join(map(str, some))})")
    want = sorted(set(range(n)) - set(gone))
    assert [r.k for r in lake.table("t").orderBy("k").collect()] == want
    assert below(lake.table("t"), "BroadcastExchange")
    monkeypatch.setattr(scan, "BITMAPS", 0)
    shuffled = lake.table("t")
    assert not below(shuffled, "BroadcastExchange") and "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in shuffled.orderBy("k").collect()] == want


@pytest.mark.parametrize("bitmaps", [scan.BITMAPS, 0])
def test_vacuum_sorts_nothing_in_coalesced_tasks(spark, lake, monkeypatch, bitmaps):
    lake.create_table("t", "k long, v double")
    for i in range(3):
        lake.insert("t", spark.range(i * 100, i * 100 + 100).selectExpr("id AS k", "CAST(id AS double) AS v").coalesce(1))
    lake.delete("t", "k % 4 = 0")
    plans, write = [], maintenance.write
    monkeypatch.setattr(scan, "BITMAPS", bitmaps)
    monkeypatch.setattr(maintenance, "write", lambda rows, *a, **how: plans.append(rows) or write(rows, *a, **how))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables above it
    try:
        lake.vacuum("t")
        assert len(plans) == 1 and not any("Join" in s for s in below(plans[0], "Coalesce"))
        assert bool(below(plans[0], "Coalesce")) == bool(bitmaps)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = lake.list_files("t").collect()
    assert len(files) == 1 and files[0].delete_files == 0
    assert sorted(r.k for r in lake.table("t").collect()) == [k for k in range(300) if k % 4]
