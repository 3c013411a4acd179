"""Random histories: every version of a lake table equals a replay of its operations on plain rows."""

import random

import pytest

OPERATIONS = ("insert", "insert", "arrays", "delete", "update", "vacuum", "flush")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay(spark, lake, seed):
    rng = random.Random(seed)
    lake.create_table("h", "k int, v int")
    lake.set_option("data_inlining_row_limit", rng.choice([0, 4]))
    rows: dict[int, int] = {}
    states = {lake.current_snapshot(): dict(rows)}
    first, fresh = lake.current_snapshot(), 0
    for _ in range(9):
        op = rng.choice(OPERATIONS)
        if op in ("insert", "arrays"):
            new = {fresh + i: rng.randint(0, 9) for i in range(rng.randint(1, 8))}
            fresh += len(new)
            if op == "insert":
                lake.insert_values("h", list(new.items()))
            else:
                lake.insert_arrays("h", {"k": list(new), "v": list(new.values())})
            rows |= new
        elif op == "delete":
            x = rng.randint(0, 9)
            assert lake.delete("h", f"v = {x}") == sum(v == x for v in rows.values())
            rows = {k: v for k, v in rows.items() if v != x}
        elif op == "update":
            x = rng.randint(0, 6)
            assert lake.update("h", {"v": "v + 1"}, f"v <= {x}") == sum(v <= x for v in rows.values())
            rows = {k: v + (v <= x) for k, v in rows.items()}
        elif op == "vacuum":
            lake.vacuum("h")
        else:
            lake.flush_inlined_data("h")
        states[lake.current_snapshot()] = dict(rows)
    for version, want in states.items():
        assert sorted(tuple(r) for r in lake.table("h", version=version).collect()) == sorted(want.items())
    # The feed from the beginning adds up to the table.
    state: dict = {}
    for r in lake.table_changes("h", first, lake.current_snapshot()).orderBy("snapshot_id", "change_type").collect():
        if r.change_type in ("insert", "update_postimage"):
            state[r.rowid] = (r.k, r.v)
        elif r.change_type == "delete":
            state.pop(r.rowid)
    assert sorted(state.values()) == sorted(rows.items())
