import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by capping and sharing anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5000), st.floats(0.01, 0.99)), min_size=0, max_size=60), st.booleans())
def test_settle_keeps_the_sum(units, last):
    size = np.array([u[0] for u in units], float)
    mass = size * np.array([u[1] for u in units])
    key = np.arange(len(units), dtype=np.uint64) * np.uint64(7919)
    out = mixing.settle(mass, size, key, last)
    open_ = (out > 0) & (out < size)
    assert open_.sum() <= (0 if last else 1)
    if not last:
        assert abs(out.sum() - mass.sum()) < 1e-6 * max(1.0, mass.sum())
    elif len(units):
        assert abs(out.sum() - mass.sum()) <= size.max()


def test_settle_keeps_expectations():
    size = np.array([5.0, 3, 2, 2, 1, 1, 1, 7])
    mass = size * 0.3
    seen = np.zeros(len(size))
    for seed in range(4000):
        key = (np.arange(len(size), dtype=np.uint64) + np.uint64(seed * 1000 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        seen += mixing.settle(mass, size, key, True) > 0
    assert np.allclose(seen / 4000, 0.3, atol=0.035)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{rng.integers(0, 5)}") for i in range(400)]
    rows += [(900, None, "s1"), (901, "", None), (902, "a b c", None), (902, "a b c", None), (None, "x y", "s2"), (None, "z", "s2")]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size * r.rows
    assert sum(r.rows for r in got) == len(rows)
    for s, words in taken.items():
        assert abs(words - want[s]) <= 6
    again = {(r.doc_id, r.source, r.text_hash): r.copies for r in mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()}
    assert again == {(r.doc_id, r.source, r.text_hash): r.copies for r in got}


def test_mix_over_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    rows = [(i, "w " * (1 + i % 13), "abc"[i % 3]) for i in range(600)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 600
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 13


def test_mixed_rows_and_empty(spark):
    rows = [(i, "word " * (1 + i % 5), "ab"[i % 2]) for i in range(50)] + [(7, "word " * 3, "b")]
    frame = docs(spark, rows).withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS copies", "2 AS size")
    plan = {(r.doc_id, r.source, r.text_hash): r.copies * r.rows for r in mixing.mix(frame).collect()}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    assert out.count() == sum(plan.values())
    none = docs(spark, [])
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
