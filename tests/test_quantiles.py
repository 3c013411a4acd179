"""The exact median, and aggregates that keep no state for each distinct value."""

import os

import pytest

from strata.operators.quantiles import median
from strata.plans import relational

SF = "/root/testdata/sf0.001"


def test_median(spark):
    cases = ([], [None], [3.0], [1.0, 2.0], [5.0, None, 1.0, 9.0], [7.0] * 50 + [1.0] * 49, [float(i * i % 97) for i in range(500)], [1.0] * 20 + [100.0] * 20)
    for values in cases:
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        want = rows.selectExpr("median(x)").first()[0]
        assert median(rows, "x") == want


def test_median_outside_the_first_bounds(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("CAST(id AS double) AS x")
    from strata.operators import quantiles

    real, calls = quantiles.F.percentile_approx, []
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, p: calls.append(p) or real(c, [0.9, 0.95] if len(calls) == 1 else p))
    assert median(rows, "x") == 499.5 and len(calls) == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")
def test_approximate_keeps_no_summary_for_each_customer(spark):
    plan = relational.queries()["rel_approx"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Aggregate(" in line]
    assert lines and not any("keys=[o_custkey" in line and "percentile" in line for line in lines)
