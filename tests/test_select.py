"""Radix selection against numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from attemptlog.operators.select import exact_percentiles, least_means, order_key, select_ranks

EDGE = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
        -1.7976931348623157e308, float("inf"), -float("inf"), math.nextafter(1, 0), math.nextafter(1, 2), 0.1, 1e300, 1e-300,
        float(2**53), float(2**53 - 1), 8.0, math.nextafter(8, 0), math.nextafter(8, 9)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False), min_size=40, max_size=120))
def test_keys_order_like_values(spark, values):
    values = EDGE + values
    df = spark.createDataFrame([(v,) for v in values + [float("nan")]], "v double")
    got = df.selectExpr("v", order_key("v", df.schema["v"].dataType) + " AS k").collect()
    keyed = sorted((r for r in got if not math.isnan(r["v"])), key=lambda r: r["v"])
    for a, b in zip(keyed, keyed[1:], strict=False):
        assert (a["v"] < b["v"]) == (a["k"] < b["k"]) and (a["v"] == b["v"]) == (a["k"] == b["k"])
    assert max(got, key=lambda r: r["k"])["v"] != max(got, key=lambda r: r["k"])["v"]     # NaN


def groups():
    rnd = random.Random(4)
    rows = []
    for g, n in ((None, 7), ("a", 1), ("b", 2), ("hot", 3000), ("ties", 500), ("neg", 200), ("nulls", 30)):
        for _ in range(n):
            x = {"ties": float(rnd.randrange(3)), "neg": -rnd.random() * 10 ** rnd.randrange(-5, 6),
                 "nulls": None}.get(g, rnd.choice([rnd.random(), rnd.random() * 1e9, 7.25]))
            rows.append((g, x, rnd.randrange(-50, 5000) if g != "nulls" or rnd.random() < 0.5 else None))
    return rows


@pytest.mark.parametrize("q", [0.5, 0.75, 0.0, 1.0])
def test_percentiles(spark, q):
    rows = groups()
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(5)
    got = {r["g"]: (r["px"], r["pn"]) for r in exact_percentiles(df, ["g"], {"x": "px", "n": "pn"}, q).collect()}
    for g in {r[0] for r in rows}:
        for k in (1, 2):
            v = [r[k] for r in rows if r[0] == g and r[k] is not None]
            want = float(np.percentile(v, q * 100)) if v else None
            assert got[g][k - 1] == (pytest.approx(want, rel=1e-12) if v else None)


@pytest.mark.parametrize("n", [0, 1, 3, 10_000])
def test_means_of_the_least(spark, n):
    rows = groups()
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(5)
    got = {r["g"]: (r["mx"], r["mn"]) for r in
           least_means(df, ["g"], {"x": "mx", "n": "mn"}, spark.createDataFrame([(n,)], "top_n long")).collect()}
    for g in {r[0] for r in rows}:
        for k in (1, 2):
            v = sorted(r[k] for r in rows if r[0] == g and r[k] is not None)[:n]
            assert got[g][k - 1] == (pytest.approx(sum(v) / len(v), rel=1e-9) if v else None)


def test_no_sort_by_value_no_writes_and_empty(spark):
    df = spark.createDataFrame(groups(), "g string, x double, n long")
    plan = exact_percentiles(df, ["g"], {"x": "px"})._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Python" not in plan and "SinglePartition" not in plan
    assert exact_percentiles(df.limit(0), ["g"], {"x": "px", "n": "pn"}).collect() == []
    assert select_ranks(df, ["g"], ["x"], ["_total"]).collect() == []        # a rank that there is not
