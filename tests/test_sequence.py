"""The skew-safe sequence primitive against a brute-force Python reference."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attemptlog.operators.sequence import hot_keys, sequenced


def _rows(n_keys=6, seed=7):
    rnd = random.Random(seed)
    rows = []
    oid = 0
    base = datetime(2024, 1, 1)
    for k in range(n_keys):
        for _ in range(rnd.randint(1, 30 if k else 200)):   # key 0 is hot
            oid += rnd.randint(1, 5)
            rows.append((k % 3, k, oid, base + timedelta(seconds=oid * 7), float(rnd.randint(0, 10))))
    return rows


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    out = {}
    for key, g in groups.items():
        g.sort(key=lambda r: r[2])
        best = max(r[4] for r in g)
        best_pos = next(i for i, r in enumerate(g, 1) if r[4] == best)
        for i, r in enumerate(g, 1):
            out[r[2]] = (i, len(g), g[i - 2][3] if i > 1 else None, g[0][3], g[-1][4], best, best_pos)
    return out


@pytest.mark.parametrize("mode", ["plain", "hot", "given"])
def test_sequenced_matches_brute_force(spark, mode):
    rows = _rows()
    df = spark.createDataFrame(rows, "s long, p long, ord long, ts timestamp, score double")
    kw = {"plain": {}, "hot": {"target_rows": 10},
          "given": {"target_rows": 10, "hot": hot_keys(df, ["s", "p"], 10)}}[mode]
    out = sequenced(df, ["s", "p"], ["ord"], carry=["ts", "score"], value="score", **kw)
    got = {r["ord"]: (r["pos"], r["n"], r["prev_ts"], r["first_ts"], r["last_score"], r["best"], r["best_pos"])
           for r in out.collect()}
    assert got == _brute(rows)


def test_null_keys_dropped(spark):
    # Q1: a NULL key does not form a group
    df = spark.createDataFrame([(None, 1, 1, 1.0), (1, 1, 2, 2.0), (1, 1, 3, 1.0)],
                               "s long, p long, ord long, score double")
    out = sequenced(df, ["s", "p"], ["ord"], value="score").orderBy("ord").collect()
    assert [(r["ord"], r["pos"], r["n"], r["best_pos"]) for r in out] == [(2, 1, 2, 1), (3, 2, 2, 1)]


def test_ties_broken_by_tiebreak(spark):
    # Q5: equal order values; the tiebreak decides, results stable across partitionings
    rows = [(1, 1, 5, i, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "s long, p long, ord long, tb long, score double")
    a = sequenced(df.repartition(3), ["s", "p"], ["ord", "tb"], value="score")
    b = sequenced(df.repartition(1), ["s", "p"], ["ord", "tb"], value="score")
    key = lambda r: r["tb"]
    assert sorted([(r["tb"], r["pos"]) for r in a.collect()], key=lambda x: x[0]) == \
        sorted([(r["tb"], r["pos"]) for r in b.collect()], key=lambda x: x[0])
    assert [r["pos"] for r in sorted(a.collect(), key=key)] == [1, 2, 3, 4, 5, 6]


def test_no_single_partition_window(spark):
    df = spark.createDataFrame(_rows(), "s long, p long, ord long, ts timestamp, score double")
    plan = sequenced(df, ["s", "p"], ["ord"], carry=["ts"], value="score", target_rows=10) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_hot_key_with_null_and_clustered_orders(spark):
    # one key holds a third of all rows; its orders are NULL, equal or close together
    rnd = random.Random(3)
    rows = [("hot", None if i % 10 == 0 else 5 if i < 60 else 10_000 + i, i,
             None if i % 7 == 0 else float(rnd.randint(0, 5))) for i in range(100)]
    rows += [(f"k{i % 40}", rnd.randint(0, 9), 1000 + i, float(i % 4)) for i in range(200)]
    rows += [("none", i, 2000 + i, None) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, ord long, tb long, score double")
    got = {}
    for target in (3, 10 ** 6):
        out = sequenced(df, ["key"], ["ord", "tb"], carry=["tb", "score"], value="score", target_rows=target)
        got[target] = sorted((r["tb"], r["pos"], r["n"], r["prev_tb"], r["first_tb"], r["last_score"], r["best"], r["best_pos"])
                             for r in out.collect())
    assert len(got[3]) == len(rows) and got[3] == got[10 ** 6]
    hot = [r for r in got[3] if r[0] < 100]
    assert sorted(r[1] for r in hot) == list(range(1, 101)) and {r[2] for r in hot} == {100}
    assert all(r[6] is None and r[7] is None for r in got[3] if r[0] >= 2000)


def test_no_segment_above_the_target(spark):
    from attemptlog.operators.splits import global_rank
    rows = [("hot", 5, i) for i in range(90)] + [("b", i, 500 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "key string, ord long, tb long")
    ranked = global_rank(df, ["ord", "tb"], ["key"], "rank")
    sizes = ranked.groupBy("key", F.floor(F.col("rank") / 4).alias("seg")).count().collect()
    assert max(r["count"] for r in sizes) == 4 and sum(r["count"] for r in sizes) == 99


@pytest.mark.parametrize("target", [10, 1 << 22])
def test_sequenced_timestamp_order_with_tiebreak(spark, target):
    # time as the first order column, equal times broken by a second column
    rows = _rows(seed=13)
    rows = [(s, p, o, ts.replace(second=0, microsecond=0), sc) for s, p, o, ts, sc in rows]
    df = spark.createDataFrame(rows, "s long, p long, ord long, ts timestamp, score double")
    out = sequenced(df, ["s", "p"], ["ts", "ord"], carry=["score"], value="score", target_rows=target)
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    exp = {}
    for g in groups.values():
        g.sort(key=lambda r: (r[3], r[2]))
        for i, r in enumerate(g, 1):
            exp[r[2]] = (i, g[i - 2][4] if i > 1 else None)
    got = {r["ord"]: (r["pos"], r["prev_score"]) for r in out.collect()}
    assert got == exp
