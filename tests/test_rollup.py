"""Mergeable distinct counts, samples of every group and the lookup that is added to."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attemptlog.operators import bitmaps as B
from attemptlog.operators import samples as SM
from attemptlog.operators.splits import index_students
from attemptlog.sources import lookup as L

ATTEMPTS = "course_id string, problem_id long, student_id string"


def attempts():
    rnd = random.Random(11)
    rows = [(rnd.choice("ABC"), rnd.randrange(6), f"s{rnd.randrange(40)}") for _ in range(900)]
    rows += [("A", 2, "hot")] * 700 + [(None, 1, "s1"), ("B", None, "s2"), ("B", None, None), ("C", 3, None), (None, None, None)]
    return rows


def expected(rows):
    def stats(level, c, p, group):
        tasks = defaultdict(int)
        for r in group:
            tasks[r] += 1
        return (level, c, p, len(group), len({r[2] for r in group} - {None}), len({r[1] for r in group} - {None}),
                len({r[0] for r in group} - {None}), len({(r[1], r[2]) for r in group if r[1] is not None and r[2] is not None}),
                min(tasks.values()), max(tasks.values()), round(len(group) / len(tasks), 9))
    leaf, mid = defaultdict(list), defaultdict(list)
    for r in rows:
        leaf[r[:2]].append(r)
        mid[r[0]].append(r)
    return {stats("problem", c, p, g) for (c, p), g in leaf.items()} | {stats("section", c, None, g) for c, g in mid.items()} \
        | {stats("all", None, None, rows)}


def test_rollup_counts_like_sets(spark):
    rows = attempts()
    got = B.dataset_rollup(spark.createDataFrame(rows, ATTEMPTS)).collect()
    assert {(*r[:-1], round(r["mean_snapshots"], 9)) for r in got} == expected(rows)
    assert len(got) == len(expected(rows))


def test_rollup_without_rows(spark):
    got = B.dataset_rollup(spark.createDataFrame([], ATTEMPTS)).collect()
    assert [(r["level"], r["n_snapshots"], r["n_students"], r["n_pairs"], r["min_snapshots"]) for r in got] == [("all", 0, 0, 0, None)]


def test_bitmaps_of_two_loads_merge(spark):
    # ids on both sides of the first bitmap's end
    rows = [("A", k % 3, f"s{k}") for k in range(0, 50000, 5)] + [("B", k % 3, f"s{k}") for k in range(0, 50000, 7)]
    df = spark.createDataFrame(rows, ATTEMPTS)
    codes = spark.range(50000).select(F.concat(F.lit("s"), "id").alias("student_id"), F.col("id").alias("student_id_encoded"))
    parts = [B.id_bitmaps(df.filter(F.col("course_id") == c), codes, ["course_id", "problem_id"]) for c in "AB"]
    both = parts[0].unionByName(parts[1])
    got = {r["problem_id"]: r["n_students"] for r in B.count_bitmaps(B.merge_bitmaps(both, ["problem_id"]), ["problem_id"]).collect()}
    assert got == {p: len({s for _, q, s in rows if q == p}) for p in range(3)}
    assert B.count_bitmaps(B.merge_bitmaps(both, []), []).first()["n_students"] == len({s for _, _, s in rows})


def test_bitmaps_do_not_expand_rows(spark):
    df = spark.createDataFrame(attempts(), ATTEMPTS)
    base = B.id_bitmaps(df, index_students(df.filter("student_id is not null")), ["course_id", "problem_id"])
    plan = B.merge_bitmaps(base, ["course_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def digest(seed, *keys):
    return hashlib.md5(":".join([str(seed), *map(str, keys)]).encode()).hexdigest()


def test_samples_of_every_group(spark):
    rows = [("hot" if k % 3 == 0 else f"g{k % 50}", k, k % 7) for k in range(3000)] + [(None, k, 1) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, id long, v int")
    out = SM.sample_groups(df, ["g"], 10, ["id"], seed=3, salts=8)
    got = defaultdict(list)
    for r in out.orderBy("sample_no").collect():
        got[r["g"]].append((r["id"], r["v"]))
    assert out.columns == ["g", "id", "v", "sample_no"]
    for g in {r[0] for r in rows}:
        want = sorted((digest(3, i), i, v) for h, i, v in rows if h == g)[:10]
        assert got[g] == [(i, v) for _, i, v in want]
    five = {(r["g"], r["id"]) for r in SM.sample_groups(df, ["g"], 5, ["id"], seed=3).collect()}
    assert five <= {(g, i) for g, kept in got.items() for i, _ in kept}


def test_samples_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = SM.sample_groups(df, ["g"], 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    shuffles = plan.split("Exchange hashpartitioning")
    assert len(shuffles) == 3                              # by group and salt, then by group
    assert "WindowGroupLimit" in shuffles[-1]              # below the first shuffle
    assert SM.sample_groups(df.limit(0), ["g"], 5, ["id"]).count() == 0


def test_repeated_rows_of_a_sample(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 1, "x")], "g string, id long, t string")
    assert [(r["t"], r["sample_no"]) for r in SM.sample_groups(df, ["g"], 2, ["id"]).orderBy("sample_no").collect()] == [("x", 1), ("x", 2)]


def test_failed_tasks_of_every_problem(spark):
    rows = [(f"s{k}", k % 2, 100.0 if k % 5 == 0 else 40.0, 10 if k % 3 else 4, 900 if k % 7 == 0 else 5) for k in range(300)]
    df = spark.createDataFrame(rows, "student_id string, problem_id long, max_score double, num_snapshots long, max_gap long")
    got = {(r["student_id"], r["problem_id"]) for r in SM.failure_samples(df, n=10).collect()}
    want = set()
    for p in (0, 1):
        pool = sorted((digest(42, s, p), s, gap) for s, q, m, n, gap in rows if q == p and m != 100 and n == 10)[:10]
        want |= {(s, p) for _, s, gap in pool if gap <= 600}
    assert got == want


def table(spark, rows):
    return spark.createDataFrame(rows, "code string, vector array<float>")


def stored(spark, path):
    return sorted((r["code"], list(r["vector"])) for r in L.load_lookup(spark, path).collect())


def test_two_loads_equal_one(spark, tmp_dir):
    a = [(f"c{k}", [float(k), 0.5]) for k in range(60)]
    b = [(f"c{k}", [float(k), 2.5]) for k in range(40, 90)] + [(None, [1.0])]
    two, one = f"{tmp_dir}/two", f"{tmp_dir}/one"
    L.upsert_lookup(spark, two, table(spark, a), parts=8)
    L.upsert_lookup(spark, two, table(spark, b), parts=8)
    L.upsert_lookup(spark, one, table(spark, [(c, v) for c, v in a if int(c[1:]) < 40] + b), parts=8)
    assert stored(spark, two) == stored(spark, one)
    assert len(stored(spark, two)) == 90 and ("c45", [45.0, 2.5]) in stored(spark, two)


def test_load_leaves_other_partitions_alone(spark, tmp_dir):
    import glob
    path = f"{tmp_dir}/lookup"
    L.upsert_lookup(spark, path, table(spark, [(f"c{k}", [1.0]) for k in range(200)]), parts=16)
    before = set(glob.glob(f"{path}/parts=16/part=*/*.parquet"))
    L.upsert_lookup(spark, path, table(spark, [("c7", [9.0]), ("c7", [8.0]), ("c7", [9.0])]), parts=16)
    after = set(glob.glob(f"{path}/parts=16/part=*/*.parquet"))
    assert len(before - after) == 1 and len(after - before) == 1
    assert len(stored(spark, path)) == 200 and ("c7", [9.0]) in stored(spark, path)
    L.upsert_lookup(spark, path, table(spark, []), parts=16)
    assert set(glob.glob(f"{path}/parts=16/part=*/*.parquet")) == after
    with pytest.raises(ValueError):
        L.upsert_lookup(spark, path, table(spark, [("x", [1.0])]), parts=4)


def test_only_new_snippets_are_embedded(spark, tmp_dir):
    path, seen = f"{tmp_dir}/lookup", f"{tmp_dir}/seen"

    def encoder(texts):
        import os
        import uuid
        os.makedirs(seen, exist_ok=True)
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t))] for t in texts]

    def texts(*names):
        return spark.createDataFrame([(t,) for t in names], "code string")
    L.embed_new(spark, path, texts("a", "bb", "a", None), 1, encoder, parts=4)
    L.embed_new(spark, path, texts("bb", "ccc", "", "ccc"), 2, encoder, parts=4)
    L.embed_new(spark, path, texts("a", None), 3, encoder, parts=4)
    got = sorted((r["code"], r["load"], list(r["vector"])) for r in L.load_lookup(spark, path).collect())
    assert got == [("", 2, [0.0]), ("a", 1, [1.0]), ("bb", 1, [2.0]), ("ccc", 2, [3.0])]
    import os
    calls = [line for f in os.listdir(seen) for line in open(f"{seen}/{f}").read().split("\n")[:-1]]
    assert sorted(calls) == ["", "a", "bb", "ccc"]
