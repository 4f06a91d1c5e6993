"""Ranks, folds and splits: exactness and the split properties."""

import random

from pyspark.sql import functions as F

from attemptlog.operators import splits as SP


def test_global_rank_dense(spark):
    rnd = random.Random(5)
    ids = rnd.sample(range(10_000), 500)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id long, g long")
    got = {r["id"]: r["idx"] for r in SP.global_rank(df, ["id"], num_partitions=7).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}
    byg = {(r["g"], r["id"]): r["idx"] for r in SP.global_rank(df, ["id"], ["g"], num_partitions=5).collect()}
    for g in range(3):
        members = sorted(i for i in ids if i % 3 == g)
        assert [byg[(g, i)] for i in members] == list(range(len(members)))


def test_index_students(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "student_id string")
    got = {r["student_id"]: r["student_id_encoded"] for r in SP.index_students(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_folds_properties(spark):
    labels = spark.createDataFrame([(f"s{i}", int(i % 7 == 0)) for i in range(203)], "student_id string, Label int")
    folds = SP.stratified_folds(labels, k=5, seed=42)
    rows = folds.collect()
    assert len(rows) == 203 and len({r["student_id"] for r in rows}) == 203   # disjoint, cover
    for lab in (0, 1):
        sizes = [sum(1 for r in rows if r["Label"] == lab and r["fold"] == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = {r["student_id"]: r["fold"] for r in SP.stratified_folds(labels.repartition(3), k=5, seed=42).collect()}
    assert again == {r["student_id"]: r["fold"] for r in rows}                # deterministic


def test_split_properties(spark):
    labels = spark.createDataFrame([(f"s{i}", int(i % 4 == 0)) for i in range(100)], "student_id string, Label int")
    sp = SP.stratified_split(labels)
    counts = {(r["Label"], r["split"]): r["count"] for r in sp.groupBy("Label", "split").count().collect()}
    assert counts[(0, "train")] == 53 and counts[(1, "train")] == 18
    assert SP.split_overlap(sp).count() == 0
    assert SP.split_intersection(sp.filter("split = 'train'"), sp.filter("split = 'test'")).count() == 0


def test_student_label_uses_order(spark):
    df = spark.createDataFrame([("s", 3, False), ("s", 1, True)], "student_id string, new_task_id long, Label boolean")
    assert SP.student_label(df).collect()[0]["Label"] is True
    _ = F


def test_null_labels_stay(spark):
    rows = [(i, None if i % 4 == 0 else i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "student_id long, Label int")
    folds = SP.stratified_folds(df, k=3).collect()
    assert sorted(r["student_id"] for r in folds) == list(range(20))
    sp = SP.stratified_split(df).collect()
    assert sorted(r["student_id"] for r in sp) == list(range(20))
    per = {}
    for r in folds:
        per.setdefault(r["Label"], []).append(r["fold"])
    assert all(max(map(f.count, range(3))) - min(map(f.count, range(3))) <= 1 for f in per.values())
