"""Encoders: exact lengths, padding, decode inverse (Q24, Q34)."""

from attemptlog.operators import encode as E

ROWS = [("s", [3, 1, 2], [True, False, True], [[1.0], [1.0, 2.0, 3.0], [5.0, 6.0]], 4)]
SCHEMA = "student_id string, prev_q array<int>, prev_labels array<boolean>, prev_scores array<array<double>>, target_q int"


def test_task_and_attempt_encoding(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = E.encode_attempts(E.encode_tasks(df), pad=10).collect()[0]
    assert r["task_seq"] == [3, 1, 2] and r["label_seq"] == [1, 0, 1]
    assert r["attempt_q"] == [3, 1, 1, 1, 2, 2, 0, 0, 0, 0]
    assert r["attempt_labels"] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0]


def test_interactions_and_decode(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    N = 5
    r = E.encode_interactions(df, N, length=5).collect()[0]
    assert r["interactions"] == [0, 0, 3, 6, 2]          # 0 only as padding (Q34)
    r = E.encode_interactions(df, N, length=4).collect()[0]
    assert r["interactions"] == [0, 3, 6, 2]
    a = E.encode_interactions(df, N, length=8, per_attempt=True)
    r = E.positions(E.decode_interactions(a, N)).collect()[0]
    assert r["interactions"] == [0, 0, 3, 6, 6, 6, 7, 2]
    assert r["decoded"] == [0, 0, 3, 1, 1, 1, 2, 2]
    assert r["decoded_shifted"] == [0, 3, 1, 1, 1, 2, 2, 4]
    assert r["positions"] == [2, 3, 4, 5, 6, 7]
    r = E.encode_interactions(df, N, length=3, per_attempt=True).collect()[0]
    assert r["interactions"] == [6, 7, 2]                # keeps the last L


def test_one_hot_and_examples(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = E.one_hot_target(df, 5).collect()[0]
    assert r["target_one_hot"] == [0, 0, 0, 0, 1, 0]
    t = E.training_examples(df, ["student_id"], n_tasks=5).collect()[0]
    # Q24: the task count is the unpadded length
    assert t["task_num"] == 3 and t["snaps_per_task"] == [1, 3, 2, 1, 1]
    assert t["labels_padded"] == [1, 0, 1, 0, 0]


def test_vocabulary_and_map(spark):
    targets = spark.createDataFrame([("9",), ("2",)], "new_task_id string")
    hist = spark.createDataFrame([(["2", "10"],)], "prev_tasks_id array<string>")
    v = {r["task_id"]: r["task_index"] for r in E.task_vocabulary(targets, hist).collect()}
    assert v == {"10": 1, "2": 2, "9": 3}
    df = spark.createDataFrame([("s", ["9", "x", "10"])], "student_id string, ids array<string>")
    vocab = E.task_vocabulary(targets, hist)
    r = E.map_array(df, ["student_id"], "ids", vocab, out="q", default=0).collect()[0]
    assert r["q"] == [3, 0, 1]


def test_code_steps(spark):
    paths = spark.createDataFrame([
        ("s", 1, "name,h1,value@$x,h2,x@$,, "),      # the last entry is too short, its tokens do not count
        ("s", 2, ""),
        ("t", 1, "other,h1,name"),
    ], "student_id string, step long, RawASTPath string")
    nodes, pth = E.path_vocabulary(paths, ["student_id", "step"])
    nv = {r["token"]: r["index"] for r in nodes.collect()}
    assert nv == {"name": 2, "x": 3, "other": 4, "value": 5}      # short tokens of long entries are in it
    assert {r["token"] for r in pth.collect()} == {"h1", "h2"}
    enc = {r["step"]: r for r in E.encode_code_steps(paths.filter("student_id = 's'"), nodes, pth,
                                                        ["student_id", "step"], max_paths=3).collect()}
    assert enc[1]["start_idx"] == [2, 3, E.UNK] and enc[1]["end_idx"] == [5, 3, E.UNK]
    assert enc[2]["path_idx"] == [0, 0, 0]


def test_frequent_tokens_leave_the_shuffle(spark):
    import random
    rng = random.Random(7)
    words = ["hot"] * 40 + ["unseen"] * 30 + [f"w{k}" for k in range(60)] + [""]
    rows = [(k, "@$".join(f"{rng.choice(words)},{rng.choice(words)},{rng.choice(words)}" for _ in range(rng.randrange(12))))
            for k in range(80)] + [(80, None), (81, "hot,unseen,hot")]
    paths = spark.createDataFrame(rows, "code_id int, RawASTPath string").repartition(4)
    names = sorted(set(words) - {"unseen"})
    nodes = spark.createDataFrame([(w, k + 2) for k, w in enumerate(names)], "token string, index long")
    pth = spark.createDataFrame([(w, k + 2) for k, w in enumerate(reversed(names))], "token string, index long")
    entries = E.path_entries(paths, ["code_id"], max_paths=8).collect()
    of_node, of_path = {w: k + 2 for k, w in enumerate(names)}, {w: k + 2 for k, w in enumerate(reversed(names))}
    want = {k: ([0] * 8, [0] * 8, [0] * 8) for k, _ in rows}
    for r in entries:
        for lists, i in zip(want[r["code_id"]], (of_node.get(r["start"], 1), of_path.get(r["path"], 1), of_node.get(r["end"], 1))):
            lists[r["entry"]] = i
    got = E.encode_code_steps(paths, nodes, pth, ["code_id"], max_paths=8).collect()
    assert {r["code_id"]: (r["start_idx"], r["path_idx"], r["end_idx"]) for r in got} == want and len(got) == len(rows)
    # no key of the shuffle holds more than its share, whether the vocabulary knows the token or not
    tokens = spark.range(6000).selectExpr(
        "id", "0 as kind", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null when id % 30 = 2 then 'unseen' "
        "else concat('w', id) end as token")
    vocab = nodes.selectExpr("0 as kind", "token", "index")
    marked = E.mark_frequent(tokens, vocab, share=64)
    most = marked.groupBy("_t", "_s").count().agg({"count": "max"}).first()[0]
    assert marked.count() == 6000 and most <= 2 * 6000 / 64
    by = {r["token"]: r["_index"] for r in marked.select("token", "_index").distinct().collect()}
    assert by["hot"] == of_node["hot"] and by[None] == 1 and by["unseen"] == 1 and by["w5"] is None


def test_code_step_rows(spark):
    df = spark.createDataFrame([("s", [3, 1], [True, False], [["a"], ["b", "c"]])],
                               "student_id string, prev_q array<int>, prev_labels array<boolean>, prev_tasks array<array<string>>")
    rows = E.code_step_rows(df, ["student_id"], 5, length=4).orderBy("step").collect()
    assert [(r["step"], r["interaction"], r["code"]) for r in rows] == [(1, 3, "a"), (2, 6, "b"), (3, 6, "c")]
    last = E.code_step_rows(df, ["student_id"], 5, length=2).orderBy("step").collect()
    assert [(r["step"], r["code"]) for r in last] == [(0, "b"), (1, "c")]
