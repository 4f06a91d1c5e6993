import random

from pyspark.sql import functions as F

from attemptlog.operators.lines import fewest_line_changes, longest_rise, split_lines


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_lines_split_as_python_does(spark):
    texts = [None, "", "a", "a\n", "\n", "a\r\nb\rc", "a\n\nb\n\n", "x\x0by\x0cz\x1cu\x1dv\x1ew\x85t s r"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string") \
        .select("k", split_lines(F.col("t")).alias("l")).collect()
    assert {r["k"]: r["l"] for r in got} == {k: (t or "").splitlines() for k, t in enumerate(texts)}


def test_longest_rise(spark):
    rng = random.Random(3)
    rows = [[], [1], [3, 2, 1], [1, 1, 1]] + [[rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(30)]

    def by_hand(v):
        best = []
        for i, x in enumerate(v):
            best.append(1 + max((best[j] for j in range(i) if v[j] < x), default=0))
        return max(best, default=0)
    got = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v array<int>") \
        .select("k", longest_rise(F.col("v")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {k: by_hand(v) for k, v in enumerate(rows)}


def test_fewest_changes_match_the_full_table(spark):
    rng = random.Random(5)
    fixed = [(None, None), ("", ""), (None, "a\nb"), ("a\nb", ""), ("a\nb\nc", "a\nb\nc"), ("a\nx\nc", "a\ny\nc"), ("a", "b"),
             ("a\na\na", "a\na"), ("a\nb", "b\na"), ("\n\n\n", "\n"), ("a\nb\nc\nd", "d\na\nb\nc")]
    pairs = fixed + [tuple("\n".join(rng.choice("abcd") for _ in range(rng.randrange(14))) for _ in range(2)) for _ in range(120)]
    long = [f"line {k}" for k in range(3000)]
    moved = long[:1000] + ["new"] + long[1200:2000] + long[1100:1150] + long[2000:]
    pairs.append(("\n".join(long), "\n".join(moved)))
    rows = [(None if k == 0 else k, k, p, c, "x") for k, (p, c) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "g int, pos int, prev_code string, code string, deleted string")
    got = {r["pos"]: (r["deleted"], r["inserted"], r["changed"]) for r in fewest_line_changes(df, ["g", "pos"]).collect()}
    want = {}
    for k, (p, c) in enumerate(pairs[:-1]):
        a, b = (p or "").splitlines(), (c or "").splitlines()
        n = lcs(a, b)
        want[k] = (len(a) - n, len(b) - n, max(len(a) - n, len(b) - n))
    want[len(pairs) - 1] = (200, 51, 200)
    assert got == want


def test_empty_table_and_one_shuffle(spark):
    df = spark.createDataFrame([], "g int, code string, prev_code string, role string")
    out = fewest_line_changes(df, ["g"], carry=["role"])
    assert out.columns == ["g", "role", "deleted", "inserted", "changed"] and out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
