"""The Python-side jobs (D1-D6, A29, S5): the only places where Python sees rows.

Each runs inside Spark tasks on Arrow batches (``pandas_udf`` / ``mapInPandas``)
or in Spark ML; the user-supplied function (an encoder, a scorer) is loaded
once per task.  The per-row helpers here are small defaults, not libraries.
"""

from __future__ import annotations

import ast
import difflib
import hashlib
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Distinct snippets and their embeddings
# ---------------------------------------------------------------------------


def distinct_snippets(df: DataFrame, col: str = "prev_tasks") -> DataFrame:
    """Every distinct code snippet of a nested (tasks x snapshots) column,
    de-duplicated before any expensive per-snippet work."""
    return df.select(F.explode(F.flatten(col)).alias("code")).filter(F.col("code").isNotNull()).distinct()


def _spread(df: DataFrame, *cols) -> DataFrame:
    """Hash-spread the input of a CPU-bound Python job over
    ``spark.sql.shuffle.partitions`` tasks (AQE would otherwise coalesce a
    small-in-bytes input into one Python worker)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols) if cols else df.repartition(n)


def hashed_token_vector(text, dim: int = 64):
    """Default encoder: L2-normalised counts of hashed lower-case word tokens, as a
    column expression of built-in functions."""
    toks = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    slots = F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))

    def counts(s):
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(s, lambda v: v == k)).cast("double"))

    def scaled(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float")))[0]
    # a one-element array binds a value to a lambda, which then does not make it anew for each use
    return F.transform(F.transform(F.array(slots), counts), scaled)[0]


def embed_texts(snippets: DataFrame, fn: Callable[[list], list] | None = None,
                dim: int = 64, col: str = "code") -> DataFrame:
    """``(code) -> (code, vector)``.

    ``fn`` maps a list of texts to a list of vectors (a batch call into a
    model loaded once per task) and runs in ``mapInPandas``; the default,
    :func:`hashed_token_vector`, needs no Python.  Batch size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    if fn is None:
        return snippets.select(col, hashed_token_vector(F.col(col), dim).alias("vector"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[col].fillna("").tolist()
            vecs = fn(texts)
            yield pd.DataFrame({col: b[col], "vector": [list(map(float, v)) for v in vecs]})
    schema = T.StructType([T.StructField(col, T.StringType()),
                           T.StructField("vector", T.ArrayType(T.FloatType()))])
    return _spread(snippets.select(col), col).mapInPandas(run, schema)


def load_embeddings(frames: Sequence[DataFrame], key: str = "code") -> DataFrame:
    """Several embedding tables merged, the later table wins on a key."""
    out = None
    for rank, f in enumerate(frames):
        f = f.withColumn("_rank", F.lit(rank))
        out = f if out is None else out.unionByName(f)
    return out.groupBy(key).agg(F.max_by("vector", "_rank").alias("vector"))


# ---------------------------------------------------------------------------
# D3: line diff of consecutive snapshots
# ---------------------------------------------------------------------------


def _diff_counts(a: str | None, b: str | None, count_headers: bool) -> tuple[int, int]:
    a_lines = (a or "").splitlines()
    b_lines = (b or "").splitlines()
    deleted = inserted = 0
    for k, line in enumerate(difflib.unified_diff(a_lines, b_lines)):
        if k < 2 and not count_headers:     # a non-empty diff starts with its two header lines
            continue
        if line.startswith("-"):
            deleted += 1
        elif line.startswith("+"):
            inserted += 1
    return deleted, inserted


def line_diff(prev, curr, count_headers: bool = False):
    """D3: (deleted, inserted) line counts of a unified diff, Arrow-batched.

    ``count_headers=True`` also counts the ``---``/``+++`` header lines of a
    non-empty diff, the literal behaviour (Q18)."""
    out_type = T.StructType([T.StructField("deleted", T.IntegerType()),
                             T.StructField("inserted", T.IntegerType())])

    @F.pandas_udf(out_type)
    def _udf(p: pd.Series, c: pd.Series) -> pd.DataFrame:
        res = [_diff_counts(x, y, count_headers) for x, y in zip(p, c)]
        return pd.DataFrame(res, columns=["deleted", "inserted"])
    prev = F.col(prev) if isinstance(prev, str) else prev
    curr = F.col(curr) if isinstance(curr, str) else curr
    return _udf(prev, curr)


def line_changes(rows: DataFrame, text: str = "code", prev_text: str = "prev_code",
                 count_headers: bool = False) -> DataFrame:
    """D3 + F7: per consecutive pair, deleted, inserted and changed lines
    (elementwise ``greatest``, Q19).  ``rows`` are sequenced rows carrying the
    previous snapshot (``prev_<text>``); the first attempt has no pair."""
    r = rows.filter(F.col("pos") > 1).withColumn("_d", line_diff(prev_text, text, count_headers))
    return r.withColumn("deleted", F.col("_d.deleted")).withColumn("inserted", F.col("_d.inserted")) \
            .withColumn("changed", F.greatest("deleted", "inserted")).drop("_d")


# ---------------------------------------------------------------------------
# Leaf-to-leaf AST paths of Python code
# ---------------------------------------------------------------------------

# Extraction limits and the marker program used when code does
# not parse.
MAX_PATH_LENGTH = 10
MAX_PATH_WIDTH = 5
FALLBACK_PROGRAM = "def fallback():\n    return 0\n"


def _tree(code: str):
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ast.parse(FALLBACK_PROGRAM)


def _label(node) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant):
        return repr(node.value)
    if isinstance(node, ast.arg):
        return node.arg
    if isinstance(node, ast.alias):
        return node.name
    if isinstance(node, ast.Attribute):
        return node.attr
    return type(node).__name__


def _leaves(tree) -> list[tuple[str, list]]:
    """(token, root-to-leaf list of (node type, child number)) in document order."""
    out = []

    def walk(node, trail):
        kids = list(ast.iter_child_nodes(node))
        if not kids or isinstance(node, (ast.Name, ast.Constant, ast.arg, ast.alias)):
            out.append((_label(node), trail + [(type(node).__name__, None)]))
            return
        for i, k in enumerate(kids, start=1):
            walk(k, trail + [(type(node).__name__, i)])
    walk(tree, [])
    return out


def _escape(tok: str) -> str:
    # a token may hold the field or entry separators: percent-encode them
    return tok.replace("%", "%25").replace(",", "%2C").replace("@$", "%40$")


def path_strings(code: str, max_len: int = MAX_PATH_LENGTH, max_width: int = MAX_PATH_WIDTH) -> list[str]:
    """``start,md5(path),end`` for every leaf pair within the limits.

    For a fixed left leaf, the common ancestor with leaves further right can
    only move up, and the path is at least (depth of the left leaf - depth of
    the ancestor) long, so the scan to the right stops once that bound passes
    ``max_len``: the result is the same as checking every pair."""
    leaves = _leaves(_tree(code))
    out = []
    for i in range(len(leaves)):
        ta, pa = leaves[i]
        for j in range(i + 1, len(leaves)):
            tb, pb = leaves[j]
            k = 0
            while k < min(len(pa), len(pb)) and pa[k] == pb[k]:
                k += 1
            if k >= len(pa) or k >= len(pb):
                continue
            if len(pa) - k > max_len:
                break
            # pa[k] / pb[k] is the common ancestor (same node, different child)
            anc = pa[k][0]
            up = [t for t, _ in reversed(pa[k + 1:])]
            down = [t for t, _ in pb[k + 1:]]
            tokens = up + [anc] + down
            if len(tokens) > max_len:
                continue
            width = abs((pa[k][1] or 0) - (pb[k][1] or 0))
            if width > max_width:
                continue
            h = hashlib.md5("|".join(tokens).encode("utf-8")).hexdigest()
            out.append(f"{_escape(ta)},{h},{_escape(tb)}")
    return out


def _paths_or_none(code: str, max_len: int, max_width: int) -> list[str]:
    """No paths for a snippet nested too deeply to walk; one such row must not end
    the job."""
    try:
        return path_strings(code, max_len, max_width)
    except RecursionError:
        return []


def ast_paths(df: DataFrame, code: str = "code", key: Sequence[str] = ("code_id",),
              max_len: int = MAX_PATH_LENGTH, max_width: int = MAX_PATH_WIDTH,
              sep: str = "@$") -> DataFrame:
    """``RawASTPath`` text per code snippet (entries joined by ``@$``).

    Run on distinct snippets; join the result back to the attempts."""
    key = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [sep.join(_paths_or_none(c or "", max_len, max_width)) for c in b[code]]
            yield b[key].assign(RawASTPath=paths, n_paths=[p.count(sep) + 1 if p else 0 for p in paths])
    fields = [df.schema[k] for k in key] + [T.StructField("RawASTPath", T.StringType()),
                                            T.StructField("n_paths", T.LongType())]
    return _spread(df.select(*key, code), *key).mapInPandas(run, T.StructType(fields))


# ---------------------------------------------------------------------------
# Rubric scorer
# ---------------------------------------------------------------------------


def canned_scorer(prompts: list) -> list:
    """Default scorer: deterministic answers in four styles derived from the
    prompt length L (three spellings of the JSON keys, and one answer with no
    JSON at all); scores are L % 5 + 1, (L // 5) % 5 + 1, (L // 25) % 5 + 1."""
    out = []
    for p in prompts:
        n = len(p or "")
        d, a, r = n % 5 + 1, (n // 5) % 5 + 1, (n // 25) % 5 + 1
        style = (n // 2) % 4
        if style == 0:
            out.append(f'Scores: {{"Decomposition": {d}, "Algorithmic Design": {a}, '
                       f'"Reading Comprehension": {r}}} done.')
        elif style == 1:
            out.append(f'```json\n{{"decomposition": {d}, "algorithmic_design": {a}, '
                       f'"reading_comprehension": {r}}}\n```')
        elif style == 2:
            out.append(f'{{"decomposition": {d}, "algorithmic_design": 0, '
                       f'"algorithmic design": {a}, "reading comprehension": {r}}}')
        else:
            out.append("I cannot score this submission.")
    return out


def score_rubric(inputs: DataFrame, fn: Callable[[list], list] | None = None,
                 prompt: str = "prompt", attempt: int = 0) -> DataFrame:
    """Prompts -> raw answers with ``mapInPandas``; ``fn`` is a batch call
    into a model loaded once per task (default :func:`canned_scorer`)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = fn or canned_scorer
        for b in batches:
            yield b.assign(answer=scorer(b[prompt].tolist()), attempt=attempt)
    schema = T.StructType(list(inputs.schema.fields) + [
        T.StructField("answer", T.StringType()), T.StructField("attempt", T.IntegerType())])
    return _spread(inputs).mapInPandas(run, schema)


# ---------------------------------------------------------------------------
# Distributed struggle classifier and its tuning
# ---------------------------------------------------------------------------


def fit_struggle(df: DataFrame, features: Sequence[str], label: str = "Label",
                 fold: str = "fold", reg: float = 0.0, max_iter: int = 50,
                 materialize: bool = True) -> DataFrame:
    """Per fold, fit a logistic regression on the other folds and score the
    held-out fold.  Returns (fold, y_true, y_prob) rows for the metric operators.

    The feature table is written once to the checkpoint folder before the fold
    loop, so the k fits read it instead of re-running the feature plan."""
    from attemptlog.session import cut_lineage
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = df.select(*features, label, fold).withColumn("_y", F.col(label).cast("double"))
    if materialize:
        data = cut_lineage(data)
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())  # k small values
    outs = []
    for k in folds:
        train = data.filter(F.col(fold) != k)
        test = data.filter(F.col(fold) == k)
        pipe = Pipeline(stages=[
            VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"),
            LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg, maxIter=max_iter)])
        model = pipe.fit(train)
        pred = model.transform(test).select(
            F.col(fold), F.col("_y").alias("y_true"),
            vector_to_array("probability")[1].alias("y_prob"))
        outs.append(pred)
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def tune_struggle(df: DataFrame, features: Sequence[str], grid: Sequence[float] = (0.0, 0.01, 0.1),
                  label: str = "Label", fold: str = "fold") -> DataFrame:
    """Grid over the regularisation strength, scored by 1 - mean fold AUC."""
    from attemptlog.operators.metrics import average_over_groups, roc_auc
    from attemptlog.session import cut_lineage
    data = cut_lineage(df.select(*features, label, fold))
    rows = None
    for reg in grid:
        pred = fit_struggle(data, features, label, fold, reg=reg, materialize=False)
        auc = average_over_groups(roc_auc(pred, [fold])).select(
            F.lit(float(reg)).alias("reg"), (1 - F.col("roc_auc")).alias("objective"))
        rows = auc if rows is None else rows.unionByName(auc)
    return rows
