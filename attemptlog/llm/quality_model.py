"""Quality classifier on random-indexing word vectors pooled per document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.llm import gather, tokens

#: Hashed vocabulary: the first SYMBOLS entries are runs of symbols, the last of those a repeated word.
VOCAB, SYMBOLS = 8192, 256
REPEAT = SYMBOLS - 1
DIM, NONZERO, WINDOW = 32, 4, 2
HIDDEN, EPOCHS, BATCH, SEED = 32, 40, 256, 7
#: The net is fitted on at most so many labelled rows, drawn by a seeded hash.
TRAIN_ROWS = 20_000
#: Tokens pooled at once.
CHUNK = 1 << 16
#: Tokens whose neighbours are counted at once.
COUNT_CHUNK = 1 << 20
SYMBOL_BYTE = tokens.NOT_SPACE & ~tokens.WORD_BYTE


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number of each word and symbol run in order of place, and each
    row's first.  A word equal to the word before it is the repeat token."""
    s, e, first = tokens.word_spans(data, offsets, tokens.WORD_BYTE)
    h = tokens.word_hashes(data, s, e)
    word = (h % np.uint64(VOCAB - SYMBOLS)).astype(np.int64) + SYMBOLS
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    word[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])] = REPEAT
    s2, e2, _ = tokens.word_spans(data, offsets, SYMBOL_BYTE)
    sign = (tokens.word_hashes(data, s2, e2) % np.uint64(SYMBOLS - 1)).astype(np.int64)
    at = np.concatenate([s, s2])
    order = np.argsort(at, kind="stable")
    return np.concatenate([word, sign])[order], np.searchsorted(at[order], offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary vector of each vocabulary entry: places and signs."""
    rng = np.random.default_rng(SEED)
    place = np.argsort(rng.random((VOCAB, DIM)), axis=1)[:, :NONZERO]
    sign = np.where(rng.random((VOCAB, NONZERO)) < 0.5, -1, 1)
    return place, sign


def count_contexts(ids: np.ndarray, first: np.ndarray, into: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Add to ``into`` (VOCAB x (DIM + 1), flat) the index vectors of the neighbours of
    every token within its row, and in the last column its uses."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    wide = DIM + 1
    into += np.bincount(ids * wide + DIM, minlength=len(into))
    for lo in range(0, len(ids), COUNT_CHUNK):
        for gap in range(1, WINDOW + 1):
            a = np.arange(lo, max(lo, min(lo + COUNT_CHUNK, len(ids) - gap)))
            a = a[row[a] == row[a + gap]]
            for here, there in ((ids[a], ids[a + gap]), (ids[a + gap], ids[a])):
                for k in range(NONZERO):
                    into += np.bincount(here * wide + place[there, k], weights=sign[there, k],
                                        minlength=len(into)).astype(np.int64)


def word_vectors(counts: np.ndarray) -> np.ndarray:
    """Centred unit vectors of context and, scaled by rarity, of the entries' own
    index vectors; entries never seen are zero."""
    table = counts.reshape(VOCAB, DIM + 1).astype(np.float64)
    uses = table[:, DIM]
    context = table[:, :DIM] / np.maximum(uses, 1)[:, None]
    mean = (context * uses[:, None]).sum(0) / max(uses.sum(), 1)
    context = np.where(uses[:, None] > 0, context - mean, 0)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    place, sign = index_vectors()
    own = np.zeros((VOCAB, DIM))
    np.put_along_axis(own, place, sign / np.sqrt(NONZERO), axis=1)
    own[SYMBOLS:] = 0       # words are told by context, symbols also by themselves
    own *= (uses > 0)[:, None]
    return np.hstack([context, own]).astype(np.float32)


def pool(ids: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each row's tokens, and the logarithm of their number."""
    n = len(first) - 1
    total = np.zeros((n, vectors.shape[1]))
    row = np.repeat(np.arange(n), np.diff(first))
    for lo in range(0, len(ids), CHUNK):
        part = row[lo:lo + CHUNK]
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        total[part[heads]] += np.add.reduceat(vectors[ids[lo:lo + CHUNK]], heads, axis=0)
    size = np.diff(first)
    return np.hstack([total / np.maximum(size, 1)[:, None], np.log1p(size)[:, None] / 10])


@dataclass
class Net:
    """Two-layer network with standardised input and a calibrated temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_net(x: np.ndarray, y: np.ndarray) -> Net:
    """Fit with Adam on four fifths of the rows, then set the temperature that gives
    the least log loss on the last fifth.  Without rows the score is 0.5, with one
    class only that class's share."""
    d = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Net(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, fit = order[:len(y) // 5], order[len(y) // 5:]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = (x - mean) / scale
    params = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
              np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        rows = rng.permutation(fit)
        for lo in range(0, len(rows), BATCH):
            b = rows[lo:lo + BATCH]
            pre = z[b] @ params[0] + params[1]
            hid = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hid @ params[2] + params[3], -30, 30)))
            g = (p - y[b]) / len(b)
            back = np.outer(g, params[2]) * (pre > 0)
            grads = [z[b].T @ back + 1e-4 * params[0], back.sum(0), hid.T @ g + 1e-4 * params[2], g.sum(keepdims=True)]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad ** 2
                params[k] -= 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net = Net(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    raw = net.logits(x[held])

    def loss(t: float) -> float:
        q = np.clip(1 / (1 + np.exp(-np.clip(raw / t, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean())
    net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return net


def learn_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing vectors over every token of every document."""
    place, sign = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(VOCAB * (DIM + 1), np.int64)
        for batch in batches:
            for _, _, data, offsets in tokens.slices(batch.column("text")):
                ids, first = token_stream(data, offsets)
                count_contexts(ids, first, counts, place, sign)
        yield pa.RecordBatch.from_arrays(list(gather.pieces(counts)), names=["part", "counts"])
    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "part int, counts binary")
    return word_vectors(gather.add_up(parts, VOCAB * (DIM + 1)))


def learn_net(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train_rows: int = TRAIN_ROWS, label: str = "quality",
              doc_id: str = "doc_id", text: str = "text") -> Net:
    """Fit the net on at most ``train_rows`` of ``labels`` (all if there are fewer), drawn
    by a seeded hash of the id; only those rows are brought to the driver, pooled."""
    some = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).dropna() \
        .groupBy("_id").agg(F.min("_y").alias("_y")) \
        .orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(train_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(some), "_id")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tokens.slices(batch.column("text")):
                x = pool(*token_stream(data, offsets), shared.value)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"),
                                                  pa.array([r.astype(np.float64).tobytes() for r in x], pa.binary())],
                                                 names=["_id", "_y", "x"])
    schema = f"_id {dict(rows.dtypes)['_id']}, _y int, x binary"
    got = sorted(rows.select("_id", "_y", "text").mapInArrow(run, schema).collect(), key=lambda r: (r["_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), vectors.shape[1] + 1)
    return fit_net(x, np.array([r["_y"] for r in got], float))


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Net, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability of label 1, from the whole text alone.

    Null and empty texts get the score of a document without tokens.  A column
    named like ``out`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    docs = docs.drop(out)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in tokens.slices(batch.column(text)):
                score = model.score(pool(*token_stream(data, offsets), vec))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(score, pa.float64())],
                                                 names=[*names, out])
    schema = docs.withColumn(out, F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)
