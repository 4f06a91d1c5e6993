"""Language identification: the family first, then one-versus-one SVMs within it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attemptlog.llm import tokens

#: Hashed byte n-grams a text is described by.
FEATURES, ORDERS = 2048, (1, 2, 3)
#: Rows described at once, each by a dense row of features.
SLICE_ROWS = 1024
#: The classifiers are fitted on at most so many rows a language, and in all.
ROWS_PER_LANG, TRAIN_ROWS = 800, 8000
SEED, STEPS, MARGIN_SCALE = 11, 200, 4.0
#: Share of the even spread mixed into a language's n-grams, so that none is impossible.
EVEN_SHARE = 0.05
#: Families by primary language code.  Others are a family of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indoaryan": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "malay": "id jv ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    code = lang.replace("_", "-").split("-")[0].lower()
    return _FAMILY.get(code, f"only {lang}")


_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed byte n-grams of each row's letters: square roots of counts, unit length.

    Bytes that are no letter count as a blank and runs of blanks as one; n-grams
    do not reach over rows.  A row without letters is zero."""
    n = int(offsets[-1])
    x = _LETTERS[data[:n]]
    keep = np.ones(n, bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    x = x[keep].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    hashed = []
    for k in ORDERS:
        m = max(0, len(x) - k + 1)
        h = np.full(m, k, np.uint32)
        for d in range(k):
            h = h * np.uint32(0x01000193) + x[d:m + d]
        h *= np.uint32(0x9E3779B1)
        hashed.append((h >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int64))
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        total = sum(np.bincount(h[a:max(a, b - k + 1)], minlength=FEATURES) for k, h in zip(ORDERS, hashed, strict=True))
        out[row] = np.sqrt(total)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-9)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    n = int(offsets[-1])
    kind = np.zeros(n + 1, np.int64)
    kind[1:] = np.cumsum((data[:n] >= 97) & (data[:n] <= 122))
    plain = kind[offsets[1:]] > kind[offsets[:-1]]
    for k in np.flatnonzero(~plain):
        part = data[offsets[k]:offsets[k + 1]]
        if (part >= 128).any():
            plain[k] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "ignore"))
    return plain


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by accelerated
    gradient steps over all rows; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    w, look, t, rate = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1.0, np.float32(0.2)
    for _ in range(STEPS):
        short = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (np.float32(1e-4) * look - 2 * ((share * y * short) @ x))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look = new + np.float32((old - 1) / t) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """``families``: family names; ``first``: a weight row for each against the rest;
    ``langs`` by family; ``pairs``: weights by two languages of a family; ``known``:
    log ratios of the n-grams by language."""

    families: list[str] = field(default_factory=list)
    first: np.ndarray | None = None
    langs: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    known: dict[str, np.ndarray] = field(default_factory=dict)

    def fit(self, x: np.ndarray, lang: list[str]) -> np.ndarray:
        """How well each row of features fits the language told for it: the mean over
        the row's n-grams of the log of how much likelier they are in that language
        than evenly spread.  Depends on no other language; 0 is chance."""
        out = np.zeros(len(x))
        told = np.array(lang, object)
        for name, ratio in self.known.items():
            rows = np.flatnonzero(told == name)
            out[rows] = x[rows] ** 2 @ ratio            # squares are shares of the n-grams
        return out

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each row of features: the family's share among
        the families times the winner's least confidence against another
        language of it.  Ties go to the first in alphabetical order."""
        if not self.families:
            return ["und"] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if len(self.families) > 1:
            e = np.exp(MARGIN_SCALE * np.clip(x @ self.first.T, -5, 5))
            share = e / e.sum(1, keepdims=True)
        else:
            share = np.ones((len(x), 1))
        best = share.argmax(1)
        lang, score = np.empty(len(x), object), share.max(1)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            of = self.langs[name]
            votes, least = np.zeros((len(rows), len(of))), np.ones((len(rows), len(of)))
            for i, j in combinations(range(len(of)), 2):
                p = 1 / (1 + np.exp(-MARGIN_SCALE * np.clip(x[rows] @ self.pairs[of[i], of[j]], -5, 5)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
            win = (votes + 1e-3 * least).argmax(1)
            lang[rows] = np.array(of, object)[win]
            score[rows] *= least[np.arange(len(rows)), win]
        return lang.tolist(), score


def fit_model(x: np.ndarray, lang: list[str]) -> LanguageModel:
    names = sorted(set(lang))
    lang_of = np.array(lang, object)
    langs: dict[str, list[str]] = {}
    for name in names:
        langs.setdefault(family(name), []).append(name)
    families = sorted(langs)
    of = np.array([family(name) for name in lang], object)
    first = np.array([fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else None
    pairs = {}
    for group in langs.values():
        for a, b in combinations(group, 2):
            rows = np.flatnonzero((lang_of == a) | (lang_of == b))
            pairs[a, b] = fit_svm(x[rows], np.where(lang_of[rows] == a, 1.0, -1.0))
    known = {}
    for name in names:
        share = (x[lang_of == name] ** 2).mean(0)
        known[name] = np.log((1 - EVEN_SHARE) * share * FEATURES + EVEN_SHARE)
    return LanguageModel(families, first, langs, pairs, known)


def learn_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    per_lang: int = ROWS_PER_LANG, total: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on at most ``per_lang`` rows of every non-null language and ``total`` in all,
    drawn by a seeded hash of id and language; of the rows that share both, one is taken,
    by the hash of its text; rows without letters are left out.
    Only their features are brought to the driver."""
    known = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(lang).alias("_lang")).filter("_lang is not null")
    n = known.agg(F.count_distinct("_lang")).first()[0]
    each = max(1, min(per_lang, total // max(n, 1)))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id", F.lit(SEED)), "_id")
    some = known.dropDuplicates(["_id", "_lang"]).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= each) \
        .orderBy("_k", "_lang").limit(total).select("_id", "_lang")
    rows = docs.select(F.col(doc_id).cast("string").alias("_did"), F.col(lang).alias("_dlang"), F.col(text).alias("text"))
    drawn = rows.join(F.broadcast(some), F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dlang") == F.col("_lang"))) \
        .groupBy("_id", "_lang") \
        .agg(F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("h"), "text"))["text"].alias("text")) \
        .select("_lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tokens.slices(batch.column("text"), limit=1 << 20, rows=SLICE_ROWS):
                x, ok = features(data, offsets), has_letter(data, offsets)
                part = batch.slice(lo, hi - lo).column("_lang").filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([part, pa.array([r.tobytes() for r in x[ok]], pa.binary())],
                                                 names=["_lang", "x"])
    got = sorted((r["_lang"], r["x"]) for r in drawn.mapInArrow(run, "_lang string, x binary").collect())
    x = np.array([np.frombuffer(r[1], np.float32) for r in got], np.float32).reshape(len(got), FEATURES)
    return fit_model(x, [r[0] for r in got])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"),
             fit: str | None = None) -> DataFrame:
    """Add the predicted language and a score from 0 to 1, from the whole text alone,
    and as ``fit``, if named, how well the text fits that language.

    Null texts and texts without a letter are ``und`` with score 0 and a null fit, as is
    everything for a model that has learned no language.  Columns named like the
    added ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [*out, fit] if fit else [*out]
    docs = docs.drop(*added)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tokens.slices(batch.column(text), limit=1 << 20, rows=SLICE_ROWS):
                x, ok = features(data, offsets), has_letter(data, offsets)
                lang, score = shared.value.predict(x)
                more = [pa.array(shared.value.fit(x, lang), pa.float64(), mask=~ok | (not shared.value.families))] if fit else []
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names],
                     pa.array([x if good else "und" for x, good in zip(lang, ok.tolist(), strict=True)], pa.string()),
                     pa.array(np.where(ok, score, 0.0), pa.float64()), *more], names=[*names, *added])
    schema = docs.withColumn(out[0], F.lit("")).withColumn(out[1], F.lit(0.0)) \
        .withColumns({c: F.lit(None).cast("double") for c in added[2:]}).schema
    return docs.mapInArrow(run, schema)


def judge(spark: SparkSession, model: LanguageModel) -> Callable[[Column], Column]:
    """A function from a text column to a struct (``lang``, ``score``, ``fit``) as :func:`identify`
    gives them.  Only the text goes to Python and only the struct comes back: the other columns
    of wide rows stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,fit:double>")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            lang, score, fit = [], [], []
            for _, _, data, offsets in tokens.slices(column, limit=1 << 20, rows=SLICE_ROWS):
                x, ok = features(data, offsets), has_letter(data, offsets)
                named, sure = shared.value.predict(x)
                lang += [n if good else "und" for n, good in zip(named, ok.tolist(), strict=True)]
                score.append(np.where(ok, sure, 0.0))
                fit.append(pa.array(shared.value.fit(x, named), pa.float64(), mask=~ok | (not shared.value.families)))
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(np.concatenate([*score, np.zeros(0)])),
                 pa.concat_arrays([*fit, pa.array([], pa.float64())])], names=["lang", "score", "fit"])
    return told
