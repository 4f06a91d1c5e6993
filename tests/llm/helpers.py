"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names that operators use inside or add; the tables here have them as extra columns.
CLASH = ["n", "part", "hits", "n_words", "copies", "slot", "shard", "component_id", "score", "lang_pred", "rule",
         "verdict", "kept", "pii", "uid", "cut", "gid", "cls", "counts"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs_frame(spark, texts, langs=None, sources=None, ids=None, parts=3):
    n = len(texts)
    rows = [(i if ids is None else ids[i], t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(t or ""))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})
