"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attemptlog.operators.splits import global_rank
from attemptlog.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the sampling hash that name a slice of a source's documents.
SLICE = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Weights repeated over the sources by code point, null last."""
    keyed = sources.select("source", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("_key"))
    ranked = global_rank(keyed, ["_key"], out="_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    return ranked.select("source", w.alias("weight"))


def water_fill(sizes: DataFrame, max_epochs: float = 3.0, share: float = 1.0, max_rounds: int = 1000) -> DataFrame:
    """Target of every source: ``share`` of all sizes dealt out by weight, no
    target above ``max_epochs`` times the source's size.

    ``sizes`` has ``source``, ``source_size``, ``weight``.  Sources whose part
    would be above their limit are clamped to it, what they leave is dealt out
    again by weight, until none is above.  A round is one aggregate over the
    table of sources that gives a single row; the level only rises, and a round
    that clamps no further source ends the loop.  If all are clamped, targets are
    the limits.  Adds ``target``; an empty table gives an empty result.
    """
    cap = F.col("source_size") * float(max_epochs)
    total = float(share) * float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    for _ in range(max_rounds):
        over = cap < F.col("weight") * F.lit(level) if clamped >= 0 else F.lit(False)
        r = sizes.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
                      F.sum(F.when(over, 1).otherwise(0))).first()
        if not r[1]:
            level = float("inf")
            break
        if r[2] == clamped:
            break
        level, clamped = (total - r[0]) / r[1], r[2]
    else:
        raise RuntimeError(f"no feasible level in {max_rounds} rounds")
    if level == float("inf"):
        return sizes.withColumn("target", cap)
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def document_uid(doc_id: Column, text: Column, seed: int = 17) -> Column:
    """Seeded md5 of id and text, the key that documents are drawn by."""
    return F.md5(F.concat_ws("\x01", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")),
                             F.coalesce(F.md5(text.cast("binary")), F.lit("null"))))


def measure(docs: DataFrame, seed: int = 17, doc_id: str = "doc_id", text: str = "text",
            source: str = "source") -> DataFrame:
    """One narrow row a document: ``doc_id``, ``source``, ``size`` in words, ``uid``.
    Written to the shared folder, so that the texts are read once."""
    return cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        document_uid(F.col(doc_id), F.col(text), seed).alias("uid")))


def plan_mix(measured: DataFrame, weights=(1, 2, 3), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """What the mix takes of each source, one row a source.

    Adds to ``source`` its ``source_size``, ``target``, ``whole`` (times that all its
    documents are taken) and ``cut``: documents with words and a ``uid`` up to it are
    taken once more (null: none).

    A source repeats target / source_size times: every document as often as that
    has whole repetitions; the remaining fraction takes documents in the order
    of their seeded hash until their words come nearest to the target.  Slices of the
    hash (4096 a source) are summed first, the slice in which the target falls
    is sliced again, and only one of those is ordered: a 16-millionth of a source.

    Null sources are one source, weighed last; sources without words have target 0.
    Rows with the same id and text are taken alike.  An empty table gives an empty
    plan.
    """
    sizes = cut_lineage(measured.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = cycling_weights(sizes, weights)
    weighed = cut_lineage(sizes.join(w, sizes["source"].eqNullSafe(w["source"]))
                          .select(sizes["source"], "source_size", "weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut_lineage(water_fill(weighed, max_epochs, share).withColumn("whole", whole)
                       .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")))

    def slices(rows: DataFrame, at: int) -> DataFrame:
        """Words of each slice of the hash and of those before it, against the words
        still wanted: full slices, and the one that the target falls into."""
        s = rows.groupBy("source", F.substring("uid", at, SLICE).alias("slice")).agg(
            F.sum("size").alias("n"), F.max("uid").alias("last"), F.first("part").alias("part"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")
        s = s.withColumn("before", before).withColumn("full", F.col("before") + F.col("n") <= F.col("part"))
        return cut_lineage(s.withColumn("edge", ~F.col("full") & (F.col("before") < F.col("part"))))

    def into(rows: DataFrame, s: DataFrame, at: int) -> DataFrame:
        """The rows of the slice that the target falls into, and what it still takes."""
        edge = s.filter("edge").select(F.col("source").alias("_s"), "slice", (F.col("part") - F.col("before")).alias("part"))
        return rows.drop("part").join(edge, F.col("source").eqNullSafe(F.col("_s")) & (
            F.substring("uid", at, SLICE) == F.col("slice"))).drop("_s", "slice")

    rows = measured.select("source", "size", "uid").filter("size > 0")
    parts = plan.select(F.col("source").alias("_s"), "part").filter("part > 0")
    one = slices(rows.join(parts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), 1)
    rest = into(rows, one, 1)
    two = slices(rest, 1 + SLICE)
    alike = into(rest, two, 1 + SLICE).groupBy("source", "uid").agg(F.sum("size").alias("n"), F.first("part").alias("part"))
    order = Window.partitionBy("source").orderBy("uid")
    nearest = alike.withColumn("before", F.sum("n").over(order) - F.col("n")) \
        .filter(F.col("before") + F.col("n") / 2 < F.col("part"))
    taken = one.filter("full").select("source", "last").unionByName(two.filter("full").select("source", "last")) \
        .unionByName(nearest.select("source", F.col("uid").alias("last")))
    cut = taken.groupBy(F.col("source").alias("_s")).agg(F.max("last").alias("cut"))
    return cut_lineage(plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
                       .select("source", "source_size", "target", "whole", "cut"))


def copies_of(rows: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows with ``size`` and ``uid``."""
    p = plan.withColumnRenamed("source", "_s")
    extra = F.when((F.col("size") > 0) & (F.col("uid") <= F.col("cut")), 1).otherwise(0)
    return rows.join(p, F.col(source).eqNullSafe(F.col("_s"))) \
        .withColumn("copies", (F.col("whole") + extra).cast("long")).drop("_s", "whole", "cut")
