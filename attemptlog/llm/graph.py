"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node of ``edges`` (columns ``src``, ``dst``).

    Alternating large-star and small-star rounds: each round hangs the
    neighbours of a node on the least of them.  The least neighbour is a
    map-side-combined aggregate joined back to the edges, so a node with very
    many neighbours is never gathered into one row and its join partition can
    be split.  Every round is written to the shared folder; nothing but a row
    count and a hash sum reaches the driver.

    Returns ``node``, ``component`` (the least node reachable), one row per node
    that has an edge to another node.  Self-loops, nulls and repeated edges are
    ignored; an empty edge list gives an empty result.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"),
                     (F.col("src").isNull() | F.col("dst").isNull()).alias("_null")) \
        .filter(~F.col("_null") & (F.col("u") != F.col("v"))).drop("_null").distinct()
    e = cut_lineage(e)
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")) \
            .select("u", F.least("u", "m").alias("m"))
        large = sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(hang.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
