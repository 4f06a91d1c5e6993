"""Merkle manifest of a table: one tree a group, a tree over the groups, a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.splits import global_rank
from attemptlog.session import cut_lineage

#: Consecutive nodes that become one node of the next level.
FANOUT = 8
#: Groups up to so many are joined by a broadcast, else by a shuffle.
BROADCAST_GROUPS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values, each as its byte count, a colon and its text, or ``-`` if null."""
    def told(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[told(c) for c in values]), 256)


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def _digest(slots: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("", *slots), 256)     # skips the slots that a short run does not have


def _siblings(slots: Sequence[Column], own: int) -> Column:
    """What stands before and behind the own slot among the columns of a run."""
    return F.struct(F.concat_ws("", *slots[:own]).alias("left") if own else F.lit("").alias("left"),
                    F.concat_ws("", *slots[own + 1:]).alias("right") if own + 1 < len(slots) else F.lit("").alias("right"))


def _runs(nodes: DataFrame, payload: Column) -> DataFrame:
    """One row for every run of FANOUT consecutive nodes of a group that has several: the
    children's ``payload`` in the columns c0, c1, ... by slot."""
    slot = F.col("idx") % FANOUT
    return nodes.filter("n > 1").withColumn("_payload", payload) \
        .groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("run"), F.ceil(F.col("n") / FANOUT).alias("m")) \
        .agg(*[F.max(F.when(slot == k, F.col("_payload"))).alias(f"c{k}") for k in range(FANOUT)])


_SLOTS = [F"c{k}" for k in range(FANOUT)]


def _grow(nodes: DataFrame, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs over ``nodes`` (grp, idx, n, hash), and the one node left of each
    group with the number of levels below it (``lev``)."""
    levels, tops = [], None
    for k in range(rounds + 1):
        top = nodes.filter("n = 1").select("grp", F.lit(k).alias("lev"), "hash")
        tops = top if tops is None else tops.unionByName(top)
        if k < rounds:
            level = cut_lineage(_runs(nodes, F.col("hash")).withColumn("hash", _digest([F.col(c) for c in _SLOTS])))
            levels.append(level)
            nodes = level.select("grp", F.col("run").alias("idx"), F.col("m").alias("n"), "hash")
    return levels, tops


def _rounds(n: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Path (siblings level by level up to the root) of every node below the lowest level.
    ``above``: grp, lev, path of each group's top and what goes with it."""
    extra = [c for c in above.columns if c not in ("grp", "lev", "path")]

    def tops(k: int) -> DataFrame:
        return above.filter(F.col("lev") == k).select("grp", F.lit(0).cast("long").alias("idx"), "path", *extra)
    slots = [F.col(c) for c in _SLOTS]
    kids = F.explode(F.filter(F.array(*[
        F.struct((F.col("idx") * FANOUT + k).alias("idx"), F.col(f"c{k}").isNotNull().alias("there"),
                 _siblings(slots, k).alias("own")) for k in range(FANOUT)]), lambda x: x["there"]))
    found = tops(len(levels))
    for k in reversed(range(len(levels))):
        runs = levels[k].select("grp", F.col("run").alias("idx"), *_SLOTS).join(found, ["grp", "idx"])
        found = runs.select("grp", "path", *extra, kids.alias("_k")) \
            .select("grp", F.col("_k.idx").alias("idx"), F.concat(F.array("_k.own"), "path").alias("path"), *extra) \
            .unionByName(tops(k))
    return found


def fold(node: Column, path: Column) -> Column:
    """Root that a node and the siblings on its path give."""
    return F.aggregate(path, node, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def proof_hash(path: Column) -> Column:
    """Hex sha256 of all siblings of a path, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def merkle_manifest(rows: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id",
                    other_leaf: Column | None = None) -> DataFrame:
    """Merkle tree over ``rows``: one tree a ``group``, its leaves ascending by ``order``;
    the groups' subroots, ascending by group, give the root likewise.

    ``leaf`` is each row's hex digest; ``other_leaf`` (null: the leaf itself) is folded with
    the original siblings, which tells whether such a row still gives the root.  Every FANOUT
    consecutive nodes become the digest of their digests; the last run may be shorter.

    Returns one row a row: the ``order`` column, ``leaf``, ``subroot``, ``root``, ``path`` (for each
    level the digests left and right of the own node), ``folded_root``, ``verified``.

    Groups are compared as text, bytewise; a null group is a group and comes first.  Null
    order values come first, equal ones are put in order of leaf and other leaf, so repeated
    rows give the same tree.  A group of one row has its leaf as subroot; one group has
    its subroot as root; an empty table gives an empty result.  Further columns are not read.

    Leaves get their places from range partitions, so a group with most of the rows is dealt
    out.  Then each level is one grouped aggregate that spreads the children of a parent into
    FANOUT columns, a FANOUT-th of the level below; paths go down the same tables, and
    leaves meet their path as runs, not one by one.  The driver gets two row counts.
    """
    named = rows.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("grp"),
                        F.col(order).alias("_key"), leaf.alias("leaf"),
                        (F.lit(None).cast("string") if other_leaf is None else other_leaf).alias("other"),
                        F.monotonically_increasing_id().alias("_tie"))      # deals out rows that are equal in all else
    placed = global_rank(named, ["_key", "leaf", "other", "_tie"], by=["grp"], out="idx").drop("_tie")
    sizes = cut_lineage(placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    most = sizes.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("g")).first()
    n_groups = int(most["g"])
    small = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda t: t)
    leaves = placed.join(small(sizes), "grp")
    rounds, above_rounds = _rounds(int(most["n"] or 0)), _rounds(n_groups)

    # leaves alone in their group, and runs of leaves
    kept = F.struct("leaf", "other", "_key")
    first = cut_lineage(_runs(leaves, kept).withColumn("hash", _digest([F.col(c)["leaf"] for c in _SLOTS])))
    lone = cut_lineage(leaves.filter("n = 1").select("grp", "_key", "leaf", "other"))
    nodes = first.select("grp", F.col("run").alias("idx"), F.col("m").alias("n"), "hash") \
        .unionByName(lone.select("grp", F.lit(0).cast("long").alias("idx"), F.lit(1).cast("long").alias("n"),
                                 F.col("leaf").alias("hash")))
    levels, tops = _grow(nodes, max(rounds - 1, 0))

    # the same over the subroots, as one group
    ranked = global_rank(tops.select(F.col("grp").alias("name"), F.col("lev").alias("below"), "hash"), ["name"], out="idx")
    one = cut_lineage(ranked.select(F.lit("").alias("grp"), "idx", F.lit(n_groups).cast("long").alias("n"), "hash", "name", "below"))
    high, root = _grow(one.select("grp", "idx", "n", "hash"), above_rounds)
    none = F.lit(None).cast("array<struct<left:string,right:string>>")
    start = root.select("grp", "lev", F.coalesce(none, F.expr("array()").cast("array<struct<left:string,right:string>>")).alias("path"),
                        F.col("hash").alias("root"))
    top_paths = _paths(high, start).join(one.select("idx", "name", "below", F.col("hash").alias("subroot")), "idx")
    above = cut_lineage(top_paths.select(F.col("name").alias("grp"), F.col("below").alias("lev"), "path", "root", "subroot"))

    found = _paths(levels, above)
    runs = first.join(found.withColumnRenamed("idx", "run"), ["grp", "run"])
    slots = [F.col(c)["leaf"] for c in _SLOTS]
    kids = F.explode(F.filter(F.array(*[
        F.struct(F.col(f"c{k}").alias("kid"), _siblings(slots, k).alias("own")) for k in range(FANOUT)]),
        lambda x: x["kid"].isNotNull()))
    many = runs.select("path", "root", "subroot", kids.alias("_k")).select(
        F.col("_k.kid._key").alias("_key"), F.col("_k.kid.leaf").alias("leaf"), F.col("_k.kid.other").alias("other"),
        "subroot", "root", F.concat(F.array("_k.own"), "path").alias("path"))
    single = lone.join(small(above), "grp").select("_key", "leaf", "other", "subroot", "root", "path")
    both = many.unionByName(single).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return both.select(F.col("_key").alias(order), "leaf", "subroot", "root", "path", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
