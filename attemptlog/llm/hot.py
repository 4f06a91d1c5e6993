"""Joining rows back to a table of their groups when single groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.session import cut_lineage

#: A group with more than this share of the rows is hot; there are fewer than 1 / HOT_SHARE such groups.
HOT_SHARE = 0.001


def attach(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` and ``groups`` (one row a value of ``key``, with the number of its
    rows in ``count``).  Rows of hot groups meet them by a broadcast, whose size is bounded
    by the share that makes a group hot; only the others are shuffled.  The key must not be null."""
    groups = cut_lineage(groups)
    total = groups.agg(F.sum(count).alias("n")).first()["n"] or 0
    is_hot = F.col(count) > HOT_SHARE * total
    hot = F.broadcast(groups.filter(is_hot).drop(count))
    rest = groups.filter(~is_hot).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))
