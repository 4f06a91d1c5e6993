"""Fewest changed lines between consecutive snapshots (D3, F6, F7) as a Spark plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line, as in Python's ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def split_lines(text: Column) -> Column:
    """Lines of a text without their ends; null and empty have none, and a break at
    the end starts no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _equal_ahead(a: Column, b: Column, most: Column) -> Column:
    """How many leading entries of two arrays are equal, ``most`` at most."""
    differ = F.array_position(F.zip_with(F.slice(a, 1, most), F.slice(b, 1, most), lambda x, y: x == y), F.lit(False))
    return F.when(differ > 0, differ.cast("int") - 1).otherwise(most)


def longest_rise(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence of an int array: the
    least last value of a rise of each length is kept and replaced."""
    def step(ends: Column, x: Column) -> Column:
        below = F.array(F.size(F.filter(ends, lambda e: e < x)))
        return F.transform(below, lambda k: F.concat(
            F.slice(ends, F.lit(1), k), F.array(x), F.slice(ends, k + 2, F.size(ends))))[0]
    return F.aggregate(values, F.array().cast("array<int>"), step, F.size)


def fewest_line_changes(rows: DataFrame, key: Sequence[str], text: str = "code", prev_text: str = "prev_code",
                        carry: Sequence[str] = ()) -> DataFrame:
    """``key``, ``carry``, ``deleted``, ``inserted`` and ``changed`` lines of every row.

    A shortest edit leaves as many lines as the longest common subsequence of both
    texts has.  Equal heads and tails are cut in place; only what is left between
    them is exploded, and one shuffle by ``key`` brings equal lines of a row
    together.  Each pair of places of a common line is a point; the longest
    rising run over the points, by place in the old text and from the last to the
    first in the new one, is the longest common subsequence.  A row's arrays are
    bounded by its own two texts: a line that stands r and s times between head
    and tail gives r * s points.

    ``changed`` is the larger of both counts (Q19).  ``key`` has to be unique in a
    row (nulls are values); repeated keys raise no error but are counted as one.
    Null texts have no lines.  An empty table gives an empty table.
    """
    keep = [*key, *carry]
    a, b, r = F.col("_a"), F.col("_b"), F.col("_rest")
    d = rows.select(*keep, split_lines(F.col(prev_text)).alias("_a"), split_lines(F.col(text)).alias("_b"))
    d = d.withColumn("_most", F.least(F.size(a), F.size(b)))
    d = d.withColumn("_head", _equal_ahead(a, b, F.col("_most")))
    d = d.withColumn("_rest", F.col("_most") - F.col("_head"))
    d = d.withColumn("_tail", _equal_ahead(F.reverse(a), F.reverse(b), r))

    def middle(x: Column, old: bool) -> Column:
        inner = F.slice(x, F.col("_head") + 1, F.size(x) - F.col("_head") - F.col("_tail"))
        return F.transform(inner, lambda line, i: F.struct(line.alias("line"), F.lit(old).alias("old"), i.cast("int").alias("place")))
    settled = F.col("_tail") == F.col("_rest")              # one of the middles is empty
    e = d.select(*keep, F.size(a).alias("_na"), F.size(b).alias("_nb"), (F.col("_head") + F.col("_tail")).alias("_same"),
                 F.explode_outer(F.when(~settled, F.concat(middle(a, True), middle(b, False)))).alias("_x"))
    own = [*keep, "_na", "_nb", "_same"]
    x = F.col("_x")
    places = e.repartition(*key).groupBy(*own, x["line"].alias("_line")).agg(
        F.collect_list(F.when(x["old"], x["place"])).alias("_p"), F.collect_list(F.when(~x["old"], x["place"])).alias("_q"))
    points = F.flatten(F.transform("_p", lambda p: F.transform("_q", lambda q: F.struct(p.alias("p"), (-q).alias("q")))))
    found = places.select(*own, points.alias("_points")).groupBy(*own).agg(F.flatten(F.collect_list("_points")).alias("_points"))
    common = F.col("_same") + longest_rise(F.transform(F.sort_array("_points"), lambda s: -s["q"]))
    out = found.select(*keep, (F.col("_na") - common).alias("deleted"), (F.col("_nb") - common).alias("inserted"))
    return out.withColumn("changed", F.greatest("deleted", "inserted"))
