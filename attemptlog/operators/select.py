"""Exact order statistics by radix selection: counters instead of sorted values.

Every value gets a 64-bit key in the order of the values.  A grouped count over the leading
bits of the keys tells which prefix holds a wanted rank; a second and a third
count refine it inside that prefix alone.  A counter table has at most 2**22 rows a group
and column at each step, is combined map-side, and nothing is range-sorted or written: all
columns, groups and ranks are answered by three aggregates over one count of the distinct
values, whose shuffle they share.  The plan is one SQL statement, analysed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a key that the second and the third step look at; the first has the other 22.
STEP = 21
_MASK = (1 << STEP) - 1
_INFINITE = 0x7FF << 52


def order_key(c: str, kind: T.DataType) -> str:
    """SQL of a long that orders like the value: the value itself for integers; for floating
    point exponent and fraction, by exact arithmetic, negated for negative values (-0.0 is 0.0,
    NaN comes last, as in Spark's order)."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"bigint({c})"
    a, guess = f"abs({c})", f"greatest(floor(log2(abs({c}))), -1022)"
    # a power of two scales exactly; the logarithm may be off by one
    e = f"({guess} + CASE WHEN {a} * pow(2D, -{guess}) >= 2 THEN 1 WHEN {a} * pow(2D, -{guess}) < 1 AND {guess} > -1022 THEN -1 ELSE 0 END)"
    bits = f"shiftleft(bigint({e} + 1022), 52) + bigint({a} * pow(2D, -{e}) * {float(1 << 52)!r}D)"
    return (f"(CASE WHEN isnan({c}) THEN {_INFINITE + 1}L WHEN {a} = double('inf') THEN {_INFINITE}L WHEN {a} = 0 THEN 0L "
            f"ELSE {bits} END) * CASE WHEN {c} < 0 THEN -1L ELSE 1L END")


def _holding(table: str, part: str, digit: str, kept: str) -> str:
    """Rows of counters whose digit holds the rank, with what is smaller added up."""
    over = f"OVER (PARTITION BY {part} ORDER BY {digit} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (f"SELECT {kept}, {digit}, _rank, _lower AS _before, _less AS _below FROM (SELECT *, _before + coalesce(sum(_n) {over}, 0) AS _lower, "
            f"_below + coalesce(sum(_s) {over}, 0D) AS _less FROM {table}) WHERE _lower <= _rank AND _rank < _lower + _n")


def select_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str], ranks: Sequence[str],
                 carry: DataFrame | None = None) -> DataFrame:
    """The values at some ranks of each column in each group.

    ``ranks`` are SQL expressions of ``_total``, the number of values, for the 0-based ranks wanted;
    ranks that there are not are left out.  ``carry`` (one row) adds columns that ``ranks`` may use; they are
    returned as well.

    Returns the group, ``_c`` (position of the column), ``_t`` (position of the rank), ``_value``,
    ``_rank``, ``_total`` (number of values), ``_before`` and ``_below`` (number and sum of the smaller
    values).  NULL is a group like any other; NULL values do not count; an empty table gives none."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    g = "".join(f"`{c}`, " for c in by)

    def same(a: str, b: str, *more: str) -> str:
        return " AND ".join([f"{a}.`{c}` <=> {b}.`{c}`" for c in by] + [f"{a}.{c} = {b}.{c}" for c in more])
    cells = ", ".join(f"struct({k} AS _c, coalesce({order_key(f'`{c}`', kinds[c])}, 0L) AS _k, double(`{c}`) AS _v)" for k, c in enumerate(columns))
    extra = "".join(f", `{c}`" for c in carry.columns) if carry is not None else ""
    own = "".join(f"x.`{c}`, " for c in by)
    told = f"_total{extra}"
    here = "f._t, f._rank, f._before, f._below, " + ", ".join(f"f.{c.strip()}" for c in told.split(","))
    asked = ", ".join(f"bigint({r})" for r in ranks)
    return df.sparkSession.sql(f"""
WITH cells AS (SELECT {g}explode(array({cells})) AS _x FROM {{_rows}}),
vals AS (SELECT {g}_x._c, _x._k, _x._v, count(*) AS _n FROM cells WHERE _x._v IS NOT NULL GROUP BY {g}_x._c, _x._k, _x._v),
digits AS (SELECT *, _v * _n AS _s, shiftright(_k, {2 * STEP}) AS _d1, shiftright(_k, {STEP}) & {_MASK}L AS _d2, _k & {_MASK}L AS _d3 FROM vals),
l1 AS (SELECT {g}_c, _d1, sum(_n) AS _n, sum(_s) AS _s FROM digits GROUP BY {g}_c, _d1),
t1 AS (SELECT *, sum(_n) OVER (PARTITION BY {g}_c) AS _total FROM l1),
a1 AS (SELECT *, posexplode(array({asked})) AS (_t, _rank) FROM
  (SELECT *, sum(_n) OVER (PARTITION BY {g}_c ORDER BY _d1) - _n AS _b, sum(_s) OVER (PARTITION BY {g}_c ORDER BY _d1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _l
   FROM t1 {"CROSS JOIN {_carry}" if carry is not None else ""})),
f1 AS (SELECT {g}_c, _d1, _t, _rank, _b AS _before, coalesce(_l, 0D) AS _below, {told} FROM a1 WHERE _b <= _rank AND _rank < _b + _n),
l2 AS (SELECT {own}x._c, x._d1, {here}, x._d2, sum(x._n) AS _n, sum(x._s) AS _s FROM digits x JOIN f1 f ON {same('x', 'f', '_c', '_d1')}
  GROUP BY {own}x._c, x._d1, {here}, x._d2),
f2 AS ({_holding("l2", f"{g}_c, _t", "_d2", f"{g}_c, _d1, _t, {told}")}),
l3 AS (SELECT {own}x._c, {here}, x._d3, x._v, x._n, x._s FROM digits x JOIN f2 f ON {same('x', 'f', '_c', '_d1', '_d2')}),
f3 AS ({_holding("l3", f"{g}_c, _t", "_d3", f"{g}_c, _t, _v, {told}")})
SELECT {g}_c, _t, _v AS _value, _rank, _before, _below, {told} FROM f3
""", _rows=df, **({"_carry": F.broadcast(carry)} if carry is not None else {}))


def exact_percentiles(df: DataFrame, by: Sequence[str], values: Mapping[str, str], q: float = 0.5) -> DataFrame:
    """Linearly interpolated percentile of each column of ``values`` (column -> output name)
    per group; NULLs are left out, a group without values in a column has NULL there, one
    without any value no row."""
    at = f"((_total - 1) * {float(q)!r}D)"
    found = select_ranks(df, by, list(values), [f"floor({at})", f"ceil({at})"])

    def percentile(k: int, name: str) -> str:
        lo, hi = (f"max(CASE WHEN _c = {k} AND _t = {t} THEN _value END)" for t in (0, 1))
        place = f"max(CASE WHEN _c = {k} THEN {at} END)"
        return f"CASE WHEN {lo} = {hi} THEN {lo} ELSE {lo} + ({hi} - {lo}) * ({place} - floor({place})) END AS `{name}`"
    return found.groupBy(*by).agg(*[F.expr(percentile(k, name)) for k, name in enumerate(values.values())])


def least_means(df: DataFrame, by: Sequence[str], values: Mapping[str, str], n: DataFrame) -> DataFrame:
    """Mean of the ``n`` smallest values of each column of ``values`` (column -> output name) per
    group; ``n`` is a one-row table with one column.  A group with fewer takes all it has; nothing is
    taken, and the mean is NULL, where ``n`` is zero."""
    take = f"least(_total, `{n.columns[0]}`)"
    found = select_ranks(df, by, list(values), [f"greatest({take}, 1) - 1"], carry=n)
    mean = f"(_below + ({take} - _before) * _value) / nullif({take}, 0)"
    return found.groupBy(*by).agg(*[F.expr(f"max(CASE WHEN _c = {k} THEN {mean} END) AS `{name}`") for k, name in enumerate(values.values())])
