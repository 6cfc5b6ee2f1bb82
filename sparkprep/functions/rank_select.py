"""Rows at given ranks of an order, without sorting the table.

The order's first key is mapped to a number that never decreases along the order. Its
quantiles say between which values the wanted ranks lie, one aggregate counts the rows below
and between, and only the rows between are looked at further, until they are
few. Where all of them are equal in a key (or in the first bytes of a text), the next key (the next
bytes) goes on. The last few are
taken by a bounded top-k. Each round reads the table (its order columns) twice and keeps
about one row of 300; nothing is shuffled but counts.

Defined cases: nulls come first in ascending and last in descending order, unless the key says
otherwise; NaN is the largest number; rows that are equal in all keys stand in any order; ranks behind
the last row give nothing.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rank import with_global_index
from .types import dtypes, qcol

#: So many rows are ordered by top-k.
FEW = 100_000
STEPS = 1000
#: Bytes of a text that its number holds.
PREFIX = 6


class Key(NamedTuple):
    """One sort key."""

    name: str
    ascending: bool = True
    nulls_first: bool | None = None

    def sort(self) -> Column:
        c, first = qcol(self.name), self.ascending if self.nulls_first is None else self.nulls_first
        if self.ascending:
            return c.asc_nulls_first() if first else c.asc_nulls_last()
        return c.desc_nulls_first() if first else c.desc_nulls_last()


def place(key: Key, dt: T.DataType, skip: int = 0) -> Column | None:
    """A number per row that never decreases along the key, for texts among those that share their first ``skip``
    bytes; None for types without one."""
    c = qcol(key.name)
    if isinstance(dt, (T.StringType, T.BinaryType)):
        digits = F.rpad(F.hex(F.substring(c.cast("binary"), skip + 1, PREFIX)), 2 * PREFIX, "0")
        value = F.conv(digits, 16, 10).cast("double")
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        value = F.when(F.isnan(c), F.lit(math.inf)).otherwise(c.cast("double"))
    elif isinstance(dt, T.NumericType):
        value = c.cast("double")
    elif isinstance(dt, T.BooleanType):
        value = c.cast("int").cast("double")
    elif isinstance(dt, T.DateType):
        value = F.unix_date(c).cast("double")
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(c.cast("timestamp")).cast("double")
    else:
        return None
    value = value if key.ascending else -value
    first = key.ascending if key.nulls_first is None else key.nulls_first
    return F.when(c.isNull(), F.lit(-math.inf if first else math.inf)).otherwise(value)


def _between(rows: DataFrame, x: Column, first: int, last: int) -> tuple[float, float, int, int, int]:
    """Numbers between which the ranks lie, rows below, rows between, and all rows."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, [i / STEPS for i in range(STEPS + 1)], 10 * STEPS).alias("grid")).first()
    n, grid = found["n"], found["grid"]
    last, margin = min(last, n - 1), 1
    while first < n:
        i, j = math.floor(first / n * STEPS) - margin, math.ceil((last + 1) / n * STEPS) + margin
        lo, hi = grid[i] if i > 0 else -math.inf, grid[j] if j < STEPS else math.inf
        c = rows.agg(F.count_if(x < lo).alias("below"), F.count_if((x >= lo) & (x <= hi)).alias("between")).first()
        if (c["below"] <= first and last < c["below"] + c["between"]) or (i <= 0 and j >= STEPS):
            return lo, hi, c["below"], c["between"], n
        margin *= 10
    return -math.inf, math.inf, 0, 0, n  # no such ranks


def rows_at(df: DataFrame, order: list[Key | str], first: int, count: int, few: int = FEW) -> DataFrame:
    """The rows at ranks ``first`` to ``first + count - 1`` (from 0), in order."""
    keys = [k if isinstance(k, Key) else Key(k) for k in order]
    types, sort = dtypes(df), [k.sort() for k in keys]
    rows, last, left, skip = df, first + count - 1, list(keys), 0
    while last >= few and left and (x := place(left[0], types[left[0].name], skip)) is not None:
        lo, hi, below, between, n = _between(rows, x, first, last)
        if not between:
            return df.limit(0)
        rows = rows.where((x >= lo) & (x <= hi))
        first, last = first - below, last - below
        if between == n:  # no fewer
            c = qcol(left[0].name)
            same = rows.agg((F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, n)).alias("equal")).first()["equal"]
            if same:
                left, skip = left[1:], 0
            elif lo == hi and isinstance(types[left[0].name], (T.StringType, T.BinaryType)):
                skip += PREFIX
            else:
                break
    if last < few:
        return rows.orderBy(*sort).offset(first).limit(count)
    numbered = with_global_index(rows, sort, "_rank")
    return numbered.where((F.col("_rank") >= first) & (F.col("_rank") <= last)).orderBy("_rank").drop("_rank")
