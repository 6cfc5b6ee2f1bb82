"""Exact quantiles (linear interpolation, as pandas/numpy and Spark ``percentile``)
without holding a whole column in one task.

Spark's exact ``percentile`` keeps a value->count map for the whole column in
the final aggregation task; on a continuous column at scale that map is the
column. Instead, for all columns and ranks together:

1. one aggregate: count, min, max and a ``percentile_approx`` bracket around
   every wanted rank (rank error <= n/accuracy). Where sketches of the parts of the table are
   kept (``sketches.py``), they give the brackets, and this scan is saved;
2. one aggregate sends what lies in the brackets, as counts per value, to a table in the shared
   checkpoint folder, and counts the rows below each bracket. A value that holds a third of all
   rows is one row there from the first combination on;
3. a table of up to ``buckets`` values gives the ranks at once. A longer one is narrowed by rounds of
   histograms over it, one ``groupBy(bracket, bucket)`` each, until each
   rank's bucket holds one value. The input itself is not read again.

Only fixed-size results reach the driver: one aggregate row, and at most
``buckets`` values or histogram rows in total at a time. The number of scans doesn't depend
on the number of columns. NULL and NaN are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sketches import SKETCH_ERROR, estimates
from .types import qcol

BUCKETS = 65_536


def _lerp(a: float, b: float, t: float) -> float:
    # numpy's linear interpolation (used by pandas Series.quantile)
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


def _positions(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    k0 = int(math.floor(h))
    k1 = min(k0 + 1, n - 1)
    return k0, k1, h - k0


def _value(column: str) -> Column:
    """As double; NaN is NULL."""
    x = qcol(column).cast("double")
    return F.when(~F.isnan(x), x)


def _bucket(x: Column, lo: float, hi: float, buckets: int) -> Column:
    """0 for the lower end, ``buckets - 1`` for the upper one, in order between."""
    width = (hi / 2 - lo / 2) / buckets
    inner = F.lit(1)
    if 0 < width < math.inf:
        at = F.floor((x / 2 - lo / 2) / width)
        inner = F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).cast("int")
    return F.when(x <= lo, F.lit(0)).when(x >= hi, F.lit(buckets - 1)).otherwise(inner)


class _Rank:
    """Rank ``k`` (0-based) of column ``c``: ``below`` rows come before the bracket [lo, hi]."""

    def __init__(self, c: str, k: int, lo: float, hi: float):
        self.c, self.k, self.lo, self.hi, self.below, self.value = c, k, lo, hi, 0, None

    def bracket(self) -> tuple[str, float, float]:
        return self.c, self.lo, self.hi


def _disjoint(ranks: list[_Rank]) -> list[tuple[str, float, float]]:
    """Brackets in order, those that touch joined to one, which their ranks take over."""
    out: list[tuple[str, float, float]] = []
    for r in sorted(ranks, key=_Rank.bracket):
        if out and out[-1][0] == r.c and r.lo <= out[-1][2]:
            out[-1] = (r.c, out[-1][1], max(out[-1][2], r.hi))
        else:
            out.append(r.bracket())
    for r in ranks:
        _, r.lo, r.hi = next(b for b in out if b[0] == r.c and b[1] <= r.lo and r.hi <= b[2])
    return out


def _gather(values: DataFrame, names: dict[str, str], ranks: list[_Rank], whole: dict[str, tuple[float, float]],
            counts: dict[str, int], buckets: int) -> None:
    """Steps 2 and 3 for ranks that aren't known. A bracket that doesn't hold its rank is widened to the whole column."""
    brackets = _disjoint(ranks)
    entry = lambda j, x: F.struct(F.lit(j).alias("j"), x.alias("x"))
    apart = F.lit(None).cast("double")
    columns = list(dict.fromkeys(c for c, _, _ in brackets))
    entries = []  # one per row and column: a bracket, or the gap below it
    for c in columns:
        x, place = F.col(names[c]), F
        for j, (of, lo, hi) in enumerate(brackets):
            if of == c:
                place = place.when(x < lo, entry(j, apart)).when(x <= hi, entry(j, x))
        entries.append(place.when(x.isNotNull(), entry(len(brackets) + columns.index(c), apart)) if counts else place)
    sent = values.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    table = cut_lineage(sent.groupBy("e.j", "e.x").agg(F.count("*").alias("n")))
    rows = table.limit(buckets + 1).collect()
    whole_table = len(rows) <= buckets
    if not whole_table:
        rows = table.where("x IS NULL").collect()  # a row per gap
    gap = {r["j"]: r["n"] for r in rows if r["x"] is None}
    by: dict[int, list] = {}
    for r in sorted((r for r in rows if r["x"] is not None), key=lambda r: (r["j"], r["x"])):
        by.setdefault(r["j"], []).append((r["x"], r["x"], r["n"]))
    inside = {j: sum(n for *_, n in found) for j, found in by.items()} if whole_table else {
        r["j"]: r["n"] for r in table.where("x IS NOT NULL").groupBy("j").agg(F.sum("n").alias("n")).collect()}
    under, passed = {}, dict.fromkeys(columns, 0)
    for j, (c, _, _) in enumerate(brackets):
        under[j] = passed[c] + gap.get(j, 0)
        passed[c] = under[j] + inside.get(j, 0)
    for i, c in enumerate(columns):
        if counts and (found := passed[c] + gap.get(len(brackets) + i, 0)) != counts[c]:
            raise ValueError(f"the sketches hold {counts[c]} values of '{c}', the table {found}")
    open_ = []
    for r in ranks:
        j = brackets.index(r.bracket())
        if 0 <= r.k - under[j] < inside.get(j, 0):
            r.below = under[j]
            open_.append((j, r))
        else:
            r.lo, r.hi = whole[r.c]
    if whole_table:
        for j, r in open_:
            _step(r, by[j])
        return
    table = table.where("x IS NOT NULL")
    while left := [(j, r) for j, r in open_ if r.value is None]:
        _narrow(table, left, buckets)


def _step(r: _Rank, found: list[tuple[float, float, int]]) -> None:
    """To the bucket (lowest, highest value, rows) that holds the rank."""
    for lo, hi, n in found:
        if r.below + n > r.k:
            r.lo, r.hi = lo, hi
            if lo == hi:
                r.value = lo
            return
        r.below += n


def _narrow(table: DataFrame, ranks: list[tuple[int, _Rank]], buckets: int) -> None:
    """One round of step 3 over the values of the brackets."""
    parts = list(dict.fromkeys((j, r.lo, r.hi) for j, r in ranks))
    each = max(2, buckets // len(parts))
    x = F.col("x")
    entries = [F.when((F.col("j") == j) & (x >= lo) & (x <= hi), F.struct(F.lit(i).alias("i"), _bucket(x, lo, hi, each).alias("b")))
               for i, (j, lo, hi) in enumerate(parts)]
    sent = table.select(F.explode(F.array_compact(F.array(*entries))).alias("e"), "x", "n")
    found = sent.groupBy("e.i", "e.b").agg(F.sum("n").alias("n"), F.min("x").alias("l"), F.max("x").alias("h")).collect()
    by: dict[int, list] = {}
    for row in sorted(found, key=lambda t: (t["i"], t["b"])):
        by.setdefault(row["i"], []).append((row["l"], row["h"], row["n"]))
    for j, r in ranks:
        _step(r, by[parts.index((j, r.lo, r.hi))])


def exact_quantiles(df: DataFrame, columns, probs, *, buckets: int = BUCKETS, accuracy: int = 10_000,
                    sketches: DataFrame | None = None) -> dict[str, list]:
    """Return ``{column: [quantile for p in probs]}``; ``None`` entries for
    all-null columns. Values are compared as doubles; NULL and NaN are ignored.
    ``sketches`` of the table (of all its parts, as kept by ``sketches.build``) save the first scan; those of
    another table raise."""
    columns = list(dict.fromkeys(columns))
    probs = [float(p) for p in probs]
    if not columns:
        return {}
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    values = df.select(*[_value(c).alias(x) for c, x in names.items()])
    eps = 2.0 / accuracy if sketches is None else SKETCH_ERROR
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    if sketches is None:
        aggs = []
        for x in names.values():
            aggs += [F.count(x).alias("n" + x), F.min(x).alias("lo" + x), F.max(x).alias("hi" + x), F.percentile_approx(x, grid, accuracy).alias("ap" + x)]
        row = values.agg(*aggs).collect()[0]
        first = {c: (row["n" + x], row["lo" + x], row["hi" + x], row["ap" + x]) for c, x in names.items()}
    else:
        first = estimates(sketches.where(F.col("column").isin(columns)), grid)
        if absent := [c for c in columns if c not in first]:
            raise ValueError(f"no sketches of {', '.join(absent)}")
    ranks: dict[tuple[str, int], _Rank] = {}
    whole: dict[str, tuple[float, float]] = {}
    plan: dict[str, list] = {}
    for c, (n, least, most, near) in first.items():
        if not n:
            continue
        whole[c] = least, most
        approx = dict(zip(grid, near, strict=True))
        plan[c] = [_positions(n, p) for p in probs]
        for p, (k0, k1, _) in zip(probs, plan[c], strict=True):
            lo = approx[p - eps] if p - eps > 0 else least
            hi = approx[p + eps] if p + eps < 1 else most
            for k in (k0, k1):  # neighbours share a bracket
                ranks.setdefault((c, k), _Rank(c, k, lo, hi))
    counts = {} if sketches is None else {c: first[c][0] for c in whole}
    while open_ := [r for r in ranks.values() if r.value is None]:
        _gather(values, names, open_, whole, counts, buckets)
    return {c: [_lerp(ranks[c, k0].value, ranks[c, k1].value, t) for k0, k1, t in plan[c]] if c in plan else [None] * len(probs)
            for c in columns}


def quantiles(df: DataFrame, columns, probs, exact: bool = True, accuracy: int = 10_000) -> dict[str, list]:
    """Exact by default; ``exact=False`` is one ``percentile_approx`` pass (rank
    error <= n/accuracy) for inputs where an approximate cut is acceptable."""
    if exact:
        return exact_quantiles(df, columns, probs)
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    row = df.agg(*[F.percentile_approx(_value(c), [float(p) for p in probs], accuracy).alias(f"q{i}")
                   for i, c in enumerate(columns)]).collect()[0]
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(columns)}


def median(df: DataFrame, columns) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}
