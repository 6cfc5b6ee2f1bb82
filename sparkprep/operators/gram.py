"""F14 for wide tables: correlations of all column pairs in one scan.

Each task sums up its rows into square matrices over all columns: for a pair, the rows in
which both are present, the means and squared deviations of either over these rows, and
the products of their deviations. Matrices of two parts of the rows merge exactly (deviations move to the
joint mean), batch by batch inside a task, and between tasks in two levels of
groups, cut into tiles so that a group holds one tile at a time whatever the number of columns.

Defined cases: NULL and NaN are missing in a pair's rows; a pair with a side that is constant there,
or without such rows, has no correlation (NULL); an empty table gives no pair.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import dtypes, present

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of a tile, and tasks whose tiles are merged in the first level.
TILE, FAN = 64, 256
#: Squared deviations below this share of the squares come from rounding.
ROUNDING = 1e-12
TILES = "a int, b int, task int, sums binary"
PAIRS = "a int, b int, corr double"


class Sums:
    """Matrices over pairs (i, j): rows ``n``, mean and squared deviations of i (``mean``, ``dev``) and of j
    (``mean_t``, ``dev_t``), products of deviations ``prod``."""

    names = ("n", "mean", "mean_t", "dev", "dev_t", "prod")

    def __init__(self, *parts: np.ndarray):
        self.n, self.mean, self.mean_t, self.dev, self.dev_t, self.prod = parts

    @staticmethod
    def of(x: np.ndarray) -> "Sums":
        """Of rows x columns; NaN is missing."""
        here = ~np.isnan(x)
        first = np.where(here.any(axis=0), x[here.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        z, m = np.where(here, x - first, 0.0), here.astype(np.float64)
        n, total, squares = m.T @ m, z.T @ m, (z * z).T @ m
        some = np.maximum(n, 1)
        dev = squares - total * total / some
        dev[dev <= ROUNDING * squares] = 0.0
        mean = total / some + first[:, None]
        return Sums(n, mean, mean.T, dev, dev.T, z.T @ z - total * total.T / some)

    def merge(self, o: "Sums") -> "Sums":
        n = self.n + o.n
        share = o.n / np.maximum(n, 1)
        weight = self.n * share
        d, t = o.mean - self.mean, o.mean_t - self.mean_t
        return Sums(n, self.mean + d * share, self.mean_t + t * share, self.dev + o.dev + d * d * weight,
                    self.dev_t + o.dev_t + t * t * weight, self.prod + o.prod + d * t * weight)

    def tile(self, rows: slice, columns: slice) -> "Sums":
        return Sums(*(getattr(self, k)[rows, columns] for k in self.names))

    def pack(self) -> bytes:
        return np.array(self.n.shape, dtype=np.int64).tobytes() + np.stack([getattr(self, k) for k in self.names]).tobytes()

    @staticmethod
    def unpack(data: bytes) -> "Sums":
        shape = np.frombuffer(data, dtype=np.int64, count=2)
        return Sums(*np.frombuffer(data, dtype=np.float64, offset=16).reshape(6, *shape))

    def correlation(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.prod / np.sqrt(self.dev * self.dev_t)
        return np.where((self.n > 0) & (self.dev > 0) & (self.dev_t > 0), out, np.nan)


def _sum_rows(n_columns: int):
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in batch.columns])
                found = Sums.of(x)
                total = found if total is None else total.merge(found)
        if total is not None:
            task, tiles = TaskContext.get().partitionId(), range(0, n_columns, TILE)
            for a in tiles:
                for b in tiles[a // TILE:]:
                    part = total.tile(slice(a, a + TILE), slice(b, b + TILE))
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([task], pa.int32()),
                                                      pa.array([part.pack()], pa.binary())], ["a", "b", "task", "sums"])
    return run


def _merged(tiles: pa.Table) -> Sums:
    total = None
    for data in tiles["sums"]:
        part = Sums.unpack(data.as_py())
        total = part if total is None else total.merge(part)
    return total


def _merge_some(key, tiles):
    return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([_merged(tiles).pack()], pa.binary())], ["a", "b", "task", "sums"])


def _correlate(key, tiles):
    a, b = (k.as_py() for k in key)
    r = _merged(tiles).correlation()
    i, j = np.indices(r.shape)
    i, j, r = i.ravel() + a, j.ravel() + b, r.ravel()
    pairs = i < j
    return pa.table([pa.array(i[pairs], pa.int32()), pa.array(j[pairs], pa.int32()), pa.array(r[pairs], from_pandas=True)], ["a", "b", "corr"])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, corr)`` of the columns at places a before b."""
    types = dtypes(df)
    rows = df.select(*[present(c, types[c]).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    tiles = rows.mapInArrow(_sum_rows(len(columns)), TILES).withColumn("task", (F.col("task") / FAN).cast("int"))
    some = tiles.groupBy("a", "b", "task").applyInArrow(_merge_some, TILES)
    return some.groupBy("a", "b").applyInArrow(_correlate, PAIRS)
