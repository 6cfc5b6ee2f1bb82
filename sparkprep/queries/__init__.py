"""Registered queries over the driver tables, each with its DuckDB oracle SQL
(or none, for seed-dependent model training, which gets a rows-only check)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(c):
    from pyspark.sql import functions as F
    return F.round(c, 6)


def load_all() -> None:
    from . import cleaning, diffing, features, io, models, profiling, recommending, views  # noqa: F401
