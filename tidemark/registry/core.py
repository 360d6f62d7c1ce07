"""Collects the named queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent over the same tables, if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Prices are cents over small counts, so many results end exactly between two roundings and the last
# bit would decide. A small offset on both sides moves the comparison off those ties.
_OFFSET = 0.0123


def r(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison between engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(_OFFSET / 10**digits), digits)


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`r`; adding zero turns -0.0 into 0.0."""
    return f"(round({expr} + {_OFFSET / 10**digits!r}::DOUBLE, {digits}) + 0.0)"


def rounded(df: DataFrame, keep: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[r(c, digits).alias(c) for c in cols])


def R_list(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"{R(c, digits)} AS {c}" for c in cols)
