"""A query, its SQL twin, and the shared description of their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _columns(spec: str) -> list[tuple[str, str]]:
    """``name``, ``name:i`` (whole number) or ``name:4`` (rounded to 4 places)."""
    pairs = [part.partition(":") for part in spec.split()]
    return [(name, kind) for name, _, kind in pairs]


def _nudge(digits: int) -> float:
    """Moves exact ties off the rounding boundary, where engines round differently."""
    return 3.3 * 10.0 ** -(digits + 3)


def shape_frame(df: DataFrame, spec: str) -> DataFrame:
    made = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind:
            c = F.round(c.cast("double") + F.lit(_nudge(int(kind))), int(kind)) + F.lit(0.0)
        made.append(c.alias(name))
    return df.select(*made)


def shape_sql(body: str, spec: str) -> str:
    made = []
    for name, kind in _columns(spec):
        expr = f'"{name}"'
        if kind == "i":
            expr = f"CAST({expr} AS BIGINT)"
        elif kind:
            shifted = f"CAST({expr} AS DOUBLE) + CAST({_nudge(int(kind))!r} AS DOUBLE)"
            expr = f"ROUND({shifted}, {kind}) + CAST(0 AS DOUBLE)"
        made.append(f'{expr} AS "{name}"')
    return f"SELECT {', '.join(made)} FROM (\n{body.strip()}\n) AS result"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, spec: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: shape_frame(query(spark, sf_dir), spec)
        if sql is not None:
            self.sql[name] = shape_sql(sql, spec)
