"""Small column helpers: weeks, safe arithmetic, number cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def monday(date: str | Column) -> Column:
    """The Monday on or before ``date``; day arithmetic only, no timestamps or zones."""
    day = F.to_date(col(date))
    return F.date_sub(day, F.weekday(day))


def plus_weeks(date: str | Column, weeks: int | Column) -> Column:
    days = F.lit(7 * weeks) if isinstance(weeks, int) else (weeks * 7).cast("int")
    return F.date_add(col(date), days)


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Division that yields null, never NaN or an error, on a zero denominator."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def clean(value: str | Column) -> Column:
    """NaN and infinities become null."""
    v = col(value)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def share(condition: Column) -> Column:
    """Share of rows meeting a condition; rows where it is null count as not meeting it."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def correlation_of(left: str | Column, right: str | Column) -> Column:
    """Aggregate: Pearson correlation over complete pairs; null when a side is constant."""
    both = col(left).isNotNull() & col(right).isNotNull()
    x, y = F.when(both, col(left)), F.when(both, col(right))
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
