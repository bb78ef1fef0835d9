"""Ordered running totals over tables too large for one task.

``Window.orderBy`` without a partition moves every row to a single task. Here rows
are range-partitioned on the full order instead, each range is accumulated on its
own, and the totals of the earlier ranges (one row per range) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.session import cut_lineage

_RANGE = "_range"


def running(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
) -> DataFrame:
    """Add ``position`` (1, 2, …), ``cum_<c>``, ``total_<c>`` and ``total_rows``.

    Positions and totals restart per ``by`` group. ``order`` should be unique within
    a group: then no value, however frequent, can overload a range. The ranges are
    written once, because a second evaluation may draw other range bounds.
    """
    by = list(by)
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn(
            _RANGE, F.spark_partition_id()
        )
    )
    per_range = ranged.groupBy(_RANGE, *by).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums]
    )
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    zero = F.lit(0)
    offsets = per_range.select(
        F.col(_RANGE).alias("_r"),
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.coalesce(F.sum("_rows").over(earlier), zero).alias("_rows_before"),
        F.sum("_rows").over(group).alias("total_rows"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), zero).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(group).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy(_RANGE, *by).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns(
        {
            "_position": F.row_number().over(inside),
            **{f"_cum_{c}": F.sum(c).over(so_far) for c in sums},
        }
    )
    match = F.col(_RANGE) == F.col("_r")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    joined = local.join(offsets, match)
    return joined.select(
        *df.columns,
        (F.col("_rows_before") + F.col("_position")).alias("position"),
        "total_rows",
        *[(F.col(f"_before_{c}") + F.col(f"_cum_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def at_quantile(cum: str, n: str, total: str, value: str, q: float) -> Column:
    """Aggregate: the exact, linearly interpolated quantile of counted, ranked values."""
    target = (F.col(total) - 1) * F.lit(float(q))

    def pick(position: Column) -> Column:
        inside = (F.col(cum) - F.col(n) <= position) & (position < F.col(cum))
        return F.max(F.when(inside, F.col(value)))

    low, high = pick(F.floor(target)), pick(F.ceil(target))
    return low + (high - low) * (F.max(target) - F.floor(F.max(target)))


def exact_quantiles(
    df: DataFrame, value: str, by: Sequence[str], quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group, whatever the group size.

    Equal values are counted first, so a value shared by most rows costs one row.
    """
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(counted, [F.col(value)], by, ["_n"])
    return ranked.groupBy(*by).agg(
        *[at_quantile("cum__n", "_n", "total__n", value, q).alias(k) for k, q in quantiles.items()]
    )


def codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """0-based rank of the sorted distinct values of ``column``."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return running(distinct, [F.col(column)]).select(
        column, (F.col("position") - 1).cast("int").alias(code)
    )
