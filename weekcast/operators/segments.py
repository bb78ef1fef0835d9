"""Per-series behaviour flags and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.functions.columns import ratio, share, total

# Thresholds of the segment rules.
MIN_WEEKS = 26
YEAR_WEEKS = 52
ZERO_SHARE = 0.4
STABLE_CV = 0.3
HIGH_CV = 1.0


def spread() -> list[Column]:
    """The aggregates the rules need; one pass over the series."""
    y = F.col("sales_units")
    return [
        F.count(F.lit(1)).alias("history_weeks"),
        share(y == 0).alias("zero_share"),
        F.var_pop(y).alias("variance"),
        F.stddev_pop(y).alias("_std"),
        F.avg(y).alias("_mean"),
    ]


def history_spread() -> dict[str, Column]:
    """The same figures from the weeks ``seen`` of a series' row; all others are zero."""
    n, zeros, mean = F.col("history_weeks"), F.col("_zeros"), F.col("_mean")
    squares = F.aggregate("_units", zeros * mean * mean, lambda s, v: s + (v - mean) * (v - mean))
    # Equal values have no spread, whatever their mean rounds to.
    differ = F.coalesce(F.array_max("_units") > F.array_min("_units"), F.lit(False))
    varies = differ | ((zeros > 0) & (zeros < n))
    return {
        "_units": F.col("seen.units"),
        "_zeros": n - F.size("_units"),
        "zero_share": zeros / n,
        "_mean": total(F.col("_units")) / n,
        "variance": F.when(varies, squares / n).otherwise(F.lit(0.0)),
        "_std": F.sqrt("variance"),
    }


def with_each(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns of which later ones use earlier ones."""
    for name, made in columns.items():
        df = df.withColumn(name, made)
    return df


def rules() -> dict[str, Column]:
    cv = ratio("_std", "_mean")
    sparse = F.col("zero_share") >= ZERO_SHARE
    return {
        "segment_label": F.when(F.col("history_weeks") < MIN_WEEKS, "problematic")
        .when(sparse, "intermittent")
        .when(cv <= STABLE_CV, "stable")
        .otherwise("medium_noise"),
        "short_history": F.col("history_weeks") < YEAR_WEEKS,
        "high_zero_share": sparse,
        "high_variance": F.coalesce(cv > HIGH_CV, F.lit(True)),
    }


def labelled(histories: DataFrame) -> DataFrame:
    """Histories with the ``segment_label`` of their series, without a join; none without a key."""
    label = F.when(F.col("series_id").isNotNull(), rules()["segment_label"]).alias("segment_label")
    return with_each(histories, history_spread()).select(*histories.columns, label)


def segment_series(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per series: label, flags and the figures behind them. ``panel`` has a row per
    week, or a row per series with its weeks ``seen`` (``dense_histories``)."""
    stats = with_each(panel, history_spread()) if "seen" in panel.columns else panel.groupBy(*keys).agg(*spread())
    return (
        stats.withColumns(rules())
        .select(
            *keys,
            "segment_label",
            "history_weeks",
            "zero_share",
            "short_history",
            "high_zero_share",
            "variance",
            "high_variance",
        )
    )


def segment_summary(summary: DataFrame) -> DataFrame:
    """Series count, share of all series and means per segment."""
    everything = summary.agg(F.count(F.lit(1))).scalar()
    return (
        summary.groupBy("segment_label")
        .agg(
            F.count(F.lit(1)).alias("series_count"),
            F.avg("history_weeks").alias("mean_history_weeks"),
            F.avg("zero_share").alias("mean_zero_share"),
            F.avg("outlier_share").alias("mean_outlier_share"),
            F.avg("total_sales_units").alias("mean_total_sales"),
        )
        .withColumn("share_of_series", ratio(F.col("series_count"), everything))
    )
