"""Tables behind the charts; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import ratio
from weekcast.operators.audit import sku_ranking
from weekcast.operators.features import series_order

# The per-series measures with a histogram of their own.
SUMMARY_MEASURES = (
    "history_weeks",
    "zero_share",
    "missing_share",
    "outlier_share",
    "coefficient_of_variation",
    "trend_strength",
)


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins of ``value`` per ``measure``: count and density, empty bins included.

    The last bin is closed; a constant measure gets the range ±0.5 around its value.
    """
    known = long.where(F.col("value").isNotNull())
    # One row per measure; the measures are named by the caller.
    bounds = known.groupBy("measure").agg(
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.count(F.lit(1)).alias("_rows"),
    )
    flat = F.col("_min") == F.col("_max")
    bounds = bounds.select(
        "measure",
        "_rows",
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    # The bounds of all measures travel as one map value.
    edges = F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    lookup = bounds.agg(F.map_from_entries(F.collect_list(F.struct("measure", edges)))).scalar()
    position = F.floor((F.col("value") - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo")) * bins)
    counted = (
        known.withColumn("_lookup", lookup)
        .withColumn("_b", F.element_at("_lookup", F.col("measure")))
        .withColumn("bin", F.least(position + 1, F.lit(bins)).cast("int"))
        .groupBy("measure", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    count = F.coalesce("count", F.lit(0))
    return every.join(counted, ["measure", "bin"], "left").select(
        "measure",
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * width).alias("bin_end"),
        count.alias("count"),
        (count / (F.col("_rows") * width)).alias("density"),
    )


def target_histogram(panel: DataFrame, bins: int = 25) -> DataFrame:
    """Distribution of weekly units, raw and log(1 + y)."""
    y = F.col("sales_units")
    pairs = F.array(
        F.struct(F.lit("raw").alias("measure"), y.alias("value")),
        F.struct(F.lit("log1p").alias("measure"), F.log1p(y).alias("value")),
    )
    return histogram(panel.select(F.inline(pairs)), bins)


def summary_histograms(summary: DataFrame, bins: int = 25) -> DataFrame:
    wide = summary.select(*[F.col(m).cast("double").alias(m) for m in SUMMARY_MEASURES])
    return histogram(wide.unpivot([], list(SUMMARY_MEASURES), "measure", "value"), bins)


def error_histogram(leader: DataFrame, bins: int = 20) -> DataFrame:
    """Absolute errors of the leading model."""
    error = F.abs(F.col("actual") - F.col("prediction")).alias("value")
    return histogram(leader.select(F.lit("abs_error").alias("measure"), error), bins)


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_label").agg(F.count(F.lit(1)).alias("series_count"))


def series_by_category(summary: DataFrame) -> DataFrame:
    return summary.groupBy("category").agg(F.countDistinct("series_id").alias("number_of_series"))


def category_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("category").agg(F.sum("sales_units").alias("sales_units"))


def normalised_categories(panel: DataFrame) -> DataFrame:
    """Weekly category totals divided by the category's mean week."""
    weekly = panel.groupBy("category", "week_start").agg(F.sum("sales_units").alias("sales_units"))
    mean = F.avg("sales_units").over(Window.partitionBy("category"))
    return weekly.withColumn("normalised", ratio("sales_units", mean))


def normalised_top_series(panel: DataFrame, n: int = 8) -> DataFrame:
    """Weekly units of the largest series divided by their own mean."""
    totals = panel.groupBy("series_id").agg(
        F.sum("sales_units").alias("_total"), F.avg("sales_units").alias("_mean")
    )
    top = totals.orderBy(F.desc("_total"), F.desc("_mean"), "series_id").limit(n)
    mean = F.avg("sales_units").over(Window.partitionBy("series_id"))
    return (
        panel.join(top, "series_id", "left_semi")
        .withColumn("normalised", ratio("sales_units", mean))
        .select("series_id", "week_start", "normalised")
    )


def seasonal_heatmap(index: DataFrame) -> DataFrame:
    """Category × ISO week matrix of the seasonal index."""
    weeks = list(range(1, 54))
    wide = index.groupBy("category").pivot("week_of_year", weeks).agg(F.max("seasonal_index"))
    return wide.withColumnsRenamed({str(w): f"week_{w}" for w in weeks})


def acf_profile(acf: DataFrame) -> DataFrame:
    """Mean autocorrelation per lag."""
    columns = [c for c in acf.columns if c.startswith("acf_lag_")]
    means = acf.agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot([], columns, "name", "mean_acf").select(
        F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("lag"), "mean_acf"
    )


def top_skus(summary: DataFrame, n: int = 20) -> DataFrame:
    ordered = summary.orderBy(F.desc("total_sales_units"), F.desc("mean_sales_units"), "series_id")
    return ordered.limit(n).select("series_id", "category", "total_sales_units")


def cumulative_share(summary: DataFrame, n: int = 200) -> DataFrame:
    return (
        sku_ranking(summary)
        .where(F.col("sales_rank") <= n)
        .select("sales_rank", "series_id", "cumulative_sales_share")
    )


def first_windows(windows: DataFrame, n: int = 6) -> DataFrame:
    return (
        windows.orderBy("forecast_origin", "horizon")
        .limit(n)
        .select("forecast_origin", "train_end", "test_start", "horizon")
    )


def error_by_horizon(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("scenario_name", "horizon").agg(
        F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("abs_error")
    )


def wape_matrix(table: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """WAPE pivoted to one column per value."""
    wide = table.groupBy(row).pivot(column, list(values)).agg(F.max("WAPE"))
    return wide.withColumnsRenamed({str(v): f"{column}_{v}" for v in values})


def example_overlay(panel: DataFrame, chosen: DataFrame) -> DataFrame:
    """Example series with last year's value and the trailing ten-week mean."""
    order = series_order()
    return panel.join(chosen.select("series_id"), "series_id", "left_semi").select(
        "series_id",
        "category",
        "week_start",
        "sales_units",
        F.lag("sales_units", 52).over(order).alias("lag_52"),
        F.avg("sales_units").over(order.rowsBetween(-9, 0)).alias("rolling_10"),
    )
