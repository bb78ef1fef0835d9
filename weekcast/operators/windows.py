"""Rolling-origin backtest windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import plus_weeks


@dataclass(frozen=True)
class Backtest:
    horizon_min: int = 1
    horizon_max: int = 8
    min_train_weeks: int = 64
    step_weeks: int = 1
    max_windows: int | None = None
    seed: int = 42


def week_list(panel: DataFrame) -> DataFrame:
    """One row with the array of all weeks from the first to the last; its length is the
    calendar's, not the data's. The sparse table gives the same list as the dense panel."""
    first, last = F.min("week_start").cast("date"), F.max("week_start").cast("date")
    return panel.agg(F.sequence(first, last, F.expr("interval 7 days")).alias("weeks"))


def _at(index: Column) -> Column:
    """Week at a 0-based index."""
    return F.element_at("weeks", (index + 1).cast("int"))


def check_settings(backtest: Backtest, lags: tuple[int, ...] = ()) -> None:
    if lags and backtest.min_train_weeks < max(lags) + backtest.horizon_max + 1:
        raise ValueError("min_train_weeks must cover the longest lag, the horizon and one week")


def rolling_windows(
    panel: DataFrame, backtest: Backtest = Backtest(), level: str = "category", feature_set: str = "F4"
) -> DataFrame:
    """One row per horizon and forecast origin.

    The training part ends ``h`` weeks before the origin, so that no training target
    reaches past the origin; the test week is ``h`` weeks after it.
    """
    b = backtest
    n = F.size("weeks")
    need = b.min_train_weeks + b.horizon_max
    enough = F.when(n >= need, F.col("weeks")).otherwise(
        F.raise_error(F.format_string(f"need {need} weeks, found %d", n))
    )
    first, last = b.min_train_weeks - 1, n - b.horizon_max - 1
    index = F.sequence(F.lit(first), last, F.lit(b.step_weeks))
    if b.max_windows:
        index = F.when(
            F.size(index) > b.max_windows, F.slice(index, -b.max_windows, b.max_windows)
        ).otherwise(index)
    horizons = F.array(*[F.lit(h) for h in range(b.horizon_min, b.horizon_max + 1)])
    return (
        week_list(panel)
        .select(enough.alias("weeks"))
        .select("weeks", F.explode(index).alias("i"))
        .select("weeks", "i", F.explode(horizons).alias("horizon"))
        .where(F.col("i") >= first + F.col("horizon"))
        .select(
            F.lit(level).alias("aggregation_level"),
            F.lit(feature_set).alias("feature_set"),
            _at(F.lit(0)).alias("train_start"),
            _at(F.col("i") - F.col("horizon")).alias("train_end"),
            _at(F.col("i")).alias("forecast_origin"),
            "horizon",
            _at(F.col("i") + F.col("horizon")).alias("test_start"),
            _at(F.col("i") + F.col("horizon")).alias("test_end"),
            F.lit(b.seed).alias("seed"),
        )
    )


def broken_windows(windows: DataFrame) -> DataFrame:
    """Windows that break the invariants; an empty result is a pass."""
    good = (F.col("train_end") < F.col("test_start")) & (F.col("test_start") == F.col("test_end"))
    sets = windows.agg(F.countDistinct("feature_set")).scalar()
    return windows.withColumn("_sets", sets).where(~good | (F.col("_sets") > 1)).drop("_sets")


def future_windows(frame: DataFrame, horizon_weeks: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Windows starting at the last history week, one per horizon (and per key)."""
    last = (
        frame.where("is_history")
        .groupBy(*keys)
        .agg(F.max("week_start").alias("forecast_origin"))
    )
    return last.select(
        *keys,
        "forecast_origin",
        F.explode(F.sequence(F.lit(1), F.lit(horizon_weeks))).alias("horizon"),
    ).select(
        *keys,
        "horizon",
        "forecast_origin",
        plus_weeks("forecast_origin", -F.col("horizon")).alias("train_end"),
        plus_weeks("forecast_origin", F.col("horizon")).alias("test_start"),
    )


def validation_windows(history: DataFrame, horizon_weeks: int) -> DataFrame:
    """Windows inside the history whose target is its last week."""
    n = F.size("weeks")
    h = F.col("horizon")
    return (
        week_list(history)
        .select("weeks", F.explode(F.sequence(F.lit(1), F.lit(horizon_weeks))).alias("horizon"))
        .select(
            "horizon",
            _at(n - 1 - h).alias("forecast_origin"),
            _at(n - 1 - 2 * h).alias("train_end"),
            _at(n - 1).alias("test_start"),
        )
    )


def infer_horizon(frame: DataFrame) -> DataFrame:
    """Number of distinct future weeks.

    Dividing future rows by distinct series ids, as one might, counts every scenario
    that repeats an id again.
    """
    return frame.where(~F.col("is_history")).agg(F.countDistinct("week_start").alias("horizon"))


def slice_sizes(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Training and prediction rows of each window.

    "All rows up to the training end" is a range predicate; with the rows counted per
    week first, it becomes a running sum over weeks and an equi-join.
    """
    per_week = panel.groupBy("week_start").agg(F.count(F.lit(1)).alias("predict_rows"))
    # One row per week of the calendar.
    so_far = Window.orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    running = per_week.select(
        F.col("week_start").alias("train_end"), F.sum("predict_rows").over(so_far).alias("train_rows")
    )
    return (
        windows.join(running, "train_end")
        .join(per_week.withColumnRenamed("week_start", "forecast_origin"), "forecast_origin")
        .select("horizon", "forecast_origin", "train_end", "train_rows", "predict_rows")
    )
