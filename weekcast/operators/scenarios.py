"""What-if panels: expansion, expected demand, roll-up, scoring inputs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import plus_weeks, ratio

REQUIRED = ("series_id", "category", "week_start", "is_history", "sales_units")
# How each optional column is combined when series are rolled up.
ROLL_UP = {
    "price": "mean",
    "promo_planned": "mean",
    "promo_actual": "mean",
    "discount_rate": "mean",
    "base_price": "mean",
    "stockout_flag": "max",
    "demand_noise_scale": "mean",
    "promo_known_in_advance": "all",
    "price_known_in_advance": "all",
    "promo_covariate_class": "first",
    "price_covariate_class": "first",
    "target_name": "first",
}
_COMBINE = {"mean": F.avg, "max": F.max, "all": F.bool_and, "first": F.min}


def prepare_scenarios(
    frame: DataFrame, scenario_name: str | None = None, level: str | None = None
) -> DataFrame:
    """Check the columns, keep one scenario, roll up."""
    missing = sorted(set(REQUIRED) - set(frame.columns))
    if missing:
        raise ValueError(f"scenario panel lacks columns {missing}")
    out = frame.withColumn("week_start", F.col("week_start").cast("date"))
    if scenario_name is not None:
        if "scenario_name" not in frame.columns:
            raise ValueError("the panel has no scenario_name")
        out = out.where(F.col("scenario_name") == scenario_name)
        if out.isEmpty():
            raise ValueError(f"no rows for scenario {scenario_name!r}")
    return out if level is None else roll_up(out, level)


def roll_up(frame: DataFrame, level: str = "category") -> DataFrame:
    """Sum of sales and the stated combination of each optional column, per category and week.

    "First" is taken as the smallest value, which does not depend on row order.
    """
    if level == "sku":
        return frame
    if level != "category":
        raise ValueError(f"level must be category or sku, not {level!r}")
    keys = [c for c in ("scenario_name", "category", "week_start", "is_history") if c in frame.columns]
    optional = [
        _COMBINE[how](c).alias(c) for c, how in ROLL_UP.items() if c in frame.columns
    ]
    return (
        frame.groupBy(*keys)
        .agg(F.sum("sales_units").alias("sales_units"), *optional)
        .withColumn("series_id", F.col("category"))
    )


def _panel_columns(frame: DataFrame) -> list[Column]:
    promo = F.col("promo_planned").cast("double") if "promo_planned" in frame.columns else F.lit(0.0)
    price = F.col("price").cast("double") if "price" in frame.columns else F.lit(None).cast("double")
    keys = ["scenario_name"] if "scenario_name" in frame.columns else []
    return [
        *[F.col(k) for k in keys],
        *[F.col(c) for c in ("series_id", "category", "week_start", "sales_units")],
        price.alias("price"),
        promo.alias("promo"),
    ]


def history_panel(frame: DataFrame) -> DataFrame:
    """The observed part in panel layout."""
    return frame.where("is_history").select(*_panel_columns(frame))


def full_panel(frame: DataFrame) -> DataFrame:
    """Observed and future part in panel layout."""
    return frame.select(*_panel_columns(frame))


def expand_scenarios(params: DataFrame, start: str, history_weeks: int, horizon_weeks: int) -> DataFrame:
    """One row per scenario, series and week; ``params`` has one row per scenario and series."""
    weeks = history_weeks + horizon_weeks
    return (
        params.withColumn("time_index", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
        .withColumn("week_start", plus_weeks(F.lit(start).cast("date"), F.col("time_index")))
        .withColumns(
            {
                "week_of_year": F.weekofyear("week_start"),
                "is_history": F.col("time_index") < history_weeks,
                "total_weeks": F.lit(weeks),
            }
        )
    )


def expected_demand() -> Column:
    """Demand of a series in a week from its parameters, promotion and price; at least 1."""
    step = F.col("time_index")
    span = F.greatest(F.col("total_weeks") - 1, F.lit(1))

    def wave(amplitude: str, period: float, phase: str) -> Column:
        return 1 + F.col(amplitude) * F.sin(2 * math.pi * step / period + F.col(phase))

    price_effect = F.when(
        F.col("base_price") > 0, F.pow(F.col("price") / F.col("base_price"), F.col("elasticity"))
    )
    demand = (
        F.col("base_level")
        * (1 + 0.03 * (F.col("category_rank") - 1))
        * (1 + F.col("trend_slope") * step / span)
        * wave("yearly_amplitude", 52.0, "phase_year")
        * wave("monthly_amplitude", 13.0, "phase_month")
        * (1 + F.col("promo_lift") * F.col("promo_planned"))
        * F.coalesce(price_effect, F.lit(1.0))
    )
    return F.greatest(demand, F.lit(1.0))


def series_metadata(frame: DataFrame) -> DataFrame:
    return frame.groupBy("scenario_name", "series_id", "category").agg(
        F.sum(F.col("is_history").cast("int")).alias("history_weeks"),
        F.count("week_start").alias("total_weeks"),
        F.avg("sales_units").alias("mean_sales"),
        F.coalesce(F.stddev_samp("sales_units"), F.lit(0.0)).alias("std_sales"),
        F.avg((F.col("sales_units") == 0).cast("double")).alias("zero_share"),
        F.avg("promo_planned").alias("promo_share"),
        F.avg("price").alias("avg_price"),
    )


def scenario_profile(frame: DataFrame) -> DataFrame:
    """Panel facts as metric rows; dates go to ``text``, numbers to ``value``."""
    row = frame.agg(
        F.count(F.lit(1)).cast("double").alias("number_of_rows"),
        F.countDistinct("series_id").cast("double").alias("number_of_series"),
        F.countDistinct("scenario_name").cast("double").alias("number_of_scenarios"),
        F.countDistinct("category").cast("double").alias("number_of_categories"),
        F.min("week_start").cast("string").alias("period_start"),
        F.max("week_start").cast("string").alias("period_end"),
        F.sum(F.col("is_history").cast("double")).alias("history_rows"),
        F.sum((~F.col("is_history")).cast("double")).alias("future_rows"),
        F.avg("sales_units").alias("mean_sales_units"),
        F.avg((F.col("sales_units") == 0).cast("double")).alias("zero_share"),
        F.avg("promo_planned").alias("promo_share"),
    )
    return metric_rows(row)


def metric_rows(row: DataFrame) -> DataFrame:
    """One wide row to ``metric, value, text`` rows."""
    items = [
        F.struct(
            F.lit(c).alias("metric"),
            (F.lit(None) if t == "string" else F.col(c)).cast("double").alias("value"),
            (F.col(c) if t == "string" else F.lit(None)).cast("string").alias("text"),
        )
        for c, t in row.dtypes
    ]
    return row.select(F.inline(F.array(*items)))


def example_tails(frame: DataFrame, keys_kept: int = 3, weeks: int = 12) -> DataFrame:
    """The last weeks of the first few (scenario, series) keys."""
    keys = ["scenario_name", "series_id"]
    first = frame.select(*keys).distinct().orderBy(*keys).limit(keys_kept)
    latest = Window.partitionBy(*keys).orderBy(F.desc("week_start"))
    return (
        frame.join(first, keys, "left_semi")
        .withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= weeks)
        .drop("_n")
    )


def series_per_category(frame: DataFrame) -> DataFrame:
    return frame.groupBy("scenario_name", "category").agg(
        F.countDistinct("series_id").alias("series_count")
    )


def scenario_weekly_totals(frame: DataFrame) -> DataFrame:
    return frame.groupBy("scenario_name", "week_start").agg(
        F.sum("sales_units").alias("total_sales_units")
    )


def scenario_series_means(frame: DataFrame) -> DataFrame:
    return frame.groupBy("scenario_name", "series_id").agg(
        F.avg("sales_units").alias("mean_sales_units")
    )


def missing_horizons(
    predictions: DataFrame, frame: DataFrame, horizon_weeks: int
) -> DataFrame:
    """Scenario × horizon cells the predictions do not cover; empty means no refit is needed."""
    wanted = (
        frame.select("scenario_name")
        .distinct()
        .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon_weeks))))
    )
    made = predictions.groupBy("scenario_name", "horizon").agg(
        F.bool_and(F.col("prediction").isNotNull()).alias("_ok")
    )
    return wanted.join(made.where("_ok"), ["scenario_name", "horizon"], "left_anti")
