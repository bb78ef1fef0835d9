"""The raw tables: daily sales with their item and store attributes, calendar, prices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.operators.panel import wide_to_long


@dataclass(frozen=True)
class Raw:
    """``sales`` may hold several rows per item, store and day; consumers sum them."""

    sales: DataFrame  # item_id, store_id, date, units
    items: DataFrame  # item_id, dept_id, cat_id
    stores: DataFrame  # store_id, state_id
    calendar: DataFrame  # d, date, wm_yr_wk
    prices: DataFrame  # store_id, item_id, wm_yr_wk, sell_price


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV with a header when the path says so."""
    if ".csv" in path:
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def read_raw(spark: SparkSession, sales_path: str, calendar_path: str, prices_path: str) -> Raw:
    """The wide daily layout: one row per item × store, one column per day."""
    wide = read_table(spark, sales_path)
    calendar = read_table(spark, calendar_path).select(
        "d", F.col("date").cast("date").alias("date"), "wm_yr_wk"
    )
    prices = read_table(spark, prices_path).select(
        "store_id", "item_id", "wm_yr_wk", "sell_price"
    )
    long = wide_to_long(wide, calendar)
    days = [c for c in wide.columns if c.startswith("d_")]
    used = calendar.where(F.col("d").isin(days)) if days else calendar
    return Raw(
        sales=long.select("item_id", "store_id", "date", "units"),
        items=wide.select("item_id", "dept_id", "cat_id").distinct(),
        stores=wide.select("store_id", "state_id").distinct(),
        calendar=used,
        prices=prices,
    )


def head(table: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return table.orderBy(*order).limit(n)


def read_scenarios(
    spark: SparkSession, path: str, scenario_name: str | None = None, level: str | None = None
) -> DataFrame:
    """A scenario panel file, checked, filtered to one scenario and rolled up."""
    from weekcast.operators.scenarios import prepare_scenarios

    return prepare_scenarios(read_table(spark, path), scenario_name, level)
