"""Spark tables the registered queries start from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weekcast.operators.baselines import baseline_counts, baselines
from weekcast.operators.panel import dense_histories, densify, weekly_sales
from weekcast.operators.segments import labelled, segment_series
from weekcast.operators.windows import Backtest, rolling_windows
from weekcast.session import cut_lineage
from weekcast.sources.star import star_raw, star_scenarios


def weekly_table(spark: SparkSession, sf_dir: str, level: str = "p_type") -> DataFrame:
    """Sparse weekly sales, written once: later steps read it several times, the raw
    lines are read only here."""
    if level == "sku":
        raw = star_raw(spark, sf_dir)
        return cut_lineage(weekly_sales(raw.sales, raw.items, "sku"))
    raw = star_raw(spark, sf_dir, category=level)
    return cut_lineage(weekly_sales(raw.sales, raw.items, "category"))


def panel_table(spark: SparkSession, sf_dir: str, level: str = "p_type") -> DataFrame:
    return densify(weekly_table(spark, sf_dir, level))


def history_table(spark: SparkSession, sf_dir: str, level: str = "p_type") -> DataFrame:
    """The dense panel with one row per series."""
    return dense_histories(weekly_table(spark, sf_dir, level))


def scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(star_scenarios(spark, sf_dir))


@dataclass(frozen=True)
class Setup:
    panel: DataFrame
    segments: DataFrame
    windows: DataFrame


def setup(spark: SparkSession, sf_dir: str, level: str = "p_type", backtest: Backtest = Backtest()) -> Setup:
    sparse = weekly_table(spark, sf_dir, level)
    panel = densify(sparse)
    return Setup(panel, segment_series(dense_histories(sparse)), rolling_windows(sparse, backtest))


def baseline_rows(
    spark: SparkSession, sf_dir: str, level: str = "p_type", alignment: str = "reference"
) -> DataFrame:
    """Predictions of both baselines, for queries that scan them once."""
    s = setup(spark, sf_dir, level)
    return baselines(s.panel, s.segments, s.windows, alignment=alignment)


def baseline_counted(spark: SparkSession, sf_dir: str, level: str, by: Sequence[str]) -> DataFrame:
    """Predictions of both baselines, equal ones within the groups ``by`` counted."""
    sparse = weekly_table(spark, sf_dir, level)
    return baseline_counts(labelled(dense_histories(sparse)), rolling_windows(sparse), by)


def baseline_table(
    spark: SparkSession, sf_dir: str, level: str = "p_type", alignment: str = "reference"
) -> DataFrame:
    """Predictions of both baselines, written once."""
    return cut_lineage(baseline_rows(spark, sf_dir, level, alignment))
