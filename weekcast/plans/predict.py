"""Score scenario panels with a baseline or a saved model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.functions.columns import plus_weeks
from weekcast.operators import evaluate as ev
from weekcast.operators import ridge
from weekcast.operators import scenarios as sc
from weekcast.operators.baselines import baselines
from weekcast.operators.features import Features, supervised
from weekcast.operators.segments import segment_series
from weekcast.operators.windows import future_windows
from weekcast.session import cut_lineage

KEYS = ("scenario_name", "series_id")


def score_baselines(
    frame: DataFrame,
    horizon_weeks: int,
    models: Sequence[str] = ("naive", "seasonal_naive"),
    alignment: str = "reference",
) -> DataFrame:
    """Baseline forecasts of each scenario's future weeks, clipped at zero.

    Segments come from the observed part only.
    """
    made = baselines(
        sc.full_panel(frame),
        segment_series(sc.history_panel(frame), KEYS),
        future_windows(frame, horizon_weeks, ("scenario_name",)),
        models,
        tuple(range(1, horizon_weeks + 1)),
        alignment,
        KEYS,
    )
    return made.withColumn("prediction", F.greatest("prediction", F.lit(0.0)))


def score_ridge(
    frame: DataFrame,
    model: DataFrame,
    feature_columns: Sequence[str],
    features: Features = Features(),
    horizon_weeks: int | None = None,
) -> DataFrame:
    """A saved coefficient table on each scenario's last observed week, clipped at zero.

    The horizons are those of the model, up to ``horizon_weeks``. Features of that week
    look back a bounded number of weeks, so earlier weeks are cut off before the feature
    windows; a filter on the week cannot pass them by itself.
    """
    if horizon_weeks is not None:
        model = model.where(F.col("horizon") <= horizon_weeks)
    # One row per horizon of the model.
    horizons = sorted(r["horizon"] for r in model.select("horizon").distinct().collect())
    segments = segment_series(sc.history_panel(frame), KEYS)
    origin = future_windows(frame, 1, ("scenario_name",)).select("scenario_name", "forecast_origin")
    reach = max((*features.lags, *features.rolling_windows))
    first = origin.agg(F.min("forecast_origin")).scalar()
    recent = (
        sc.full_panel(frame)
        .withColumn("_first", first)
        .where(F.col("week_start") >= plus_weeks("_first", -reach))
        .drop("_first")
    )
    table = supervised(recent, segments, features, horizons, KEYS)
    made = ridge.score(model, table, feature_columns, origin, KEYS, floor=0.0)
    return made.where(F.col("actual").isNotNull())


def predict(
    frame: DataFrame,
    model: DataFrame,
    feature_columns: Sequence[str],
    horizon_weeks: int,
    features: Features = Features(),
) -> dict[str, DataFrame]:
    """Predictions with their metrics. A scenario for which the saved model falls short of
    a horizon is refitted; the others keep the saved model's forecasts."""
    frame = cut_lineage(frame)
    made = cut_lineage(score_ridge(frame, model, feature_columns, features, horizon_weeks))
    short = cut_lineage(
        sc.missing_horizons(made, frame, horizon_weeks).select("scenario_name").distinct()
    )
    if not short.isEmpty():
        anew = refit(frame.join(short, "scenario_name", "left_semi"), feature_columns, horizon_weeks, features)
        kept = made.join(short, "scenario_name", "left_anti")
        made = cut_lineage(kept.unionByName(anew))
    table = cut_lineage(ev.metrics(made, ["scenario_name", "horizon"]))
    return {
        "predictions": made,
        "metrics_by_horizon": table,
        "best_row": ev.best_row(table),
        "coverage": ev.scenario_coverage(frame),
    }


def refit(
    frame: DataFrame, feature_columns: Sequence[str], horizon_weeks: int, features: Features = Features()
) -> DataFrame:
    """One ridge per scenario, trained on its history, for its future weeks."""
    horizons = tuple(range(1, horizon_weeks + 1))
    segments = segment_series(sc.full_panel(frame), KEYS)
    table = cut_lineage(supervised(sc.full_panel(frame), segments, features, horizons, KEYS))
    windows = future_windows(frame, horizon_weeks, ("scenario_name",))
    made = ridge.ridge(table, windows, feature_columns, horizons, keys=KEYS)
    return made.withColumn("prediction", F.greatest("prediction", F.lit(0.0)))
