"""Rolling backtest of several forecasters, their comparison, and the winner's refit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weekcast.operators import evaluate as ev
from weekcast.operators import ridge
from weekcast.operators.baselines import baselines, incomplete_predictions
from weekcast.operators.bootstrap import bootstrap_ci
from weekcast.operators.features import Features, feature_names, supervised
from weekcast.operators.holt import holt
from weekcast.operators.segments import segment_series
from weekcast.operators.trees import LOSSES, trees
from weekcast.operators.windows import Backtest, broken_windows, check_settings, rolling_windows
from weekcast.session import cut_lineage

BASELINES = ("naive", "seasonal_naive")


@dataclass(frozen=True)
class Experiment:
    """``models``: parameters by model; ``features`` among them replaces the common ones."""

    models: Mapping[str, dict] = field(
        default_factory=lambda: {
            "naive": {},
            "seasonal_naive": {},
            "ets": {},
            "ridge": {"alpha": 1.0},
        }
    )
    features: Features = Features()
    backtest: Backtest = Backtest()
    alignment: str = "reference"
    bootstrap_samples: int = 300
    bootstrap_method: str = "poisson"


def backtest(panel: DataFrame, experiment: Experiment = Experiment()) -> DataFrame:
    """Predictions of all models, written once."""
    if "seasonal_naive" not in experiment.models:
        raise ValueError("seasonal_naive is the comparison baseline and must be among the models")
    unknown = set(experiment.models) - {*BASELINES, "ets", "ridge", *LOSSES}
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    b = experiment.backtest
    check_settings(b, experiment.features.lags)
    horizons = tuple(range(b.horizon_min, b.horizon_max + 1))
    segments = cut_lineage(segment_series(panel))
    windows = cut_lineage(rolling_windows(panel, b))
    if not broken_windows(windows).isEmpty():
        raise ValueError("a window trains on its own test week")
    simple = [m for m in BASELINES if m in experiment.models]
    parts = [
        baselines(panel, segments, windows, simple, horizons, experiment.alignment)
    ]
    if "ets" in experiment.models:
        params = {"alignment": experiment.alignment, **experiment.models["ets"]}
        parts.append(holt(panel, segments, windows, horizons, **params))
    pooled = [m for m in experiment.models if m == "ridge" or m in LOSSES]
    tables: dict[Features, DataFrame] = {}
    for m in pooled:
        params = dict(experiment.models[m])
        own = params.pop("features", experiment.features)
        if own not in tables:
            tables[own] = cut_lineage(supervised(panel, segments, own, horizons))
        table, names = tables[own], feature_names(panel.columns, own)
        if m == "ridge":
            parts.append(ridge.ridge(table, windows, names, horizons, **params))
        else:
            parts.append(trees(table, windows, names, m, **params))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    made = cut_lineage(made)
    if not incomplete_predictions(made).isEmpty():
        raise ValueError("a model left predictions or actuals empty")
    return made


def compare(predictions: DataFrame, experiment: Experiment = Experiment()) -> dict[str, DataFrame]:
    """Comparison tables of a written prediction table."""
    cuts = cut_lineage(ev.metrics_by_cuts(predictions))  # one scan for all of them
    overall = ev.cut_of(cuts, "overall").orderBy("WAPE", "model_name")
    by_segment = ev.cut_of(cuts, "by_segment")
    return {
        "overall": overall,
        "by_horizon": ev.cut_of(cuts, "by_horizon").orderBy("model_name", "horizon"),
        "by_segment": by_segment,
        "by_category": ev.cut_of(cuts, "by_category"),
        "bootstrap_ci": bootstrap_ci(
            predictions,
            n_bootstrap=experiment.bootstrap_samples,
            seed=experiment.backtest.seed,
            method=experiment.bootstrap_method,
        ),
        "error_cases": ev.error_cases(predictions),
        "rolling_vs_holdout": ev.rolling_vs_holdout(predictions),
        "ranking": ev.ranking(overall),
        "best_per_segment": ev.best_per_segment(by_segment),
        "leader_predictions": ev.leader_predictions(predictions, overall),
    }


def final_ridge(
    panel: DataFrame, experiment: Experiment = Experiment(), horizons: Sequence[int] | None = None
) -> DataFrame:
    """The ridge refitted on all rows with a target, as a coefficient table."""
    b = experiment.backtest
    horizons = horizons or tuple(range(b.horizon_min, b.horizon_max + 1))
    table = cut_lineage(supervised(panel, segment_series(panel), experiment.features, horizons))
    names = feature_names(panel.columns, experiment.features)
    alpha = experiment.models.get("ridge", {}).get("alpha", 1.0)
    return ridge.fit(table, names, horizons, alpha)
