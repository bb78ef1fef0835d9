"""Refit the best model of a backtest on all weeks, save it, and forecast from what was saved."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.functions.columns import plus_weeks
from weekcast.operators import ridge
from weekcast.operators.baselines import latest_baseline
from weekcast.operators.features import Features, feature_names, supervised
from weekcast.operators.holt import latest_holt
from weekcast.operators.segments import segment_series
from weekcast.operators.trees import fit_trees, score_trees
from weekcast.plans.experiment import BASELINES, Experiment
from weekcast.session import cut_lineage

# Names whose integer codes a model has learnt, and the column of each code.
CODED = {"category": "category_code", "segment_label": "segment_code", "sku": "sku_code"}


def save_final(panel: DataFrame, experiment: Experiment, model_name: str, path: str) -> None:
    """Fit ``model_name`` on every row with a target and write it to ``path``: its settings,
    the codes it has learnt, and the coefficients or trees. Baselines and Holt are all
    settings; they need no fit."""
    b, params = experiment.backtest, dict(experiment.models[model_name])
    features = params.pop("features", experiment.features)
    horizons = list(range(b.horizon_min, b.horizon_max + 1))
    names = feature_names(panel.columns, features)
    settings = {
        "model_name": model_name,
        "alignment": params.get("alignment", experiment.alignment),
        "horizons": horizons,
        "feature_names": names,
        "features": dataclasses.asdict(features),
        "params": params,
    }
    spark = panel.sparkSession
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.parquet(f"{path}/settings")
    if model_name in BASELINES or model_name == "ets":
        return
    table = cut_lineage(supervised(panel, segment_series(panel), features, horizons))
    for name, code in CODED.items():
        if code in names:
            table.select(name, code).distinct().write.parquet(f"{path}/codes/{name}")
    if model_name == "ridge":
        ridge.fit(table, names, horizons, params.get("alpha", 1.0)).write.parquet(f"{path}/model")
    else:
        fit_trees(table, names, horizons, model_name, f"{path}/model", **params)


def forecast_saved(panel: DataFrame, path: str) -> DataFrame:
    """Forecasts of every horizon from the last week of ``panel``, by the model at ``path``.

    Codes are those learnt at the fit; a name that the fit didn't know gets -1.
    """
    spark = panel.sparkSession
    told = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    name, horizons = told["model_name"], told["horizons"]
    segments = segment_series(panel)
    if name in BASELINES:
        made = latest_baseline(panel, segments, name, horizons, told["alignment"])
    elif name == "ets":
        own = {k: v for k, v in told["params"].items() if k != "alignment"}
        made = latest_holt(panel, segments, horizons, told["alignment"], **own)
    else:
        kinds = {k: tuple(v) if isinstance(v, list) else v for k, v in told["features"].items()}
        table = supervised(panel, segments, Features(**kinds), ())
        for column, code in CODED.items():
            if code in told["feature_names"]:
                known = spark.read.parquet(f"{path}/codes/{column}")
                table = table.drop(code).join(known, column, "left").withColumn(code, F.coalesce(code, F.lit(-1)))
        if name == "ridge":
            made = ridge.score(ridge.load(spark, f"{path}/model"), table, told["feature_names"])
        else:
            saved = {h: f"{path}/model/model_name={name}/horizon={h}" for h in horizons}
            made = score_trees(table, told["feature_names"], name, saved)
    return made.select(
        "model_name",
        "model_family",
        "series_id",
        "category",
        "segment_label",
        "forecast_origin",
        plus_weeks("forecast_origin", F.col("horizon")).alias("target_date"),
        "horizon",
        "prediction",
    )
