"""Pooled ridge regression for every backtest window from one pass over the rows.

Training data grows with the origin, so its normal equations are running sums over
weeks: each task sums the cross-products of its rows per week, the weekly sums are
added up across tasks, and every window solves one small system.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions.columns import dot, plus_weeks
from weekcast.operators.baselines import at_origin


def _complete(table: DataFrame, features: Sequence[str]) -> DataFrame:
    return table.dropna(subset=list(features))


def _centres(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Rough means, one row; second moments are taken around them to keep their digits."""
    row = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    return np.array([float(row[c]) for c in columns])


#: Matrices that a task holds before it hands them on: weeks times pools may be many.
_HELD = 1_000


def weekly_moments(
    table: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    pools: Sequence[str] = (),
) -> tuple[DataFrame, np.ndarray]:
    """Per week, with z = [1, features], and the centres.

    ``missing`` 0 holds zᵀ[z, y_h…] of all rows, a missing target counting as zero after
    centring. ``missing`` h holds zᵀz of the rows without the target of horizon h, which
    that horizon subtracts: no row trains without its target. Such rows are few in a dense
    panel (the last weeks), and gaps inside a series cost one small matrix per week.
    """
    by = [*pools, "week_start"]
    features, targets = list(features), [f"target_h{h}" for h in horizons]
    rows = _complete(table, features)
    centres = _centres(rows, [*features, *targets])
    p = len(features)

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def handed() -> pd.DataFrame:
            out = pd.DataFrame(list(sums), columns=[*by, "missing"])
            out["moments"] = [m.ravel() for m in sums.values()]
            return out

        for batch in batches:
            values = batch[[*features, *targets]].to_numpy(dtype=float) - centres
            unknown = np.isnan(values[:, p:])
            values = np.where(np.isnan(values), 0.0, values)
            design = np.column_stack([np.ones(len(values)), values])
            for key, index in batch.groupby(by).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                part = design[index]
                found = [((*key, 0), part[:, : p + 1].T @ part)]
                for slot in np.flatnonzero(unknown[index].any(axis=0)):
                    z = part[unknown[index, slot], : p + 1]
                    found.append(((*key, horizons[slot]), z.T @ z))
                for k, m in found:
                    sums[k] = sums[k] + m if k in sums else m
            if len(sums) > _HELD:
                yield handed()
                sums.clear()
        if sums:
            yield handed()

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "missing int", "moments array<double>"])
    partial = rows.select(*by, *[F.col(c).cast("double") for c in [*features, *targets]])
    summed = (
        partial.mapInPandas(accumulate, schema)
        .groupBy(*by, "missing")
        .agg(Summarizer.sum(array_to_vector("moments")).alias("_v"))
        .select(*by, "missing", vector_to_array("_v").alias("moments"))
    )
    return summed, centres


def _solve(
    zz: np.ndarray, zy: np.ndarray, centre_y: float, centres: np.ndarray, alpha: float
) -> tuple[float, np.ndarray] | None:
    """Intercept and coefficients, in original units, of the standardised ridge."""
    n = zz[0, 0]
    if n < 1:
        return None
    sx, sxx = zz[0, 1:], zz[1:, 1:]
    mean_x, mean_y = sx / n, zy[0] / n
    cov = sxx - n * np.outer(mean_x, mean_x)
    variance = np.diag(cov) / n
    constant = variance <= 1e-12 * (1.0 + mean_x**2)
    scale = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, variance)))
    gram = cov / np.outer(scale, scale) + alpha * np.eye(len(sx))
    beta = np.linalg.solve(gram, (zy[1:] - n * mean_x * mean_y) / scale) / scale
    beta[constant] = 0.0
    intercept = mean_y + centre_y - beta @ (mean_x + centres)
    return float(intercept), beta


def _running(rows: pd.DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Weeks in order, and the matrices summed up to each of them."""
    rows = rows.sort_values("week_start")
    weeks = pd.to_datetime(rows["week_start"]).to_numpy()
    if not len(rows):
        return weeks, np.zeros((0, *shape))
    return weeks, np.cumsum(np.stack(rows["moments"].to_numpy()).reshape(-1, *shape), axis=0)


def coefficients(
    table: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int] = tuple(range(1, 9)),
    alpha: float = 1.0,
    pools: Sequence[str] = (),
) -> DataFrame:
    """One row per window: horizon, forecast_origin, intercept, coefficients.

    ``pools`` names columns whose values get a model of their own. The table is read
    twice; hand in a written one. Weekly sums and windows both grow with the calendar
    only, so one group per pool and horizon is small.
    """
    features, horizons, pools = list(features), list(horizons), list(pools)
    weekly, centres = weekly_moments(table, features, horizons, pools)
    p = len(features)

    def solve_all(sums: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        weeks, running = _running(sums[sums["missing"] == 0], (p + 1, p + 1 + len(horizons)))
        gaps, without = _running(sums[sums["missing"] > 0], (p + 1, p + 1))
        ends = pd.to_datetime(wanted["train_end"]).to_numpy()
        upto, gone = np.searchsorted(weeks, ends, side="right"), np.searchsorted(gaps, ends, side="right")
        for window, k, g in zip(wanted.itertuples(), upto, gone):
            if k == 0:
                continue
            slot = horizons.index(window.horizon)
            zz = running[k - 1][:, : p + 1] - (without[g - 1] if g else 0.0)
            made = _solve(zz, running[k - 1][:, p + 1 + slot], centres[p + slot], centres[:p], alpha)
            if made:
                pool = [getattr(window, c) for c in pools]
                rows.append((*pool, window.horizon, window.forecast_origin, *made))
        return pd.DataFrame(
            rows, columns=[*pools, "horizon", "forecast_origin", "intercept", "coefficients"]
        )

    every = F.array(*[F.lit(h) for h in horizons])
    per_horizon = weekly.withColumn(
        "horizon", F.explode(F.when(F.col("missing") == 0, every).otherwise(F.array("missing")))
    )
    wanted = windows.select(*pools, "horizon", "forecast_origin", "train_end")
    kinds = dict(table.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in pools) + (
        "horizon int, forecast_origin date, intercept double, coefficients array<double>"
    )
    return (
        per_horizon.groupBy(*pools, "horizon")
        .cogroup(wanted.groupBy(*pools, "horizon"))
        .applyInPandas(solve_all, schema)
    )


def _predict(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    x = F.array(*[F.col(f).cast("double") for f in features])
    return rows.withColumn("prediction", F.col("intercept") + dot(x, F.col("coefficients")))


def ridge(
    table: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int] = tuple(range(1, 9)),
    alpha: float = 1.0,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Backtest predictions of every window from the supervised table.

    Key columns that the windows carry too, such as the scenario, are fitted apart.
    """
    extra = [k for k in keys if k != "series_id"]
    pools = [k for k in extra if k in windows.columns]
    made = coefficients(table, windows, features, horizons, alpha, pools)
    rows = at_origin(_complete(table, features), windows, horizons, pools)
    # Without pools there is one coefficient row per week and horizon of the calendar.
    bounded = made if pools else F.broadcast(made)
    joined = rows.join(bounded, [*pools, "horizon", "forecast_origin"])
    return _predict(joined, features).select(
        *extra,
        F.lit("ridge").alias("model_name"),
        F.lit("ml").alias("model_family"),
        "series_id",
        "category",
        "segment_label",
        "forecast_origin",
        "target_date",
        "horizon",
        "actual",
        "prediction",
    )


def final_windows(table: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Per horizon: train on every row whose target is known."""
    last = table.agg(F.max("week_start").alias("forecast_origin"))
    return last.select(
        "forecast_origin", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    ).withColumn("train_end", plus_weeks("forecast_origin", -F.col("horizon")))


def fit(
    table: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int] = tuple(range(1, 9)),
    alpha: float = 1.0,
) -> DataFrame:
    """The final model as a table: one row per horizon, with its feature names."""
    made = coefficients(table, final_windows(table, horizons), features, horizons, alpha)
    return made.select(
        F.lit("ridge").alias("model_name"),
        "horizon",
        F.col("forecast_origin").alias("training_last_week"),
        F.lit(float(alpha)).alias("alpha"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        "intercept",
        "coefficients",
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved coefficient table; refused where its arrays don't fit together."""
    model = spark.read.parquet(path)
    odd = model.where(F.size("features") != F.size("coefficients"))
    if not odd.isEmpty():
        raise ValueError(f"{path} has a model whose coefficients and features differ in number")
    return model


def score(
    model: DataFrame,
    table: DataFrame,
    features: Sequence[str],
    origin: DataFrame | None = None,
    keys: Sequence[str] = ("series_id",),
    floor: float | None = None,
) -> DataFrame:
    """Forecasts of every horizon from the last week, or from ``origin`` weeks per key.

    No actuals are needed; ``floor`` clips forecasts, as scenario scoring does at zero.
    """
    rows = _complete(table, features)
    extra = [k for k in keys if k != "series_id"]
    if origin is None:
        last = table.agg(F.max("week_start")).scalar()
        rows = rows.withColumn("_last", last).where(F.col("week_start") == F.col("_last"))
    else:
        on = [*[k for k in extra if k in origin.columns], "week_start"]
        rows = rows.join(
            origin.withColumnRenamed("forecast_origin", "week_start").select(*on), on, "left_semi"
        )
    # One model row per horizon, carried as one array.
    fields = ["model_name", "horizon", "intercept", "coefficients"]
    params = model.agg(F.collect_list(F.struct(*fields))).scalar()
    per_horizon = rows.withColumn("_models", params).withColumn("_m", F.explode("_models"))
    made = _predict(per_horizon.select(*table.columns, *[f"_m.{c}" for c in fields]), features)
    value = F.col("prediction")
    targets = [c for c in table.columns if c.startswith("target_h")]
    by_name = F.create_map(
        *[part for c in targets for part in (F.lit(int(c.removeprefix("target_h"))), F.col(c))]
    )
    actual = F.element_at(by_name, F.col("horizon")) if targets else F.lit(None).cast("double")
    return made.select(
        *extra,
        "model_name",
        F.lit("ml").alias("model_family"),
        "series_id",
        "category",
        "segment_label",
        F.col("week_start").alias("forecast_origin"),
        plus_weeks("week_start", F.col("horizon")).alias("target_date"),
        "horizon",
        actual.alias("actual"),
        (value if floor is None else F.greatest(value, F.lit(floor))).alias("prediction"),
    )
