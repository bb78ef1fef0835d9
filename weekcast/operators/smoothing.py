"""Exponential smoothing with an additive season and a damped trend, weights fitted per series.

State: a level, a trend and one number per week of the season. It starts from the first season's
mean and deviations, so it knows nothing later than that; before, the last value is the forecast.
All series of a task, and all candidate weights of a fit, advance through the weeks together.

Weights are fitted every ``refit_weeks`` weeks on the one-step errors so far: the best point of a
grid is the start of a bounded pattern search, which tries a step up and down in each weight for
all series at once, takes the best and halves the steps where nothing improves. So fitted weights
are never worse than the grid's, and no fit sees a later week than its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.operators.seasonality import spread

# Grid and bounds of the level, trend, season and damping weights.
GRID = tuple(product((0.1, 0.3, 0.6), (0.0, 0.1), (0.05, 0.3), (0.9, 1.0)))
LOW, HIGH = np.array([0.01, 0.0, 0.0, 0.8]), np.array([1.0, 1.0, 1.0, 1.0])
FIRST_STEP, ROUNDS, CHUNK = np.array([0.1, 0.1, 0.1, 0.05]), 14, 256


def smooth(y: np.ndarray, weights: np.ndarray, periods: int, upto: int, horizons: Sequence[int] = (), since: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Squared one-step errors (series × candidates) of the weeks before ``upto``, and forecasts
    (series × candidates × weeks from ``since`` × horizons). ``y``: series × weeks;
    ``weights``: series × candidates × 4."""
    alpha, beta, gamma, phi = np.moveaxis(weights, -1, 0)
    first = y[:, :periods]
    level = np.repeat(first.mean(axis=1)[:, None], weights.shape[1], axis=1)
    trend, sse = np.zeros_like(level), np.zeros_like(level)
    season = np.repeat((first - first.mean(axis=1, keepdims=True))[:, None, :], weights.shape[1], axis=1)
    damped = [sum(phi**k for k in range(1, h + 1)) for h in horizons]
    made = []

    def forecast(t: int) -> None:
        if horizons and t >= since:
            made.append(np.stack([level + d * trend + season[:, :, (t + h) % periods] for d, h in zip(damped, horizons)], axis=-1))

    forecast(periods - 1)
    for t in range(periods, upto):
        slot = t % periods
        ahead = level + phi * trend
        error = y[:, t : t + 1] - ahead - season[:, :, slot]
        sse += error * error
        level = ahead + alpha * error
        trend = phi * trend + alpha * beta * error
        season[:, :, slot] += gamma * (1 - alpha) * error
        forecast(t)
    return sse, np.stack(made, axis=2) if made else np.zeros((*level.shape, 0, len(horizons)))


def fit(y: np.ndarray, periods: int, upto: int, damped: bool = True) -> np.ndarray:
    """Weights (series × 4) by the one-step errors of the weeks before ``upto``."""
    grid = np.array([g for g in GRID if damped or g[3] == 1.0])
    low = LOW if damped else np.append(LOW[:3], 1.0)
    rows = np.arange(len(y))
    sse = smooth(y, np.broadcast_to(grid, (len(y), *grid.shape)), periods, upto)[0]
    best, error = grid[sse.argmin(axis=1)], sse.min(axis=1)
    step = np.tile(FIRST_STEP, (len(y), 1))
    moves = np.concatenate([np.eye(4), -np.eye(4)])
    for _ in range(ROUNDS):
        tried = np.clip(best[:, None, :] + moves[None] * step[:, None, :], low, HIGH)
        sse = smooth(y, tried, periods, upto)[0]
        at, least = sse.argmin(axis=1), sse.min(axis=1)
        better = least < error
        best = np.where(better[:, None], tried[rows, at], best)
        error = np.where(better, least, error)
        step = np.where(better[:, None], step, step / 2)
    return best


def forecasts(y: np.ndarray, periods: int, horizons: Sequence[int], refit_weeks: int, damped: bool, weights: Sequence[float] | None) -> np.ndarray:
    """Forecasts of every week (series × weeks × horizons)."""
    count, weeks = y.shape
    out = np.repeat(y[:, :, None], len(horizons), axis=2)  # too early for a season: the last value
    if weights is not None:
        given = np.broadcast_to(np.array(weights, float), (count, 1, 4))
        if weeks >= periods:
            out[:, periods - 1 :] = smooth(y, given, periods, weeks, horizons, periods - 1)[1][:, 0]
        return out
    for at in range(periods, weeks + 1, refit_weeks):
        end = min(at + refit_weeks - 1, weeks)  # weeks at-1 to end-1 use the fit of the weeks before at
        chosen = fit(y, periods, at, damped)[:, None, :]
        out[:, at - 1 : end] = smooth(y, chosen, periods, end, horizons, at - 1)[1][:, 0]
    return out


def seasonal_states(
    panel: DataFrame,
    horizons: Sequence[int],
    keys: Sequence[str] = ("series_id",),
    periods: int = 52,
    refit_weeks: int = 13,
    damped: bool = True,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """The dense panel with ``made``, an array of forecasts from each row on, one per horizon of at
    most a season. ``weights`` (level, trend, season, damping) replaces the fit."""
    if max(horizons) > periods:
        raise ValueError("a horizon is longer than the season")
    keys = list(keys)
    pairs = F.array_sort(F.collect_list(F.struct("week_start", F.col("sales_units").cast("double").alias("y"))))
    series = panel.groupBy(*keys).agg(F.min("category").alias("category"), pairs.alias("_pairs")).select(
        *keys, "category", F.transform("_pairs", lambda p: p["week_start"]).alias("weeks"), F.transform("_pairs", lambda p: p["y"]).alias("values")
    )
    types = dict(series.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "category"]) + ", week_start date, sales_units double, made array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["values"].map(len).to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                for k in range(0, len(at), CHUNK):
                    some = batch.iloc[at[k : k + CHUNK]]
                    y = np.array(some["values"].tolist(), float)
                    made = forecasts(y, periods, list(horizons), refit_weeks, damped, weights)
                    out = {c: np.repeat(some[c].to_numpy(), n) for c in [*keys, "category"]}
                    out["week_start"] = np.concatenate([np.asarray(w) for w in some["weeks"]])
                    out["sales_units"] = y.ravel()
                    out["made"] = list(made.reshape(-1, len(horizons)))
                    yield pd.DataFrame(out)

    return spread(series, keys).mapInPandas(run, schema)
