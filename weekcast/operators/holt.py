"""Holt's linear trend, its two weights chosen per series and week from a grid; with a season on
request (``smoothing``)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.operators.baselines import at_last_week, at_origin
from weekcast.operators.features import series_order
from weekcast.operators.seasonality import spread
from weekcast.operators.smoothing import seasonal_states

# The grid of level and trend weights, and the shortest fitted history.
ALPHAS = tuple(k / 10 for k in range(1, 11))
BETAS = tuple(k / 10 for k in range(0, 9))
MIN_HISTORY = 8
_CHUNK = 512


def _smooth(y: np.ndarray, alphas: np.ndarray, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and trend after each week (series × weeks) of the grid point with the least
    one-step squared error so far. All series and grid points advance together."""
    count, weeks = y.shape
    level = np.repeat(y[:, :1], len(alphas), axis=1)
    trend = np.zeros_like(level)
    sse = np.zeros_like(level)
    levels, trends = y.copy(), np.zeros_like(y)
    rows = np.arange(count)
    for t in range(1, weeks):
        ahead = level + trend
        error = y[:, t : t + 1] - ahead
        sse += error * error
        level = ahead + alphas * error
        trend = trend + alphas * betas * error
        if t + 1 >= MIN_HISTORY:
            best = np.argmin(sse, axis=1)
            levels[:, t] = level[rows, best]
            trends[:, t] = trend[rows, best]
    return levels, trends


def holt_states(
    panel: DataFrame,
    keys: Sequence[str] = ("series_id",),
    alphas: Sequence[float] = ALPHAS,
    betas: Sequence[float] = BETAS,
) -> DataFrame:
    """The dense panel with ``level`` and ``trend`` fitted on the weeks up to each row.

    One pass over a series yields the fit at every origin. A series is one row holding
    its weeks, so tasks stay even however many series there are. Histories shorter than
    eight weeks keep the last value and no trend.
    """
    grid = np.array([(a, b) for a in alphas for b in betas])
    keys = list(keys)
    pairs = F.array_sort(
        F.collect_list(F.struct("week_start", F.col("sales_units").cast("double").alias("y")))
    )
    series = (
        panel.groupBy(*keys)
        .agg(F.min("category").alias("category"), pairs.alias("_pairs"))
        .select(
            *keys,
            "category",
            F.transform("_pairs", lambda p: p["week_start"]).alias("weeks"),
            F.transform("_pairs", lambda p: p["y"]).alias("values"),
        )
    )
    types = dict(series.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "category"])
    schema += ", week_start date, sales_units double, level double, trend double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _CHUNK):
                yield _run_chunk(batch.iloc[start : start + _CHUNK], keys, grid)

    return spread(series, keys).mapInPandas(run, schema)


def _run_chunk(chunk: pd.DataFrame, keys: list[str], grid: np.ndarray) -> pd.DataFrame:
    lengths = chunk["values"].map(len).to_numpy()
    padded = np.full((len(chunk), lengths.max()), np.nan)
    for row, values in enumerate(chunk["values"]):
        padded[row, : len(values)] = values
    # Weeks past the end of a shorter series hold NaN and are dropped below.
    levels, trends = _smooth(padded, grid[:, 0], grid[:, 1])
    kept = np.arange(padded.shape[1]) < lengths[:, None]
    out = {c: np.repeat(chunk[c].to_numpy(), lengths) for c in [*keys, "category"]}
    out["week_start"] = np.concatenate([np.asarray(w) for w in chunk["weeks"]])
    out["sales_units"] = padded[kept]
    out["level"] = levels[kept]
    out["trend"] = trends[kept]
    return pd.DataFrame(out)


def _ahead(h: int, alignment: str, order: Window) -> Column:
    if alignment == "target":
        return F.col("level") + h * F.col("trend")
    return F.lag("level", h).over(order) + h * F.lag("trend", h).over(order)


def _with_forecasts(
    panel: DataFrame, horizons: Sequence[int], alignment: str, keys: Sequence[str], seasonal: str | None, settings: dict
) -> DataFrame:
    """The panel's rows with ``_made``, a forecast per horizon."""
    order = series_order(keys)
    if seasonal is None:
        return holt_states(panel, keys).withColumn("_made", F.array(*[_ahead(h, alignment, order) for h in horizons]))
    if seasonal != "add":
        raise ValueError(f"unknown season {seasonal!r}")
    settings = {("periods" if k == "seasonal_periods" else k): v for k, v in settings.items()}
    states = seasonal_states(panel, horizons, keys, **settings)
    if alignment == "target":
        return states.withColumnRenamed("made", "_made")
    late = [F.lag(F.element_at("made", k + 1), h).over(order) for k, h in enumerate(horizons)]
    return states.withColumn("_made", F.array(*late))


def latest_holt(
    panel: DataFrame, segments: DataFrame, horizons: Sequence[int], alignment: str = "target", seasonal: str | None = None, **settings
) -> DataFrame:
    """Forecasts from the last week; no actuals are needed."""
    states = _with_forecasts(panel, horizons, alignment, ("series_id",), seasonal, settings)
    made = at_last_week(states, segments, horizons, F.col("_made"))
    return made.withColumn("model_name", F.lit("ets")).withColumn("model_family", F.lit("statistical"))


def holt(
    panel: DataFrame,
    segments: DataFrame,
    windows: DataFrame,
    horizons: Sequence[int] = tuple(range(1, 9)),
    alignment: str = "target",
    keys: Sequence[str] = ("series_id",),
    seasonal: str | None = None,
    **settings,
) -> DataFrame:
    """Backtest predictions; ``seasonal="add"`` with the settings of ``seasonal_states``
    (``seasonal_periods``, ``refit_weeks``, ``damped``, ``weights``) adds a season.

    ``"target"`` projects the fit at the origin ``h`` weeks ahead, onto the week it is
    scored on. ``"reference"`` projects the fit at the training end, ``h`` weeks before
    the origin, by ``h`` weeks: that is a forecast of the origin week itself, scored
    against the week ``h`` later.
    """
    if alignment not in ("target", "reference"):
        raise ValueError(f"unknown alignment {alignment!r}")
    order = series_order(keys)

    table = _with_forecasts(panel, horizons, alignment, keys, seasonal, settings).withColumns(
        {f"target_h{h}": F.lead("sales_units", h).over(order) for h in horizons}
    )
    extra = [k for k in keys if k != "series_id"]
    slot = F.array_position(F.array(*[F.lit(h) for h in horizons]), F.col("horizon")).cast("int")
    return (
        at_origin(table, windows, horizons, [k for k in extra if k in windows.columns])
        .join(segments.select(*keys, "segment_label"), list(keys), "left")
        .select(
            *extra,
            F.lit("ets").alias("model_name"),
            F.lit("statistical").alias("model_family"),
            "series_id",
            "category",
            "segment_label",
            "forecast_origin",
            "target_date",
            "horizon",
            "actual",
            F.element_at("_made", slot).alias("prediction"),
        )
    )
