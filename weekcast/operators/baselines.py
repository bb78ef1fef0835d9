"""Naive and seasonal naive forecasts over backtest windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import plus_weeks
from weekcast.operators.features import series_order

SEASON = 52
_VALUES = 1 << 21  # weeks of a batch that are counted at once


def at_origin(
    table: DataFrame, windows: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ()
) -> DataFrame:
    """Rows of the origin weeks, one per window, with the target of its horizon.

    Without keys the window list grows with the calendar only (weeks × horizons), so it
    is joined by broadcast; with keys, such as scenarios, Spark picks the join by size.
    """
    targets = F.array(*[F.col(f"target_h{h}") for h in horizons])
    slot = F.array_position(F.array(*[F.lit(h) for h in horizons]), F.col("horizon"))
    wanted = windows.select(
        *keys, F.col("forecast_origin").alias("week_start"), "horizon", "test_start"
    )
    return (
        table.join(wanted if keys else F.broadcast(wanted), [*keys, "week_start"])
        .withColumn("actual", F.element_at(targets, slot.cast("int")))
        .where(F.col("actual").isNotNull())
        .withColumnsRenamed({"week_start": "forecast_origin", "test_start": "target_date"})
    )


def _forecasts(order: Window, alignment: str, horizons: Sequence[int]) -> dict[str, Column]:
    """Arrays of one value per horizon."""
    y = F.col("sales_units")
    last = F.lag(y, 1).over(order)
    if alignment == "reference":
        naive = F.array(*[last for _ in horizons])
        seasonal = F.array(*[F.coalesce(F.lag(y, SEASON).over(order), last) for _ in horizons])
    elif alignment == "target":
        naive = F.array(*[y for _ in horizons])
        seasonal = F.array(
            *[F.coalesce(F.lag(y, SEASON - h).over(order), y) for h in horizons]
        )
    else:
        raise ValueError(f"unknown alignment {alignment!r}")
    return {"naive": naive, "seasonal_naive": seasonal}


def baselines(
    panel: DataFrame,
    segments: DataFrame,
    windows: DataFrame,
    models: Sequence[str] = ("naive", "seasonal_naive"),
    horizons: Sequence[int] = tuple(range(1, 9)),
    alignment: str = "reference",
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Predictions of both baselines from one pass over the panel.

    ``alignment="reference"`` returns y(origin−1) and y(origin−52) for every horizon;
    ``"target"`` returns y(origin) and y(origin+h−52).
    """
    order = series_order(keys)
    made = _forecasts(order, alignment, horizons)
    table = panel.withColumns(
        {
            **{f"target_h{h}": F.lead("sales_units", h).over(order) for h in horizons},
            **{f"_{m}": made[m] for m in models},
        }
    )
    extra = [k for k in keys if k != "series_id"]
    slot = F.array_position(F.array(*[F.lit(h) for h in horizons]), F.col("horizon")).cast("int")
    rows = at_origin(table, windows, horizons, [k for k in extra if k in windows.columns])
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("model_name"), F.element_at(f"_{m}", slot).alias("prediction")
            )
            for m in models
        ]
    )
    return (
        rows.join(segments.select(*keys, "segment_label"), list(keys), "left")
        .withColumn("_made", F.explode(pairs))
        .select(
            *extra,
            F.col("_made.model_name").alias("model_name"),
            F.lit("baseline").alias("model_family"),
            "series_id",
            "category",
            "segment_label",
            "forecast_origin",
            "target_date",
            "horizon",
            "actual",
            F.col("_made.prediction").alias("prediction"),
        )
    )


def baseline_counts(
    histories: DataFrame,
    windows: DataFrame,
    by: Sequence[str] = ("segment_label",),
    models: Sequence[str] = ("naive", "seasonal_naive"),
    alignment: str = "reference",
) -> DataFrame:
    """The rows of ``baselines`` with equal ones counted: ``model_name``, the columns ``by`` (of the
    series, or ``horizon``), ``actual``, ``prediction`` and their number ``rows``.

    ``histories`` has a row per series (``dense_histories``) with the columns ``by``. A task fills
    the weeks of some series into a matrix, of which the targets and forecasts of a window are
    columns; a row leaves it per pair of values, so the predictions never become rows.
    """
    if alignment not in ("reference", "target"):
        raise ValueError(f"unknown alignment {alignment!r}")
    named = [c for c in by if c != "horizon"]
    origins: dict[int, list[int]] = {}
    # One row per week of the calendar and horizon.
    for r in windows.select("horizon", F.unix_date("forecast_origin").alias("day")).collect():
        origins.setdefault(r["horizon"], []).append(r["day"])
    kinds = {"horizon": "int", **dict(histories.dtypes)}
    schema = ", ".join(["model_name string", *[f"{c} {kinds[c]}" for c in by], "actual double", "prediction double", "rows bigint"])
    series = histories.select(
        *named,
        F.unix_date("start_date").alias("_start"),
        (F.floor(F.datediff("end_date", "start_date") / 7) + 1).cast("int").alias("_weeks"),
        F.col("seen.at").alias("_at"),
        F.col("seen.units").alias("_units"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _count_pairs(batch, named, "horizon" in by, origins, models, alignment, list(by))

    return series.mapInArrow(run, schema)


def _count_pairs(batch, named, keep_horizon, origins, models, alignment, by) -> Iterator[pa.RecordBatch]:
    """Counted pairs of the series of a batch; value numbers stand for values until they leave."""
    places: dict[tuple, int] = {}
    owners = zip(*[batch[c].to_pylist() for c in named]) if named else [()] * batch.num_rows
    group = np.array([places.setdefault(x, len(places)) for x in owners], np.int64)
    spans, which = np.unique(
        np.stack([batch["_start"].to_numpy(), batch["_weeks"].to_numpy()]), axis=1, return_inverse=True
    )
    at, bounds = batch["_at"].flatten().to_numpy(), batch["_at"].offsets.to_numpy()
    bounds = bounds - bounds[0]
    values, number = np.unique(np.append(batch["_units"].flatten().to_numpy(), 0.0), return_inverse=True)
    zero, none, k = number[-1], len(values), len(values) + 1
    found: dict[tuple, list] = {}
    for span, (start, weeks) in enumerate(spans.T):
        members = np.flatnonzero(which.ravel() == span)
        for some in np.array_split(members, max(1, -(-len(members) * int(weeks) // _VALUES))):
            lengths = bounds[some + 1] - bounds[some]
            cells = np.repeat(bounds[some] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            y = np.full((len(some), weeks), zero, np.int64)
            y[np.repeat(np.arange(len(some)), lengths), at[cells]] = number[cells]
            for h, days in origins.items():
                days = np.asarray(days) - start
                o = days[(days % 7 == 0) & (days >= 0) & (days < 7 * (weeks - h))] // 7
                if len(some) and len(o):
                    pairs = (group[some, None] * k + y[:, o + h]) * k
                    for m in models:
                        keys = pairs + _forecast_numbers(y, o, h, m, alignment, none)
                        found.setdefault((m, h if keep_horizon else None), []).append(_tally(keys, len(places) * k * k))
    known = np.append(values, np.nan)
    for (m, h), parts in found.items():
        keys, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, where.ravel(), np.concatenate([x for _, x in parts]))
        pair, missing = keys % (k * k), keys % k == none
        owner = pa.array(keys // (k * k))
        columns = {
            "model_name": pa.array([m] * len(keys), pa.string()),
            "horizon": pa.array([h] * len(keys), pa.int32()),
            **{c: pa.array([x[i] for x in places], batch.schema.field(c).type).take(owner) for i, c in enumerate(named)},
            "actual": pa.array(known[pair // k]),
            "prediction": pa.array(known[pair % k], mask=missing),
            "rows": pa.array(n),
        }
        yield pa.RecordBatch.from_pydict({c: columns[c] for c in ["model_name", *by, "actual", "prediction", "rows"]})


def _forecast_numbers(y, o, h, model, alignment, none) -> np.ndarray:
    """Value numbers of the forecasts from the weeks ``o``; ``none`` where there is no value."""
    before = 1 if alignment == "reference" else 0
    last = y[:, np.maximum(o - before, 0)]
    last[:, o < before] = none
    back = o - SEASON + (0 if alignment == "reference" else h)
    if model == "seasonal_naive":
        last[:, back >= 0] = y[:, back[back >= 0]]
    return last


def _tally(keys: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    if bins > 2 * keys.size:
        return np.unique(keys, return_counts=True)
    counts = np.bincount(keys.ravel(), minlength=bins)
    return np.flatnonzero(counts), counts[counts > 0]


def at_last_week(table: DataFrame, segments: DataFrame, horizons: Sequence[int], guesses: Column) -> DataFrame:
    """``guesses``, an array of one value per horizon, of the last week's rows, one row each."""
    last = table.agg(F.max("week_start")).scalar()
    rows = table.withColumn("_guesses", guesses).withColumn("_last", last).where("week_start = _last")
    named = F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("horizon"), F.col("_guesses").alias("prediction"))
    return (
        rows.join(segments.select("series_id", "segment_label"), "series_id", "left")
        .withColumn("_x", F.explode(named))
        .select("series_id", "category", "segment_label", F.col("week_start").alias("forecast_origin"), "_x.*")
    )


def latest_baseline(
    panel: DataFrame, segments: DataFrame, model_name: str, horizons: Sequence[int], alignment: str = "reference"
) -> DataFrame:
    """Forecasts of a baseline from the last week; no actuals are needed."""
    guesses = _forecasts(series_order(), alignment, horizons)[model_name]
    made = at_last_week(panel.withColumn("_made", guesses), segments, horizons, F.col("_made"))
    return made.withColumn("model_name", F.lit(model_name)).withColumn("model_family", F.lit("baseline"))


def incomplete_predictions(predictions: DataFrame) -> DataFrame:
    """Rows a backtest must not contain; an empty result is a pass."""
    return predictions.where(F.col("actual").isNull() | F.col("prediction").isNull())


def demo_forecast(
    frame: DataFrame, horizon_weeks: int, model_name: str = "seasonal_naive"
) -> DataFrame:
    """Aligned baseline for every series of a scenario panel, clipped at zero.

    The last ``horizon_weeks`` weeks are forecast from the history before them; with
    less than a season of history the last value is repeated.
    """
    keys = ["scenario_name", "series_id"]
    order = Window.partitionBy(*keys).orderBy("week_start")
    series = Window.partitionBy(*keys)
    y = F.col("sales_units")
    origin = F.max(F.when(F.col("is_history"), F.col("week_start"))).over(series)
    history = F.sum(F.col("is_history").cast("int")).over(series)
    last = F.max(F.when(F.col("week_start") == F.col("forecast_origin"), y)).over(series)
    seasonal = F.when(F.col("_history") >= SEASON, F.col("_year_ago"))
    guess = F.coalesce(seasonal, F.col("_last")) if model_name == "seasonal_naive" else F.col("_last")
    return (
        frame.withColumns(
            {"forecast_origin": origin, "_history": history, "_year_ago": F.lag(y, SEASON).over(order)}
        )
        .withColumn("_last", last)
        .where(~F.col("is_history"))
        .withColumn("horizon", (F.datediff("week_start", "forecast_origin") / 7).cast("int"))
        .where(F.col("horizon") <= horizon_weeks)
        .select(
            *keys,
            "category",
            F.lit(model_name).alias("model_name"),
            "forecast_origin",
            F.col("week_start").alias("target_date"),
            "horizon",
            y.alias("actual"),
            F.round(F.greatest(guess, F.lit(0.0)), 3).alias("prediction"),
        )
    )
