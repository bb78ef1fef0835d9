"""Leakage-safe features: lags, past-only rolling statistics, calendar, codes, targets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import clean, ratio
from weekcast.functions.columns import total as array_total
from weekcast.operators.ranking import codes

# The groups each feature set turns on.
FEATURE_SETS = {
    "F0": (),
    "F1": ("lags",),
    "F2": ("lags", "rolling"),
    "F3": ("lags", "rolling", "calendar"),
    "F4": ("lags", "rolling", "calendar", "categorical"),
    "F5": ("lags", "rolling", "calendar", "categorical", "price_promo"),
    "F6": ("lags", "rolling", "calendar", "categorical", "price_promo"),
}
# The calendar columns of the supervised table.
CALENDAR = ("week_of_year", "month", "quarter", "year", "week_in_month")


@dataclass(frozen=True)
class Features:
    feature_set: str = "F4"
    lags: tuple[int, ...] = (1, 2, 3, 4, 8, 12, 13, 26, 52)
    rolling_windows: tuple[int, ...] = (4, 8, 13, 26)
    use_calendar: bool = True
    use_category_encodings: bool = True
    use_price: bool = False
    use_promo: bool = False

    def has(self, group: str) -> bool:
        return group in FEATURE_SETS[self.feature_set]


def series_order(keys: Sequence[str] = ("series_id",)) -> Window:
    return Window.partitionBy(*keys).orderBy("week_start")


def lag_columns(order: Window, lags: Sequence[int]) -> dict[str, Column]:
    """Lags count rows, so the panel must be dense."""
    return {f"lag_{k}": F.lag("sales_units", k).over(order) for k in lags}


def rolling_columns(order: Window, windows: Sequence[int]) -> dict[str, Column]:
    """Statistics of the ``w`` weeks before the row; null until all ``w`` are known."""
    y = F.col("sales_units")
    last = F.lag(y, 1).over(order)
    columns: dict[str, Column] = {}
    for w in windows:
        past = order.rowsBetween(-w, -1)
        full = F.count(y).over(past) == w
        mean = F.when(full, F.avg(y).over(past))
        columns |= {
            f"rolling_{w}_mean": mean,
            f"rolling_{w}_median": F.when(full, F.percentile(y, 0.5).over(past)),
            f"rolling_{w}_std": F.when(full, F.stddev_samp(y).over(past)),
            f"rolling_{w}_min": F.when(full, F.min(y).over(past)),
            f"rolling_{w}_max": F.when(full, F.max(y).over(past)),
            f"rolling_{w}_ratio_to_rolling_mean": ratio(last, mean),
            f"rolling_{w}_recent_trend_delta": last - F.lag(y, w).over(order),
        }
    return columns


def calendar_columns(week: str = "week_start") -> dict[str, Column]:
    return {
        "week_of_year": F.weekofyear(week),
        "month": F.month(week),
        "quarter": F.quarter(week),
        "year": F.year(week),
        "week_in_month": (F.floor((F.dayofmonth(week) - 1) / 7) + 1).cast("int"),
    }


def target_columns(order: Window, horizons: Sequence[int]) -> dict[str, Column]:
    return {f"target_h{h}": F.lead("sales_units", h).over(order) for h in horizons}


def trailing_mean(panel: DataFrame, rows: int = 10) -> DataFrame:
    """Mean of the last ``rows`` rows, the current one included."""
    frame = series_order().rowsBetween(-(rows - 1), 0)
    return panel.withColumn(f"rolling_{rows}", F.avg("sales_units").over(frame))


def encode(panel: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segment label and integer codes, one row per series.

    Codes rank the distinct names; they are joined at series grain, so the weekly
    rows are joined only once, on the series key they are already partitioned by.
    """
    statics = [c for c in ("category", "sku") if c in panel.columns]
    series = panel.groupBy(*keys).agg(*[F.min(c).alias(c) for c in statics])
    labelled = series.join(segments.select(*keys, "segment_label"), list(keys), "left").withColumn(
        "_label", F.coalesce("segment_label", F.lit("unknown"))
    )
    out = labelled.join(_label_codes(labelled), "_label")
    for name in statics:
        # A series without the name keeps its row and gets the code -1.
        code = f"{name}_code"
        out = out.join(codes(series, name, code), name, "left").withColumn(code, F.coalesce(code, F.lit(-1)))
    return out.drop("_label", *statics)


def _label_codes(labelled: DataFrame) -> DataFrame:
    """Codes of the labels present; there are at most five, so one plain window does."""
    rank = F.row_number().over(Window.orderBy("_label"))
    present = labelled.select("_label").distinct()
    return present.select("_label", (rank - 1).cast("int").alias("segment_code"))


def feature_names(panel_columns: Sequence[str], features: Features) -> list[str]:
    names: list[str] = []
    if features.has("lags"):
        names += [f"lag_{k}" for k in features.lags]
    if features.has("rolling"):
        names += list(rolling_names(features.rolling_windows))
    if features.has("calendar") and features.use_calendar:
        names += list(CALENDAR)
    if features.has("categorical") and features.use_category_encodings:
        names += ["category_code", "segment_code"]
        names += ["sku_code"] if "sku" in panel_columns else []
    if features.has("price_promo"):
        names += ["price"] if features.use_price else []
        names += ["promo"] if features.use_promo else []
    return names


def rolling_names(windows: Sequence[int]) -> list[str]:
    # The statistics kept per rolling window, in table order.
    stats = ("mean", "median", "std", "min", "max", "ratio_to_rolling_mean", "recent_trend_delta")
    return [f"rolling_{w}_{s}" for w in windows for s in stats]


def supervised(
    panel: DataFrame,
    segments: DataFrame,
    features: Features = Features(),
    horizons: Sequence[int] = tuple(range(1, 9)),
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Panel, segment label, features and ``target_h*``.

    All windows share one partitioning and one sort; no feature of week t reads a
    value later than t, only the targets do.
    """
    order = series_order(keys)
    columns = target_columns(order, horizons)
    if features.has("lags"):
        columns |= lag_columns(order, features.lags)
    if features.has("rolling"):
        columns |= rolling_columns(order, features.rolling_windows)
    if features.has("calendar") and features.use_calendar:
        columns |= calendar_columns()
    if features.has("price_promo") and features.use_price:
        columns["price"] = clean(F.col("price").cast("double"))
    if features.has("price_promo") and features.use_promo:
        columns["promo"] = F.coalesce(clean(F.col("promo").cast("double")), F.lit(0.0))
    y = clean(F.col("sales_units").cast("double"))
    wide = panel.withColumn("sales_units", y).withColumns(columns)
    if features.has("categorical") and features.use_category_encodings:
        per_series = encode(panel, segments, keys)
    else:
        per_series = segments.select(*keys, "segment_label")
    return wide.join(per_series, list(keys), "left")


def example_series(panel: DataFrame) -> DataFrame:
    """The highest-volume series of each category, ties by ``series_id``."""
    if "seen" in panel.columns:
        totals = panel.select("category", "series_id", array_total(F.col("seen.units")).alias("total"))
    else:
        totals = panel.groupBy("category", "series_id").agg(F.sum("sales_units").alias("total"))
    best = F.min(F.struct((-F.col("total")).alias("minus"), "series_id"))
    return (
        totals.groupBy("category")
        .agg(best.alias("b"))
        .select("category", "b.series_id", (-F.col("b.minus")).alias("total_sales_units"))
    )


def feature_snapshot(
    panel: DataFrame, segments: DataFrame, rows: int = 20, histories: DataFrame | None = None
) -> DataFrame:
    """Last ``rows`` rows, with ``lag_52`` where any exist, of each category's example series,
    which are found in the ``histories`` of the panel, if given."""
    chosen = example_series(panel if histories is None else histories).select("series_id")
    table = supervised(
        panel.join(chosen, "series_id", "left_semi"),
        segments.join(chosen, "series_id", "left_semi"),
        Features(),
        horizons=(),
    )
    series = Window.partitionBy("series_id")
    latest = series.orderBy(F.desc("week_start"))
    return (
        table.withColumn("_any", F.max(F.col("lag_52").isNotNull()).over(series))
        .where(F.col("lag_52").isNotNull() | ~F.col("_any"))
        .withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= rows)
        .select(*SNAPSHOT_COLUMNS)
    )


# Columns of the feature snapshot.
SNAPSHOT_COLUMNS = (
    "series_id",
    "category",
    "week_start",
    "sales_units",
    "segment_label",
    "lag_1",
    "lag_13",
    "lag_52",
    "rolling_4_mean",
    "rolling_13_mean",
    "rolling_4_ratio_to_rolling_mean",
    "rolling_13_recent_trend_delta",
    "week_of_year",
    "month",
    "quarter",
    "category_code",
    "segment_code",
)
