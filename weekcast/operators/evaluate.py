"""Metrics, rankings and diagnostics of prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import ratio
from weekcast.functions.errors import METRICS, error_terms, metric_from_sums
from weekcast.operators.ranking import at_quantile, running

BASELINE = "seasonal_naive"


def metrics(
    predictions: DataFrame, by: Sequence[str] = ("model_name",), names: Sequence[str] = METRICS
) -> DataFrame:
    """The named metrics per group; rows with a null group value are skipped. A column ``rows``
    (``baseline_counts``) says how many predictions a row stands for.

    Without the median they are plain sums, added up map-side: one exchange of a row per
    group and task. With it, rows are first summed per distinct absolute error; the exact
    median is read off the ranked errors and the other metrics from the same sums, so the
    predictions are scanned once and no group is gathered in one task.
    """
    by = list(by)
    rows = predictions
    for b in by:
        rows = rows.where(F.col(b).isNotNull())
    if "MedianAE" not in names:
        terms = rows.withColumns(error_terms()).groupBy(*by).agg(
            F.sum(_weight(rows)).alias("n"),
            _sum(rows, F.col("error") * F.col("error")).alias("sq_error"),
            *[_sum(rows, c).alias(c) for c in ("abs_error", "error", "abs_actual", "smape_term")],
        )
        return terms.select(*by, *[metric_from_sums(m).alias(m) for m in names])
    cells = (
        rows.withColumns(error_terms())
        .groupBy(*by, "abs_error")
        .agg(
            F.sum(_weight(rows)).alias("cnt"),
            _sum(rows, "error").alias("error"),
            _sum(rows, "abs_actual").alias("abs_actual"),
            _sum(rows, "smape_term").alias("smape_term"),
        )
    )
    ranked = running(cells, [F.col("abs_error")], by, ["cnt"])
    weighted = F.col("abs_error") * F.col("cnt")
    sums = ranked.groupBy(*by).agg(
        at_quantile("cum_cnt", "cnt", "total_cnt", "abs_error", 0.5).alias("MedianAE"),
        F.sum("cnt").alias("n"),
        F.sum(weighted).alias("abs_error"),
        F.sum(weighted * F.col("abs_error")).alias("sq_error"),
        F.sum("error").alias("error"),
        F.sum("abs_actual").alias("abs_actual"),
        F.sum("smape_term").alias("smape_term"),
    )
    made = [metric_from_sums(m).alias(m) if m != "MedianAE" else F.col(m) for m in names]
    return sums.select(*by, *made)


def _weight(predictions: DataFrame) -> Column:
    return F.col("rows") if "rows" in predictions.columns else F.lit(1)


def _sum(predictions: DataFrame, term: str | Column) -> Column:
    value = F.col(term) if isinstance(term, str) else term
    return F.sum(value * F.col("rows") if "rows" in predictions.columns else value)


# The cuts of a comparison: every table of metrics, by the columns it groups by.
CUTS = {
    "overall": ("model_name",),
    "by_horizon": ("model_name", "horizon"),
    "by_segment": ("model_name", "segment_label"),
    "by_category": ("model_name", "category"),
}


def metrics_by_cuts(predictions: DataFrame, cuts: Mapping[str, Sequence[str]] = CUTS) -> DataFrame:
    """All metrics of several groupings: ``cut``, the columns of all of them (null where a cut
    doesn't group by one) and the metrics.

    The predictions are scanned and shuffled once, to one row per distinct error within the
    finest groups; those rows are handed to every cut, and one ranking gives all medians. Rows
    with a null group value are skipped by the cuts that use it. Counted predictions (``rows``)
    count as often.
    """
    keys = list(dict.fromkeys(k for by in cuts.values() for k in by))
    kinds = dict(predictions.dtypes)
    sums = ("cnt", "error", "abs_actual", "smape_term")
    finest = (
        predictions.withColumns(error_terms())
        .groupBy(*keys, "abs_error")
        .agg(F.sum(_weight(predictions)).alias("cnt"), *[_sum(predictions, c).alias(c) for c in sums[1:]])
    )
    handed = []
    for name, by in cuts.items():
        own = [(F.col(k) if k in by else F.lit(None).cast(kinds[k])).alias(k) for k in keys]
        known = F.lit(True)
        for k in by:
            known = known & F.col(k).isNotNull()
        handed.append(F.when(known, F.struct(F.lit(name).alias("cut"), *own)))
    placed = finest.select(F.explode(F.array_compact(F.array(*handed))).alias("g"), "abs_error", *sums)
    group = ["cut", *keys]
    cells = placed.groupBy("g", "abs_error").agg(*[F.sum(c).alias(c) for c in sums]).select("g.*", "abs_error", *sums)
    ranked = running(cells, [F.col("abs_error")], group, ["cnt"])
    weighted = F.col("abs_error") * F.col("cnt")
    summed = ranked.groupBy(*group).agg(
        at_quantile("cum_cnt", "cnt", "total_cnt", "abs_error", 0.5).alias("MedianAE"),
        F.sum("cnt").alias("n"),
        F.sum(weighted).alias("abs_error"),
        F.sum(weighted * F.col("abs_error")).alias("sq_error"),
        *[F.sum(c).alias(c) for c in sums[1:]],
    )
    return summed.select(*group, *[metric_from_sums(m).alias(m) if m != "MedianAE" else F.col(m) for m in METRICS])


def cut_of(table: DataFrame, name: str, cuts: Mapping[str, Sequence[str]] = CUTS) -> DataFrame:
    """One grouping of a written table of ``metrics_by_cuts``."""
    return table.where(F.col("cut") == name).select(*cuts[name], *METRICS)


def overall(predictions: DataFrame) -> DataFrame:
    return metrics(predictions, ["model_name"]).orderBy("WAPE", "model_name")


def by_horizon(predictions: DataFrame) -> DataFrame:
    return metrics(predictions, ["model_name", "horizon"]).orderBy("model_name", "horizon")


def best_model(table: DataFrame, allowed: Sequence[str] | None = None) -> DataFrame:
    """The allowed model with the lowest WAPE, ties by name."""
    rows = table if allowed is None else table.where(F.col("model_name").isin(list(allowed)))
    return rows.select("model_name", "WAPE").orderBy(F.asc_nulls_last("WAPE"), "model_name").limit(1)


def leader_predictions(predictions: DataFrame, table: DataFrame) -> DataFrame:
    return predictions.join(best_model(table), "model_name", "left_semi")


def rolling_vs_holdout(predictions: DataFrame) -> DataFrame:
    """Error over all origins against the single last origin, with its spread."""
    per_origin = (
        predictions.withColumns(error_terms())
        .groupBy("model_name", "forecast_origin")
        .agg(F.sum("abs_error").alias("abs_error"), F.sum("abs_actual").alias("abs_actual"))
        .withColumn("_wape", ratio("abs_error", "abs_actual"))
    )
    last = per_origin.agg(F.max("forecast_origin")).scalar()
    std = F.stddev_samp("_wape")
    return (
        per_origin.withColumn("_last", last)
        .groupBy("model_name")
        .agg(
            F.count(F.lit(1)).alias("origins_count"),
            ratio(F.sum("abs_error"), F.sum("abs_actual")).alias("rolling_WAPE"),
            F.max(F.when(F.col("forecast_origin") == F.col("_last"), F.col("_wape"))).alias(
                "holdout_WAPE_last_origin"
            ),
            F.when(F.count(F.lit(1)) > 1, std).alias("origin_WAPE_std"),
        )
        .withColumns(
            {
                "holdout_minus_rolling_WAPE": F.col("holdout_WAPE_last_origin")
                - F.col("rolling_WAPE"),
                "rolling_WAPE_standard_error": F.col("origin_WAPE_std")
                / F.sqrt(F.col("origins_count").cast("double")),
                "variance_reduction_factor_vs_single_holdout": F.col("origins_count").cast("double"),
            }
        )
    )


CASE_KEY = ("series_id", "forecast_origin", "target_date", "horizon", "actual")


def gains(predictions: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Absolute error gain of every other model over the baseline on the same case.

    The baseline row travels to its case by a window over the handful of models of
    that case: one shuffle instead of a self-join.
    """
    case = Window.partitionBy(*CASE_KEY)
    is_base = F.col("model_name") == baseline
    return (
        predictions.withColumn(
            "baseline_prediction", F.max(F.when(is_base, F.col("prediction"))).over(case)
        )
        .where(~is_base & F.col("baseline_prediction").isNotNull())
        .withColumns(
            {
                "model_abs_error": F.abs(F.col("prediction") - F.col("actual")),
                "baseline_abs_error": F.abs(F.col("baseline_prediction") - F.col("actual")),
            }
        )
        .withColumn(
            "abs_error_gain_vs_baseline", F.col("baseline_abs_error") - F.col("model_abs_error")
        )
    )


def error_cases(predictions: DataFrame, baseline: str = BASELINE, top_n: int = 20) -> DataFrame:
    """The ``top_n`` largest gains and losses against the baseline, ties by case key."""
    table = gains(predictions, baseline)
    gain = F.col("abs_error_gain_vs_baseline")
    ties = ["model_name", "series_id", "forecast_origin", "horizon"]
    wins = table.orderBy(gain.desc(), *ties).limit(top_n)
    losses = table.orderBy(gain.asc(), *ties).limit(top_n)
    both = wins.withColumn("case_type", F.lit("best_win")).unionByName(
        losses.withColumn("case_type", F.lit("worst_loss"))
    )
    return both.select(
        "case_type",
        "model_name",
        "series_id",
        "category",
        "segment_label",
        "forecast_origin",
        "target_date",
        "horizon",
        "actual",
        "prediction",
        "baseline_prediction",
        "model_abs_error",
        "baseline_abs_error",
        "abs_error_gain_vs_baseline",
    )


def ranking(table: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """WAPE per model with its distance to the leader and to the baseline."""
    lead = table.agg(F.min("WAPE")).scalar()
    base = table.where(F.col("model_name") == baseline).agg(F.max("WAPE")).scalar()
    return table.select("model_name", "WAPE").withColumns(
        {"gap_to_leader": F.col("WAPE") - lead, "gap_to_baseline": F.col("WAPE") - base}
    )


def best_per_segment(by_segment: DataFrame) -> DataFrame:
    order = Window.partitionBy("segment_label").orderBy(F.asc_nulls_last("WAPE"), "model_name")
    return (
        by_segment.withColumn("_n", F.row_number().over(order))
        .where("_n = 1")
        .select("segment_label", "model_name", "WAPE")
    )


def best_row(table: DataFrame) -> DataFrame:
    """The scenario and horizon with the lowest WAPE."""
    order = [F.asc_nulls_last("WAPE"), "scenario_name", "horizon"]
    return table.orderBy(*order).limit(1)


def scenario_coverage(frame: DataFrame) -> DataFrame:
    return frame.groupBy("scenario_name").agg(
        F.countDistinct("series_id").alias("series"), F.count(F.lit(1)).alias("rows")
    )
