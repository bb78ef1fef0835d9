"""Forecast error terms and the metrics built from their sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekcast.functions.columns import ratio

# The metric names of every comparison table, in order.
METRICS = ("WAPE", "sMAPE", "MAE", "RMSE", "Bias", "MedianAE")


def error_terms(actual: str = "actual", prediction: str = "prediction") -> dict[str, Column]:
    a, p = F.col(actual), F.col(prediction)
    size = F.abs(a) + F.abs(p)
    return {
        "abs_error": F.abs(p - a),
        "error": p - a,
        "abs_actual": F.abs(a),
        "smape_term": 200 * F.abs(p - a) / F.when(size == 0, 1.0).otherwise(size),
    }


def metric_from_sums(name: str, prefix: str = "") -> Column:
    """A metric from the sums ``n, abs_error, error, sq_error, abs_actual, smape_term``."""

    def s(term: str) -> Column:
        return F.col(f"{prefix}{term}")

    return {
        "WAPE": ratio(s("abs_error"), s("abs_actual")),
        "sMAPE": ratio(s("smape_term"), s("n")),
        "MAE": ratio(s("abs_error"), s("n")),
        "RMSE": F.sqrt(ratio(s("sq_error"), s("n"))),
        "Bias": ratio(s("error"), s("n")),
    }[name]
