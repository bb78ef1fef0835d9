"""Autocorrelation functions, stationarity tests and seasonal decomposition per series.

A series has one value per week, so its whole history is an array of a few hundred
numbers; the tests work on one such array per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import dot, ratio, total
from weekcast.operators.features import series_order

# KPSS critical values for a constant level and their p-values.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
# MacKinnon's (1994) response surface for one series with a constant.
ADF_MAX, ADF_MIN, ADF_SWITCH = 2.74, -18.83, -1.61
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
SIGNIFICANCE = 0.05
MIN_TEST_WEEKS = 10
#: Numbers of a stack of regressors.
STACK = 1 << 21
PERIOD = 52


def histories(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per series with its known values in week order."""
    if "y" in panel.columns:
        return panel.select(*keys, "y")
    known = panel.where(F.col("sales_units").isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct("week_start", "sales_units")))
    return known.groupBy(*keys).agg(
        F.transform(pairs, lambda p: p["sales_units"].cast("double")).alias("y")
    )




def spread(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole-series rows over all shuffle partitions.

    The rows are few bytes but much work; adaptive execution would merge them into a
    few tasks by size.
    """
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.repartition(n, *keys)


def _residuals(series: DataFrame) -> DataFrame:
    """Add ``n``, ``e`` = values minus their mean, and ``ss`` = the sum of squares."""
    return (
        series.withColumn("n", F.size("y"))
        .withColumn("_mean", total(F.col("y")) / F.col("n"))
        .withColumn("e", F.transform("y", lambda v: v - F.col("_mean")))
        .withColumn("ss", dot(F.col("e"), F.col("e")))
    )


def _lag_product(k: Column, n: str = "n") -> Column:
    """Sum of e(t)·e(t−k)."""
    return dot(F.slice("e", k + 1, F.col(n) - k), F.slice("e", F.lit(1), F.col(n) - k))


def acf(panel: DataFrame, max_lag: int = 24, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Autocorrelation to lag min(max_lag, n//2 − 1) for series of 20 weeks or more."""
    top = F.least(F.lit(max_lag), F.floor(F.col("n") / 2).cast("int") - 1)
    return (
        _residuals(histories(panel, keys))
        .where((F.col("n") >= 20) & (F.col("ss") > 0))
        .select(*keys, "n", "e", "ss", F.explode(F.sequence(F.lit(0), top)).alias("lag"))
        .select(*keys, "lag", (_lag_product(F.col("lag")) / F.col("ss")).alias("acf"))
    )


def pacf(panel: DataFrame, max_lag: int = 24, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Partial autocorrelation by the Durbin–Levinson recursion on the ACF array."""
    per_series = (
        acf(panel, max_lag, keys)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_pairs"))
        .select(*keys, F.transform("_pairs", lambda p: p["acf"]).alias("r"))
    )
    empty = F.expr("array()").cast("array<double>")
    start = F.struct(empty.alias("phi"), empty.alias("out"))

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        earlier = F.slice("r", 2, k - 1)
        top = F.element_at("r", k + 1) - dot(phi, F.reverse(earlier))
        reflection = top / (1 - dot(phi, earlier))
        updated = F.zip_with(phi, F.reverse(phi), lambda a, b: a - reflection * b)
        return F.struct(
            F.concat(updated, F.array(reflection)).alias("phi"),
            F.concat(state["out"], F.array(reflection)).alias("out"),
        )

    folded = F.aggregate(
        F.sequence(F.lit(1), F.size("r") - 1), start, step, lambda s: s["out"]
    )
    values = F.concat(F.array(F.lit(1.0)), folded)
    return per_series.select(*keys, F.posexplode(values).alias("lag", "pacf"))


def _long_run_variance(lags: Column) -> Column:
    """Bartlett-weighted variance of the level with the given number of lags."""
    weighted = F.aggregate(
        F.sequence(F.lit(1), lags),
        F.lit(0.0),
        lambda acc, k: acc + 2 * _lag_product(k) * (1 - k / (lags + 1)),
    )
    return (F.col("ss") + F.when(lags > 0, weighted).otherwise(0.0)) / F.col("n")


def _auto_lags() -> Column:
    """Data-dependent lag count of the KPSS test (Hobijn, Franses and Ooms)."""
    n = F.col("n")
    first = F.floor(F.pow(n, F.lit(2 / 9))).cast("int")
    half = n / 2
    steps = F.sequence(F.lit(1), first)
    s0 = F.aggregate(steps, F.col("ss") / n, lambda acc, k: acc + _lag_product(k) / half)
    s1 = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + k * _lag_product(k) / half)
    bandwidth = 1.1447 * F.pow(F.pow(s1 / s0, F.lit(2.0)), F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3))
    return F.least(F.floor(bandwidth).cast("int"), n - 1)


def _kpss_p(stat: str) -> Column:
    """Linear interpolation in the critical values, clipped to the ends."""
    s = F.col(stat)
    p = F.when(s.isNull(), F.lit(None).cast("double")).when(
        s <= KPSS_CRITICAL[0][0], KPSS_CRITICAL[0][1]
    )
    for (c0, p0), (c1, p1) in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]):
        p = p.when(s <= c1, p0 + (s - c0) * ((p1 - p0) / (c1 - c0)))
    return p.otherwise(KPSS_CRITICAL[-1][1])


def kpss(panel: DataFrame, lags: int | None = None, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Level-stationarity statistic; null for short or constant series."""
    usable = (F.col("n") >= MIN_TEST_WEEKS) & (F.col("ss") > 0)
    walk = F.aggregate(
        "e",
        F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("sq")),
        lambda s, v: F.struct(
            (s["at"] + v).alias("at"), (s["sq"] + (s["at"] + v) * (s["at"] + v)).alias("sq")
        ),
        lambda s: s["sq"],
    )
    n = F.col("n")
    return (
        _residuals(histories(panel, keys))
        .withColumn("_lags", F.when(usable, _auto_lags() if lags is None else F.lit(lags)))
        .withColumn(
            "kpss_stat", F.when(usable, walk / (n * n) / _long_run_variance(F.col("_lags")))
        )
        .select(
            *keys,
            F.col("_lags").alias("kpss_lags"),
            "kpss_stat",
            _kpss_p("kpss_stat").alias("kpss_pvalue"),
        )
    )


def adf_no_lags(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Dickey–Fuller t statistic without lagged differences, by built-in regression."""
    if "y" in panel.columns:
        at = panel.select(*keys, "y", F.posexplode("y").alias("_i", "sales_units"))
        before = F.get("y", F.col("_i") - 1)
        pairs = at.select(*keys, before.alias("_x"), (F.col("sales_units") - before).alias("_d"))
    else:
        before = F.lag("sales_units").over(series_order(keys))
        pairs = panel.withColumns({"_x": before, "_d": F.col("sales_units") - before})
    pairs = pairs.where(F.col("_d").isNotNull())
    x, d = F.col("_x"), F.col("_d")
    fit = pairs.groupBy(*keys).agg(
        F.regr_slope(d, x).alias("_b"),
        F.regr_sxx(d, x).alias("_sxx"),
        F.regr_syy(d, x).alias("_syy"),
        F.regr_sxy(d, x).alias("_sxy"),
        F.count(F.lit(1)).alias("_n"),
    )
    rss = F.col("_syy") - F.col("_b") * F.col("_sxy")
    error = F.sqrt(ratio(rss / (F.col("_n") - 2), F.col("_sxx")))
    return fit.where(F.col("_n") >= MIN_TEST_WEEKS - 1).select(
        *keys, ratio("_b", error).alias("adf_stat")
    )


def adf_p_value(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    surface = ADF_LOW if stat <= ADF_SWITCH else ADF_HIGH
    z = sum(c * stat**i for i, c in enumerate(surface))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _design(y: np.ndarray, d: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (constant, level, lagged differences) and target of series of one length."""
    rows = np.arange(lags, d.shape[1])
    level = y[:, rows] - y.mean(axis=1, keepdims=True)
    columns = [np.ones_like(level), level, *[d[:, rows - j] for j in range(1, lags + 1)]]
    return np.stack(columns, axis=2), d[:, rows]


def adf_statistics(y: np.ndarray, max_lags: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """t statistics of the level and the lags chosen by AIC over a common sample, for stacked
    series (one per row); NaN where regressors depend on each other.

    The candidate models are nested, so one stacked QR factorisation of the largest gives the
    residual sum of squares of all of them; a second one per chosen lag count refits.
    """
    n = y.shape[1]
    top = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2, n if max_lags is None else max_lags)
    d = np.diff(y, axis=1)
    x, target = _design(y, d, top)
    q = np.linalg.qr(x)[0]
    explained = np.cumsum((np.swapaxes(q, 1, 2) @ target[:, :, None])[:, :, 0] ** 2, axis=1)[:, 1:]
    rss = np.maximum((target * target).sum(axis=1)[:, None] - explained, 1e-300)
    m = x.shape[1]
    lags = (m * np.log(rss / m) + 2 * np.arange(2, top + 3)).argmin(axis=1)
    out = np.full(len(y), np.nan)
    for k in np.unique(lags):
        own = np.flatnonzero(lags == k)
        x, target = _design(y[own], d[own], int(k))
        q, r = np.linalg.qr(x)
        size = np.abs(np.diagonal(r, axis1=1, axis2=2))
        sound = size.min(axis=1) > 1e-10 * size.max(axis=1)
        own, x, target, q, r = own[sound], x[sound], target[sound], q[sound], r[sound]
        inverse = np.linalg.inv(r)
        beta = inverse @ (np.swapaxes(q, 1, 2) @ target[:, :, None])
        gap = target - (x @ beta)[:, :, 0]
        variance = (gap * gap).sum(axis=1) / (x.shape[1] - x.shape[2]) * (inverse[:, 1] ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[own] = beta[:, 1, 0] / np.sqrt(variance)
    return out, lags


def adf(panel: DataFrame, keys: Sequence[str] = ("series_id",), max_lags: int | None = None) -> DataFrame:
    """Augmented Dickey–Fuller test with AIC lag choice; one array of weeks per row. Series of
    one length go through the factorisations together, at most ``STACK`` numbers of them."""
    series = spread(histories(panel, keys), keys)
    names = [*keys, "adf_stat", "adf_pvalue", "adf_lags"]
    schema = ", ".join(
        [*[f"{k} {dict(series.dtypes)[k]}" for k in keys], "adf_stat double", "adf_pvalue double", "adf_lags int"]
    )

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["y"].map(len).to_numpy()
            stats, lags = np.full(len(batch), np.nan), np.zeros(len(batch), int)
            for n in np.unique(size[size >= MIN_TEST_WEEKS]):
                at = np.flatnonzero(size == n)
                width = int(n) * (math.ceil(12.0 * (n / 100.0) ** 0.25) + 2)
                for k in range(0, len(at), step := max(1, STACK // width)):
                    some = at[k : k + step]
                    y = np.array(batch["y"].iloc[some].tolist(), float)
                    varies = y.std(axis=1) > 0
                    if varies.any():
                        stats[some[varies]], lags[some[varies]] = adf_statistics(y[varies], max_lags)
            told = np.isfinite(stats)
            out = batch[list(keys)].copy()
            out["adf_stat"] = pd.Series([s if t else None for s, t in zip(stats, told)], index=out.index, dtype="object")
            out["adf_pvalue"] = pd.Series([adf_p_value(s) if t else None for s, t in zip(stats, told)], index=out.index, dtype="object")
            out["adf_lags"] = pd.Series([int(x) if t else None for x, t in zip(lags, told)], index=out.index, dtype="object")
            yield out[names]

    return series.mapInPandas(test, schema)


def stationarity(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Both tests and the verdict they give together."""
    both = adf(panel, keys).drop("adf_lags").join(kpss(panel, keys=keys).drop("kpss_lags"), list(keys), "full")
    return both.withColumn("stationarity_hint", hint("adf_pvalue", "kpss_pvalue"))


def hint(adf_p: str, kpss_p: str) -> Column:
    a, k = F.col(adf_p), F.col(kpss_p)
    return (
        F.when(a.isNull() | k.isNull(), "inconclusive")
        .when((a < SIGNIFICANCE) & (k > SIGNIFICANCE), "likely_stationary")
        .when((a >= SIGNIFICANCE) & (k <= SIGNIFICANCE), "likely_non_stationary")
        .otherwise("mixed_signal")
    )


def decompose(
    panel: DataFrame, extrapolate: bool = True, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Additive trend, 52-week seasonal and remainder for series of two years or more.

    The trend is the centred 2×52 mean; its missing ends are extended by a straight
    line through the nearest 51 known values when ``extrapolate`` is set.
    """
    order = series_order(keys)
    series = Window.partitionBy(*keys)
    y = F.col("sales_units")
    half = PERIOD // 2
    inner = F.sum(y).over(order.rowsBetween(-(half - 1), half - 1))
    ends = F.lag(y, half).over(order) + F.lead(y, half).over(order)
    n = F.count(F.lit(1)).over(series)
    known = (
        panel.withColumns(
            {"_i": F.row_number().over(order) - 1, "_n": n, "_raw": (inner + 0.5 * ends) / PERIOD}
        )
        .where(F.col("_n") >= 2 * PERIOD)
        # Known positions run from 26 to n−27. The left line uses the first 51 of them, the
        # right line the 51 before the last one.
        .withColumns(
            {
                "_head": F.col("_i").between(half, half + PERIOD - 2),
                "_tail": F.col("_i").between(
                    F.col("_n") - half - PERIOD, F.col("_n") - half - 2
                ),
            }
        )
    )
    i = F.col("_i").cast("double")

    def line(side: str) -> Column:
        t = F.when(F.col(side), F.col("_raw"))
        return F.regr_intercept(t, i).over(series) + F.regr_slope(t, i).over(series) * i

    trend = F.col("_raw")
    if extrapolate:
        trend = F.coalesce(trend, F.when(F.col("_i") < half, line("_head")).otherwise(line("_tail")))
    phase = Window.partitionBy(*keys, "_phase")
    detrended = known.withColumn("trend", trend).withColumns(
        {"_detrended": y - F.col("trend"), "_phase": F.col("_i") % PERIOD}
    )
    # The level of the seasonal part: mean over the 52 phases of the phase means.
    return (
        detrended.withColumn("_phase_mean", F.avg("_detrended").over(phase))
        .withColumn(
            "_level",
            F.sum(F.when(F.col("_i") < PERIOD, F.col("_phase_mean"))).over(series) / PERIOD,
        )
        .withColumn("seasonal", F.col("_phase_mean") - F.col("_level"))
        .select(
            *keys,
            "week_start",
            "sales_units",
            "trend",
            "seasonal",
            (F.col("_detrended") - F.col("seasonal")).alias("resid"),
        )
    )
