"""Profile tables of a weekly panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import correlation_of, ratio, share, total
from weekcast.operators import segments as seg
from weekcast.operators.features import calendar_columns, series_order
from weekcast.operators.panel import resample
from weekcast.operators.ranking import exact_quantiles, running
from weekcast.operators.scenarios import metric_rows

ACF_LAGS = (1, 4, 8, 13, 26, 52)
SEASONAL_ACF = 0.30
COMPLETE_GRID = 0.999999
TOP_LIMITS = (1, 5, 10, 20, 50, 100)


def _outlier_share() -> Column:
    """Share of known values further than three deviations from the median.

    A series has at most one value per week, so its values fit an array and the
    second pass over them stays inside the aggregate's row; ``_zeros`` further values are zero.
    """
    far = F.filter("_values", lambda y: F.abs(y - F.col("median_sales_units")) > 3 * F.col("_std"))
    far_zeros = F.when(F.abs("median_sales_units") > 3 * F.col("_std"), F.col("_zeros")).otherwise(0)
    known = F.size("_values") + F.col("_zeros")
    usable = (known > 1) & (F.col("_std") > 0)
    return F.when(usable, (F.size(far) + far_zeros) / known).otherwise(0.0)


def _stats(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    y = F.col("sales_units")
    indexed = panel.withColumn("_i", (F.row_number().over(series_order(keys)) - 1).cast("double"))
    return indexed.groupBy(*keys).agg(
        F.min("week_start").alias("start_date"),
        F.max("week_start").alias("end_date"),
        F.sum(y).alias("total_sales_units"),
        F.avg(y).alias("mean_sales_units"),
        F.percentile(y, 0.5).alias("median_sales_units"),
        share(y.isNull()).alias("missing_share"),
        F.min("category").alias("category"),
        F.collect_list(y).alias("_values"),
        F.lit(0).alias("_zeros"),
        F.regr_slope(y, F.col("_i")).alias("_slope"),
        *seg.spread(),
    )


def _history_stats(histories: DataFrame) -> DataFrame:
    """The same figures within the row of a series, from its weeks of other units than zero."""
    n, zeros = F.col("history_weeks"), F.col("_zeros")
    middle = (n - 1) / 2
    ranked, below = F.col("_ranked"), F.col("_below")

    def value(rank: Column) -> Column:
        after = F.get(ranked, (rank - zeros).cast("int"))
        return F.when(rank < below, F.get(ranked, rank.cast("int"))).when(rank < below + zeros, 0.0).otherwise(after)

    # Repeated weeks come first. Positions around their mean add up to zero, so zeros add nothing.
    repeated = n - 1 - F.floor(F.datediff("end_date", "start_date") / 7)
    gaps = F.transform("seen", lambda s: s["units"] * (s["at"] + F.col("_repeated") - middle))
    return seg.with_each(
        histories,
        {
            **seg.history_spread(),
            "_ranked": F.sort_array("_units"),
            "_below": F.size(F.filter("_units", lambda v: v < 0)),
            "_repeated": repeated,
            "total_sales_units": total(F.col("_units")),
            "mean_sales_units": F.col("_mean"),
            "median_sales_units": (value(F.floor(middle)) + value(F.ceil(middle))) / 2,
            "missing_share": F.lit(0.0),
            "_values": F.col("_units"),
            # The squares of n positions around their mean add up to n (n^2 - 1) / 12.
            "_slope": ratio(total(gaps), n * (n * n - 1) / 12),
        },
    )


def series_summary(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per series: period, level, spread, zeros, outliers, trend, grid, segment. ``panel``
    has a row per week, or a row per series with its weeks ``seen`` (``dense_histories``)."""
    stats = _history_stats(panel) if "seen" in panel.columns else _stats(panel, keys)
    n = F.col("history_weeks")
    expected = F.floor(F.datediff("end_date", "start_date") / 7) + 1
    return (
        stats.withColumns(seg.rules())
        .withColumns(
            {
                "std_sales_units": F.col("_std"),
                "outlier_share": _outlier_share(),
                "expected_weeks": expected,
                "grid_coverage": F.coalesce(ratio(n, expected), F.lit(0.0)),
                "coefficient_of_variation": ratio("_std", "_mean"),
                "trend_strength": F.when(
                    (n > 1) & (F.col("_std") > 0), F.abs("_slope") * n / F.col("_std")
                ).otherwise(0.0),
            }
        )
        .withColumn("weekly_grid_complete", F.col("grid_coverage") >= COMPLETE_GRID)
        .select(
            *keys,
            "start_date",
            "end_date",
            "history_weeks",
            "total_sales_units",
            "mean_sales_units",
            "median_sales_units",
            "std_sales_units",
            "zero_share",
            "missing_share",
            "outlier_share",
            "category",
            "segment_label",
            "short_history",
            "high_zero_share",
            "variance",
            "high_variance",
            "expected_weeks",
            "grid_coverage",
            "weekly_grid_complete",
            "coefficient_of_variation",
            "trend_strength",
        )
    )


def dataset_profile(summary: DataFrame, raw_counts: DataFrame | None = None) -> DataFrame:
    """Panel facts as ``metric, value, text`` rows."""

    def flag(c: str) -> Column:
        return F.avg(F.col(c).cast("double"))

    row = summary.agg(
        F.min("start_date").cast("string").alias("period_start"),
        F.max("end_date").cast("string").alias("period_end"),
        F.count(F.lit(1)).cast("double").alias("number_of_series"),
        F.countDistinct("category").cast("double").alias("number_of_categories"),
        F.min("history_weeks").cast("double").alias("history_weeks_min"),
        # History lengths are whole weeks, so there are few distinct values to rank.
        F.percentile("history_weeks", 0.5).alias("history_weeks_median"),
        F.max("history_weeks").cast("double").alias("history_weeks_max"),
        F.avg("zero_share").alias("zero_share_mean"),
        F.avg("missing_share").alias("missing_share_mean"),
        F.avg("outlier_share").alias("outlier_share_mean"),
        F.avg("coefficient_of_variation").alias("mean_cv"),
        F.avg("trend_strength").alias("mean_trend_strength"),
        flag("short_history").alias("short_history_share"),
        flag("high_zero_share").alias("high_zero_share_share"),
        flag("high_variance").alias("high_variance_share"),
        share(F.col("segment_label") == "problematic").alias("problematic_share"),
        share(F.col("segment_label") == "intermittent").alias("intermittent_share"),
        flag("weekly_grid_complete").alias("weekly_grid_complete_share"),
    )
    facts = metric_rows(row)
    return facts if raw_counts is None else facts.unionByName(metric_rows(raw_counts))


def frequency_comparison(panel: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Daily, weekly and monthly totals: level, spread and first-order autocorrelation."""
    totals = resample(panel, "week").withColumn("frequency", F.lit("weekly")).unionByName(
        resample(panel, "month").withColumn("frequency", F.lit("monthly"))
    )
    if daily is not None:
        totals = totals.unionByName(
            daily.select(F.col("date").alias("timestamp"), "sales_units").withColumn(
                "frequency", F.lit("daily")
            )
        )
    order = Window.partitionBy("frequency").orderBy("timestamp")
    y = F.col("sales_units")
    return (
        totals.withColumn("_previous", F.lag("sales_units", 1).over(order))
        .groupBy("frequency")
        .agg(
            F.count(F.lit(1)).alias("period_count"),
            F.min("timestamp").alias("period_start"),
            F.max("timestamp").alias("period_end"),
            F.avg(y).alias("mean_sales_units"),
            F.stddev_pop(y).alias("std_sales_units"),
            ratio(F.stddev_pop(y), F.avg(y)).alias("coefficient_of_variation"),
            _autocorrelation("_previous", 1).alias("first_order_autocorr"),
        )
    )


def _autocorrelation(lagged: str, lag: int) -> Column:
    """Aggregate: correlation with the lagged column; null when short, 0 when constant."""
    y = F.col("sales_units")
    return (
        F.when(F.count(F.lit(1)) <= lag, F.lit(None).cast("double"))
        .when(F.stddev_pop(y) == 0, 0.0)
        .otherwise(correlation_of(y, lagged))
    )


def category_summary(panel: DataFrame, summary: DataFrame, item_counts: DataFrame | None) -> DataFrame:
    """Level per category with the means of its series' zero and outlier shares."""
    level = panel.groupBy("category").agg(
        F.sum("sales_units").alias("total_sales_units"),
        F.avg("sales_units").alias("mean_weekly_sales"),
    )
    median = exact_quantiles(panel, "sales_units", ["category"], {"median_weekly_sales": 0.5})
    shares = summary.groupBy("category").agg(
        F.count(F.lit(1)).alias("number_of_series"),
        F.avg("zero_share").alias("mean_zero_share"),
        F.avg("outlier_share").alias("mean_outlier_share"),
    )
    out = level.join(median, "category", "left").join(shares, "category", "left")
    return out if item_counts is None else out.join(item_counts, "category", "left")


def sku_ranking(summary: DataFrame) -> DataFrame:
    """Series ranked by volume with their share and the running share."""
    order = [F.desc("total_sales_units"), F.desc("mean_sales_units"), F.asc("series_id")]
    ranked = running(summary, order, sums=["total_sales_units"])
    known = F.col("total_total_sales_units") > 0

    def part(c: str) -> Column:
        return F.when(known, ratio(c, "total_total_sales_units")).otherwise(0.0)

    return ranked.select(
        F.col("position").alias("sales_rank"),
        "series_id",
        "category",
        "segment_label",
        "total_sales_units",
        part("total_sales_units").alias("sales_share"),
        part("cum_total_sales_units").alias("cumulative_sales_share"),
        "mean_sales_units",
        "median_sales_units",
        "zero_share",
        "outlier_share",
        "coefficient_of_variation",
        "trend_strength",
    )


def category_weekly(panel: DataFrame) -> DataFrame:
    return panel.groupBy("category", "week_start").agg(F.sum("sales_units").alias("value"))


def log_growth(weekly: DataFrame) -> DataFrame:
    """Week-on-week change of log(1 + value) per category."""
    order = Window.partitionBy("category").orderBy("week_start")
    level = F.log1p("value")
    return weekly.select("category", "week_start", (level - F.lag(level).over(order)).alias("value"))


def correlation(weekly: DataFrame) -> DataFrame:
    """Correlation of every two categories over the weeks both have.

    The result has a row per pair by definition; the pairs of one week are summed in
    the join stage, and only half of them are formed.
    """
    a = weekly.where(F.col("value").isNotNull()).select(
        "week_start", F.col("category").alias("category_a"), F.col("value").alias("_a")
    )
    b = a.withColumnsRenamed({"category_a": "category_b", "_a": "_b"})
    half = (
        a.join(b, "week_start")
        .where(F.col("category_a") <= F.col("category_b"))
        .groupBy("category_a", "category_b")
        .agg(correlation_of("_a", "_b").alias("correlation"))
    )
    sides = F.when(
        F.col("category_a") == F.col("category_b"),
        F.array(F.struct("category_a", "category_b")),
    ).otherwise(
        F.array(
            F.struct("category_a", "category_b"),
            F.struct(F.col("category_b").alias("category_a"), F.col("category_a").alias("category_b")),
        )
    )
    return half.select(F.explode(sides).alias("p"), "correlation").select("p.*", "correlation")


def seasonal_index(panel: DataFrame) -> DataFrame:
    """Mean of an ISO week relative to the category mean."""
    weekly = panel.withColumn("week_of_year", calendar_columns()["week_of_year"])
    sums = weekly.groupBy("category", "week_of_year").agg(
        F.sum("sales_units").alias("_sum"), F.count("sales_units").alias("_n")
    )
    category = Window.partitionBy("category")
    mean = ratio(F.sum("_sum").over(category), F.sum("_n").over(category))
    return sums.select(
        "category",
        "week_of_year",
        ratio("_sum", "_n").alias("mean_sales_units"),
        mean.alias("category_mean_sales_units"),
    ).withColumn("seasonal_index", ratio("mean_sales_units", "category_mean_sales_units"))


def series_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series_id", "category").agg(
        F.sum("sales_units").alias("total_sales_units")
    )


def concentration(panel: DataFrame) -> DataFrame:
    """HHI, its inverse, Gini and the shares of the largest series, as metric rows.

    Gini needs ranks: equal totals are merged first, and the ranks of a merged run are
    an arithmetic series. The head shares come from a top-100.
    """
    totals = series_totals(panel)
    t = F.col("total_sales_units")
    merged = totals.groupBy("total_sales_units").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(merged.withColumn("_v", t * F.col("_n")), [t.asc()], sums=["_n"])
    before = F.col("cum__n") - F.col("_n")
    rank_sum = F.col("_n") * before + F.col("_n") * (F.col("_n") + 1) / 2
    facts = ranked.agg(
        F.sum("_n").cast("double").alias("sku_count"),
        F.sum("_v").alias("_total"),
        F.sum(t * t * F.col("_n")).alias("_squares"),
        F.sum(t * rank_sum).alias("_ranked"),
    ).where("_total > 0")
    largest = Window.orderBy(F.desc("total_sales_units"), "series_id")
    head = totals.orderBy(F.desc("total_sales_units"), "series_id").limit(max(TOP_LIMITS))
    tops = head.withColumn("_r", F.row_number().over(largest)).agg(
        *[
            F.sum(F.when(F.col("_r") <= k, t)).alias(f"_top_{k}")
            for k in TOP_LIMITS
        ],
        F.count(F.lit(1)).alias("_head"),
    )
    hhi = F.col("_squares") / (F.col("_total") * F.col("_total"))
    n = F.col("sku_count")
    # One row on each side.
    row = facts.withColumns(
        {c: tops.select(c).scalar() for c in tops.columns}
    ).select(
        "sku_count",
        ratio(F.lit(1.0), hhi).alias("effective_sku_count_inverse_hhi"),
        hhi.alias("hhi_sales_concentration"),
        (2 * F.col("_ranked") / (n * F.col("_total")) - (n + 1) / n).alias(
            "gini_sales_concentration"
        ),
        *[
            F.when(F.col("_head") >= k, F.col(f"_top_{k}") / F.col("_total")).alias(
                f"top_{k}_sales_share"
            )
            for k in TOP_LIMITS
        ],
    )
    return metric_rows(row).where(F.col("value").isNotNull()).select("metric", "value")


def share_stability(panel: DataFrame, top_n: int = 50) -> DataFrame:
    """Spread of the weekly share of the largest series among themselves, per category."""
    y = F.col("sales_units")
    chosen = (
        series_totals(panel)
        .orderBy(F.desc("total_sales_units"), "series_id")
        .limit(top_n)
        .select("series_id")
    )
    selected = panel.join(chosen, "series_id", "left_semi")
    week = Window.partitionBy("week_start", "category")
    part = ratio(y, F.sum(y).over(week))
    return (
        selected.withColumn("_share", part)
        .groupBy("series_id", "category")
        .agg(
            F.sum(y).alias("total_sales_units"),
            F.avg("_share").alias("mean_weekly_share"),
            F.stddev_pop("_share").alias("std_weekly_share"),
            F.min("_share").alias("min_weekly_share"),
            F.max("_share").alias("max_weekly_share"),
            share(y == 0).alias("zero_share"),
        )
        .withColumn("share_cv", ratio("std_weekly_share", "mean_weekly_share"))
    )


def autocorrelations(
    panel: DataFrame, lags: Sequence[int] = ACF_LAGS, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Lagged correlations per series, one column per lag. ``panel`` has a row per week, or a row
    per series with its values ``y`` (``dense_histories``)."""
    if "y" in panel.columns:
        # Weeks leave their row in order, so no sort of the dense rows is needed for the lags.
        at = panel.select(*keys, "y", F.posexplode("y").alias("_i", "sales_units"))
        before = {f"_lag_{k}": F.get("y", F.col("_i") - k) for k in lags}
        shifted = at.select(*keys, "sales_units", *[c.alias(name) for name, c in before.items()])
    else:
        order = series_order(keys)
        shifted = panel.withColumns({f"_lag_{k}": F.lag("sales_units", k).over(order) for k in lags})
    return shifted.groupBy(*keys).agg(
        *[_autocorrelation(f"_lag_{k}", k).alias(f"acf_lag_{k}") for k in lags]
    )


def diagnostic_summary(summary: DataFrame, acf: DataFrame) -> DataFrame:
    """Means over series as ``diagnostic, value`` rows."""
    means = summary.agg(
        F.avg("history_weeks").alias("mean_history_weeks"),
        F.avg("zero_share").alias("mean_zero_share"),
        F.avg("coefficient_of_variation").alias("mean_cv"),
        F.avg("trend_strength").alias("mean_trend_strength"),
    )
    seasonal = acf.agg(
        F.avg("acf_lag_52").alias("seasonal_acf_lag_52_mean"),
        F.avg("acf_lag_13").alias("seasonal_acf_lag_13_mean"),
        F.avg("acf_lag_26").alias("seasonal_acf_lag_26_mean"),
        share(F.col("acf_lag_52") >= SEASONAL_ACF).alias("strong_seasonality_share_lag_52"),
    )
    return (
        metric_rows(means)
        .unionByName(metric_rows(seasonal))
        .select(F.col("metric").alias("diagnostic"), "value")
    )
