"""Daily sales and prices to a dense weekly panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.columns import monday, plus_weeks, ratio

LEVELS = ("category", "sku")
PANEL_KEY = ("series_id", "week_start")


def _level_keys(level: str) -> list[str]:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    return ["cat_id"] if level == "category" else ["item_id", "cat_id"]


def _level_columns(level: str) -> list[Column]:
    if level == "category":
        return [F.col("cat_id").alias("series_id"), F.col("cat_id").alias("category")]
    return [
        F.col("item_id").alias("series_id"),
        F.col("cat_id").alias("category"),
        F.col("item_id").alias("sku"),
    ]


def wide_to_long(sales_wide: DataFrame, calendar: DataFrame) -> DataFrame:
    """``d_1 … d_N`` columns to one row per item, store and day."""
    days = [c for c in sales_wide.columns if c.startswith("d_")]
    ids = [c for c in sales_wide.columns if c not in days]
    # One array per row: thousands of day columns stay one expression each.
    units = F.array(*[F.col(c).cast("double") for c in days])
    long = sales_wide.select(*ids, F.posexplode(units).alias("_n", "units"))
    long = long.select(*ids, F.get(F.lit(days), F.col("_n")).alias("d"), "units")
    # One calendar row per day.
    return long.join(F.broadcast(calendar.select("d", "date")), "d").select(*ids, "d", "date", "units")


def weekly_sales(sales: DataFrame, items: DataFrame, level: str) -> DataFrame:
    """Units per series and Monday week.

    Category sums are combined where the lines lie and exchanged once; the items are joined
    before that, by broadcast where the optimiser finds them small and else by shuffle, where
    adaptive execution splits a hot item. Item sums meet the items as one row per week.
    """
    _level_keys(level)
    week = monday("date").alias("week_start")
    units = F.sum("units").alias("units")
    named = items.select("item_id", "cat_id")
    if level == "category":
        summed = sales.join(named, "item_id").groupBy("cat_id", week).agg(units)
    else:
        summed = sales.groupBy("item_id", week).agg(units).join(named, "item_id")
    return summed.select(
        *_level_columns(level), "week_start", F.col("units").cast("double").alias("sales_units")
    )


def day_counts(calendar: DataFrame) -> DataFrame:
    """Days of each retail week that fall in each Monday week."""
    return calendar.groupBy(monday("date").alias("week_start"), "wm_yr_wk").agg(
        F.count(F.lit(1)).alias("day_count")
    )


def item_store_price(prices: DataFrame, items: DataFrame, calendar: DataFrame) -> DataFrame:
    """Day-weighted price per item, store and Monday week.

    The day counts have two rows per calendar week; joined by shuffle, the price rows
    would land in as many partitions as there are weeks.
    """
    per_store = (
        prices.join(F.broadcast(day_counts(calendar)), "wm_yr_wk")
        .groupBy("item_id", "store_id", "week_start")
        .agg(
            ratio(F.sum(F.col("sell_price") * F.col("day_count")), F.sum("day_count")).alias("price")
        )
    )
    # The category comes last, at one row per item, store and week.
    named = per_store.join(items.select("item_id", "cat_id"), "item_id")
    return named.select("item_id", "cat_id", "store_id", "week_start", "price")


def weekly_price(prices: DataFrame, items: DataFrame, calendar: DataFrame, level: str) -> DataFrame:
    """Unweighted mean of the item-store prices per series and week."""
    return (
        item_store_price(prices, items, calendar)
        .groupBy(*_level_keys(level), "week_start")
        .agg(F.avg("price").alias("price"))
        .select(*_level_columns(level)[:2], "week_start", "price")
    )


def attach_price(panel: DataFrame, price: DataFrame) -> DataFrame:
    """Left join of the price; ``promo`` is unknown in the base setting and stays null."""
    return panel.join(price, ["series_id", "category", "week_start"], "left").withColumn(
        "promo", F.lit(None).cast("double")
    )


def _spans(panel: DataFrame, keys: Sequence[str], week: str, period: DataFrame | None = None) -> DataFrame:
    """Every row with the weeks it is stretched over, ``_start`` to ``_end``."""
    bounds = (panel if period is None else period).agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    w = Window.partitionBy(*keys).orderBy(week)
    start = F.when(F.lag(week).over(w).isNull(), F.col("_lo")).otherwise(F.col(week))
    end = F.coalesce(plus_weeks(F.lead(week).over(w), -1), F.col("_hi"))
    return panel.withColumns(
        {"_lo": bounds.select("lo").scalar(), "_hi": bounds.select("hi").scalar()}
    ).withColumns({"_start": start, "_end": end})


def dense_histories(
    panel: DataFrame, keys: Sequence[str] = ("series_id",), week: str = "week_start"
) -> DataFrame:
    """The rows of ``densify``, one row per series: the smallest of its other columns, first
    and last week, their number, ``seen`` with the weeks of other units than zero (``at``, weeks
    after the first) and the units ``y`` in week order, gaps zero.

    Only the sparse rows are shuffled, sorted and grouped; the dense weeks exist within a row, and
    only where ``y`` is read. A null week repeats the weeks before the first known one: then there
    are more weeks than from the first to the last.
    """
    spans = _spans(panel, keys, week).where(F.col("_start").isNotNull() & F.col("_end").isNotNull())
    statics = [c for c in panel.columns if c not in (*keys, week, "sales_units")]
    value = F.coalesce(F.col("sales_units").cast("double"), F.lit(0.0)).alias("units")
    run = F.struct("_start", "_end", F.col(week).alias("seen"), value)
    days = F.datediff("_end", "_start")
    broken = F.raise_error(F.lit("a week of a series repeats, or a null week stands before the first one"))
    stretch = F.when(days < 0, broken.cast("int")).otherwise(F.floor(days / 7).cast("int"))
    inside = (F.col(week) <= F.col("_end")) & (F.datediff(F.col(week), F.col("_start")) % 7 == 0)
    at = F.floor(F.datediff(F.col(week), F.col("_lo")) / 7).cast("int").alias("at")
    units = F.col("sales_units").cast("double")

    def stretched(r: Column) -> Column:
        last = F.floor(F.datediff(r["_end"], r["_start"]) / 7).cast("int")
        seen = F.datediff(r["seen"], r["_start"])
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(1)),
            lambda k: F.when(k * 7 == seen, r["units"]).otherwise(F.lit(0.0)),
        )

    return (
        spans.groupBy(*keys)
        .agg(
            *[F.min(c).alias(c) for c in statics],
            F.min("_start").alias("start_date"),
            F.max("_end").alias("end_date"),
            F.sum(stretch + 1).alias("history_weeks"),
            F.sort_array(
                F.collect_list(F.when(inside & (units != 0), F.struct(at, units.alias("units"))))
            ).alias("seen"),
            F.sort_array(F.collect_list(run)).alias("runs"),
        )
        .withColumn("y", F.flatten(F.transform("runs", stretched)))
    )


def densify(
    panel: DataFrame,
    keys: Sequence[str] = ("series_id",),
    week: str = "week_start",
    fill: dict[str, float] | None = None,
    period: DataFrame | None = None,
) -> DataFrame:
    """One row per series and week of the whole period; gaps take ``fill`` (sales 0).

    Every row is stretched up to the week before its successor, so the grid needs
    neither a series × weeks product nor a join: one shuffle on the series key, the
    same one the feature windows use afterwards. ``period`` is the table whose first and last
    week bound the grid, where ``panel`` holds only some of its series.
    """
    fill = {"sales_units": 0.0} if fill is None else fill
    spans = _spans(panel, keys, week, period).withColumn(
        "_week", F.explode(F.sequence("_start", "_end", F.expr("interval 7 days")))
    )
    observed = F.col("_week") == F.col(week)
    values = {
        c: F.when(observed, F.coalesce(F.col(c), F.lit(v))).otherwise(F.lit(v)).alias(c)
        for c, v in fill.items()
    }
    return spans.select(
        *[F.col("_week").alias(c) if c == week else values.get(c, F.col(c)) for c in panel.columns]
    )


def top_series(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` largest series by total units, ties by ``series_id``."""
    totals = panel.groupBy("series_id").agg(F.sum("sales_units").alias("_total"))
    chosen = totals.orderBy(F.desc("_total"), "series_id").limit(n)
    return panel.join(chosen, "series_id", "left_semi")


def daily_total(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date").agg(F.sum("units").alias("sales_units"))


def resample(panel: DataFrame, unit: str) -> DataFrame:
    """Total over all series per ``week`` or per ``month`` of the week start."""
    stamp = F.col("week_start") if unit == "week" else F.to_date(F.trunc("week_start", unit))
    return panel.groupBy(stamp.alias("timestamp")).agg(F.sum("sales_units").alias("sales_units"))


def pivot_categories(panel: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Week × category matrix of units with their total; all categories unless a list is given."""
    rows = panel.groupBy("week_start")
    named = rows.pivot("category", list(categories)) if categories is not None else rows.pivot("category")
    total = panel.groupBy("week_start").agg(F.sum("sales_units").alias("total"))
    return named.agg(F.sum("sales_units")).join(total, "week_start")


def raw_counts(sales: DataFrame, items: DataFrame, stores: DataFrame) -> DataFrame:
    """Distinct items, stores, states, departments and days of the raw tables."""
    return sales.agg(
        F.countDistinct("item_id").alias("raw_item_count"),
        F.countDistinct("store_id").alias("raw_store_count"),
        F.countDistinct("date").alias("raw_daily_observations"),
    ).withColumns(
        {
            "raw_state_count": stores.agg(F.countDistinct("state_id")).scalar(),
            "raw_department_count": items.agg(F.countDistinct("dept_id")).scalar(),
        }
    )


def items_per_category(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("cat_id").alias("category")).agg(
        F.countDistinct("item_id").alias("item_count")
    )


def check_panel(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Violations of the panel contract, one row each kind; an empty result is a pass.

    Missing columns and a wrong week type are schema facts and raise at once.
    """
    needed = {*keys, "category", "week_start", "sales_units"}
    missing = sorted(needed - set(panel.columns))
    if missing:
        raise ValueError(f"panel lacks columns {missing}")
    if dict(panel.dtypes)["week_start"] not in ("date", "timestamp", "timestamp_ntz"):
        raise ValueError("week_start must be a date")
    per_key = panel.groupBy(*keys, "week_start").agg(F.count(F.lit(1)).alias("n"))
    found = per_key.agg(
        F.sum(F.col("n") - 1).alias("duplicate_key"),
        F.sum(F.when(F.col("week_start") != monday("week_start"), 1).otherwise(0)).alias(
            "not_a_monday"
        ),
        F.sum(F.when(F.col("week_start").isNull(), 1).otherwise(0)).alias("null_week"),
    )
    return _found(found)


def _found(counts: DataFrame) -> DataFrame:
    return counts.unpivot([], counts.columns, "violation", "rows_affected").where(
        "rows_affected > 0"
    )


def check_histories(histories: DataFrame) -> DataFrame:
    """``check_panel`` of the dense weeks of ``dense_histories``: every week of every series is
    compared with the others of its row."""
    runs = F.transform(
        "runs", lambda r: F.sequence(r["_start"], r["_end"], F.expr("interval 7 days"))
    )
    checked = histories.select(F.flatten(runs).alias("weeks")).select(
        "weeks", F.array_distinct("weeks").alias("distinct")
    )
    counts = checked.agg(
        F.sum(F.size("weeks") - F.size("distinct")).alias("duplicate_key"),
        F.sum(F.size(F.filter("distinct", lambda w: w != monday(w)))).alias("not_a_monday"),
        F.sum(F.size(F.filter("distinct", lambda w: w.isNull()))).alias("null_week"),
    )
    return _found(counts)


def require_panel(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Return the panel, or raise when ``check_panel`` finds anything."""
    found = check_panel(panel, keys).collect()  # at most three rows
    if found:
        raise ValueError(f"panel contract broken: {[r.asDict() for r in found]}")
    return panel


def data_dictionary(table: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Per column: type, role, share of non-null values, smallest value as the example."""
    roles = PANEL_ROLES if roles is None else roles
    row = table.agg(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(dtype).alias("dtype"),
                F.lit(roles.get(name, "derived")).alias("role"),
                F.avg(F.col(name).isNotNull().cast("double")).alias("non_null_share"),
                F.coalesce(F.min(name).cast("string"), F.lit("")).alias("example_value"),
            ).alias(name)
            for name, dtype in table.dtypes
        ]
    )
    return row.select(F.inline(F.array(*[F.col(c) for c in table.columns])))


# The role of each column in the panel and in the scenario panel.
PANEL_ROLES = {
    "series_id": "key",
    "category": "static",
    "week_start": "time_index",
    "sales_units": "target",
    "price": "future_unknown",
    "promo": "future_unknown",
}
SCENARIO_ROLES = {
    "scenario_name": "scenario",
    "series_id": "key",
    "category": "static",
    "week_start": "time_index",
    "time_index": "time_index",
    "is_history": "split_flag",
    "sales_units": "target",
    "expected_sales_units": "generator_internal",
    "promo_planned": "known_in_advance",
    "discount_depth": "known_in_advance",
    "price": "known_in_advance",
}
