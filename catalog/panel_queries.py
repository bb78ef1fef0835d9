"""Sources, panel building and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlbase as s
from catalog.registry import Registry
from catalog.tables import baseline_table, history_table, panel_table, scenario_table, weekly_table
from weekcast.functions.columns import monday
from weekcast.operators import panel as p
from weekcast.operators import scenarios as sc
from weekcast.session import cut_lineage
from weekcast.sources import raw as r
from weekcast.sources.star import star_raw, star_wide, star_wide_categories

CALENDAR_SQL = """calendar AS (
    SELECT 'd_' || CAST(date_diff('day', lo, day) + 1 AS VARCHAR) AS d, day AS date,
           CAST(floor(date_diff('day', DATE '1994-12-31', day) / 7.0) AS INTEGER) AS wm_yr_wk
    FROM (SELECT lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
          FROM (SELECT CAST(MIN(l_shipdate) AS DATE) AS lo, CAST(MAX(l_shipdate) AS DATE) AS hi
                FROM lineitem)))"""
PRICES_SQL = f"""prices AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS store_id, CAST(l_partkey AS VARCHAR) AS item_id,
           {s.RETAIL_WEEK} AS wm_yr_wk, AVG(l_extendedprice / l_quantity) AS sell_price
    FROM lineitem GROUP BY 1, 2, 3)"""
DAY_MAP_SQL = """day_map AS (
    SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, wm_yr_wk, COUNT(*) AS day_count
    FROM calendar GROUP BY 1, 2)"""
STORE_PRICE_SQL = """store_price AS (
    SELECT x.item_id, p_type AS cat_id, x.store_id, m.week_start,
           SUM(x.sell_price * m.day_count) / NULLIF(SUM(m.day_count), 0) AS price
    FROM prices x JOIN part ON CAST(p_partkey AS VARCHAR) = x.item_id
    JOIN day_map m ON m.wm_yr_wk = x.wm_yr_wk GROUP BY 1, 2, 3, 4)"""
PRICE_CTES = [CALENDAR_SQL, PRICES_SQL, DAY_MAP_SQL, STORE_PRICE_SQL]
def wide_sql(days: int) -> str:
    """The first days of all item-stores that ever sell."""
    columns = ", ".join(
        f"""COALESCE(SUM(CASE WHEN CAST(l_shipdate AS DATE) = lo + {n - 1} THEN l_quantity END), 0) AS d_{n}"""
        for n in range(1, days + 1)
    )
    return f"""wide AS (
        SELECT CAST(l_partkey AS VARCHAR) AS item_id, p_brand AS dept_id, p_type AS cat_id,
               CAST(l_suppkey AS VARCHAR) AS store_id, n_name AS state_id, {columns}
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey
        CROSS JOIN (SELECT CAST(MIN(l_shipdate) AS DATE) AS lo FROM lineitem)
        GROUP BY 1, 2, 3, 4, 5)"""


def priced_panel(spark, sf_dir, level="category"):
    raw = star_raw(spark, sf_dir)
    weekly = cut_lineage(p.weekly_sales(raw.sales, raw.items, level))
    price = p.weekly_price(raw.prices, raw.items, raw.calendar, level)
    return p.attach_price(p.densify(weekly), price)


PRICED_SQL = [
    *s.panel(),
    *PRICE_CTES,
    "level_price AS (SELECT cat_id, week_start, AVG(price) AS price FROM store_price GROUP BY 1, 2)",
    """priced AS (
        SELECT p.series_id, p.category, p.week_start, p.sales_units, x.price,
               CAST(NULL AS DOUBLE) AS promo
        FROM panel p LEFT JOIN level_price x
             ON x.cat_id = p.series_id AND x.week_start = p.week_start)""",
]


def dictionary_sql(source: str, columns: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS dtype, '{role}' AS role,
            AVG(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS non_null_share FROM {source}"""
        for c, t, role in columns
    )


def loose_panel(spark, sf_dir):
    """Order lines as if they were a panel: duplicate keys, days instead of weeks."""
    raw = star_raw(spark, sf_dir)
    return raw.sales.join(raw.items, "item_id").select(
        F.col("dept_id").alias("series_id"),
        F.col("cat_id").alias("category"),
        F.col("date").alias("week_start"),
        F.col("units").alias("sales_units"),
    )


def register(q: Registry) -> None:
    add = q.add
    add(
        "a1_raw_calendar",
        "d date wm_yr_wk:i",
        lambda sp, d: star_raw(sp, d).calendar,
        s.with_([CALENDAR_SQL], "SELECT * FROM calendar"),
    )
    add(
        "a1_raw_prices",
        "store_id item_id wm_yr_wk:i sell_price:4",
        lambda sp, d: star_raw(sp, d).prices,
        s.with_([PRICES_SQL], "SELECT * FROM prices"),
    )
    add(
        "a1_raw_sales",
        "item_id store_id date units:2",
        lambda sp, d: star_raw(sp, d)
        .sales.groupBy("item_id", "store_id", "date")
        .agg(F.sum("units").alias("units")),
        """SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_suppkey AS VARCHAR) AS store_id,
           CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS units
           FROM lineitem GROUP BY 1, 2, 3""",
    )
    add(
        "a2_scenario_panel",
        "scenario_name series_id category week_start is_history sales_units:2 price:4 promo_planned:4",
        lambda sp, d: sc.prepare_scenarios(scenario_table(sp, d), "A", "category"),
        s.with_(
            [*s.scenario_panel(), s.ROLLED], "SELECT * FROM rolled WHERE scenario_name = 'A'"
        ),
    )
    add(
        "a3_panel_violations",
        "violation rows_affected:i",
        lambda sp, d: p.check_panel(loose_panel(sp, d)),
        """WITH loose AS (
             SELECT p_brand AS series_id, CAST(l_shipdate AS DATE) AS week_start, COUNT(*) AS n
             FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
           SELECT * FROM (
             SELECT 'duplicate_key' AS violation, SUM(n - 1) AS rows_affected FROM loose
             UNION ALL
             SELECT 'not_a_monday', SUM(CASE WHEN ISODOW(week_start) <> 1 THEN 1 ELSE 0 END)
             FROM loose) WHERE rows_affected > 0""",
    )
    add(
        "a3_panel_ok",
        "violation rows_affected:i",
        lambda sp, d: p.check_histories(history_table(sp, d, "sku")),
        s.with_(
            s.panel("sku"),
            """SELECT 'duplicate_key' AS violation, n AS rows_affected FROM (
                 SELECT SUM(n - 1) AS n FROM (
                   SELECT COUNT(*) AS n FROM panel GROUP BY series_id, week_start)) WHERE n > 0""",
        ),
    )
    sample = [f"d_{n}" for n in range(1, 9)]
    add(
        "a6_sales_sample",
        "item_id dept_id cat_id store_id state_id " + " ".join(f"{c}:2" for c in sample),
        lambda sp, d: r.head(star_wide(sp, d, 8), ["item_id", "store_id"], 10),
        s.with_([wide_sql(8)], "SELECT * FROM wide ORDER BY item_id, store_id LIMIT 10"),
    )
    add(
        "a6_calendar_sample",
        "d date wm_yr_wk:i",
        lambda sp, d: r.head(star_raw(sp, d).calendar, ["date"], 10),
        s.with_([CALENDAR_SQL], "SELECT * FROM calendar ORDER BY date LIMIT 10"),
    )
    add(
        "a6_price_sample",
        "store_id item_id wm_yr_wk:i sell_price:4",
        lambda sp, d: r.head(star_raw(sp, d).prices, ["store_id", "item_id", "wm_yr_wk"], 10),
        s.with_([PRICES_SQL], "SELECT * FROM prices ORDER BY store_id, item_id, wm_yr_wk LIMIT 10"),
    )
    add(
        "a7_data_dictionary",
        "column_name dtype role non_null_share:6 example_value",
        lambda sp, d: p.data_dictionary(
            priced_panel(sp, d).select("series_id", "category", "week_start", "promo")
        ),
        s.with_(
            PRICED_SQL,
            """SELECT 'series_id' AS column_name, 'string' AS dtype, 'key' AS role,
                 AVG(CASE WHEN series_id IS NULL THEN 0 ELSE 1 END) AS non_null_share,
                 MIN(series_id) AS example_value FROM priced
               UNION ALL SELECT 'category', 'string', 'static',
                 AVG(CASE WHEN category IS NULL THEN 0 ELSE 1 END), MIN(category) FROM priced
               UNION ALL SELECT 'week_start', 'date', 'time_index',
                 AVG(CASE WHEN week_start IS NULL THEN 0 ELSE 1 END),
                 CAST(MIN(week_start) AS VARCHAR) FROM priced
               UNION ALL SELECT 'promo', 'double', 'future_unknown',
                 AVG(CASE WHEN promo IS NULL THEN 0 ELSE 1 END), '' FROM priced""",
        ),
    )
    add(
        "a7_scenario_dictionary",
        "column_name dtype role non_null_share:6",
        lambda sp, d: p.data_dictionary(scenario_table(sp, d), p.SCENARIO_ROLES),
        s.with_(
            s.scenario_panel(),
            dictionary_sql(
                "scenarios",
                [
                    ("scenario_name", "string", "scenario"),
                    ("series_id", "string", "key"),
                    ("category", "string", "static"),
                    ("week_start", "date", "time_index"),
                    ("is_history", "boolean", "split_flag"),
                    ("sales_units", "double", "target"),
                    ("price", "double", "known_in_advance"),
                    ("promo_planned", "double", "known_in_advance"),
                    ("discount_depth", "double", "known_in_advance"),
                    ("price_known_in_advance", "boolean", "derived"),
                    ("target_name", "string", "derived"),
                ],
            ),
        ),
    )
    add(
        "b1_week_bucket",
        "date week_start lines:i",
        lambda sp, d: star_raw(sp, d)
        .sales.groupBy("date", monday("date").alias("week_start"))
        .agg(F.count(F.lit(1)).alias("lines")),
        f"""SELECT CAST(l_shipdate AS DATE) AS date, {s.WEEK} AS week_start, COUNT(*) AS lines
            FROM lineitem GROUP BY 1, 2""",
    )
    add(
        "b2_wide_to_long",
        "cat_id d date units:2",
        lambda sp, d: p.wide_to_long(cut_lineage(star_wide_categories(sp, d)), star_raw(sp, d).calendar.select("d", "date")),
        s.with_(
            [CALENDAR_SQL],
            """SELECT t.cat_id, c.d, c.date, COALESCE(x.units, 0) AS units
               FROM (SELECT DISTINCT p_type AS cat_id FROM part JOIN lineitem ON l_partkey = p_partkey) t
               CROSS JOIN calendar c
               LEFT JOIN (SELECT p_type AS cat_id, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS units
                          FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) x
                 ON x.cat_id = t.cat_id AND x.date = c.date""",
        ),
    )
    for level, name in (("p_type", "category"), ("sku", "sku")):
        add(
            f"b3_weekly_{name}",
            "series_id category week_start sales_units:2",
            lambda sp, d, level=level: weekly_table(sp, d, level),
            s.with_([s.weekly(level)], "SELECT * FROM weekly"),
        )
    add(
        "b4_day_counts",
        "week_start wm_yr_wk:i day_count:i",
        lambda sp, d: p.day_counts(star_raw(sp, d).calendar),
        s.with_([CALENDAR_SQL, DAY_MAP_SQL], "SELECT * FROM day_map"),
    )

    def store_price(sp, d):
        raw = star_raw(sp, d)
        return p.item_store_price(raw.prices, raw.items, raw.calendar)

    add(
        "b5_item_store_price",
        "item_id cat_id store_id week_start price:4",
        store_price,
        s.with_(PRICE_CTES, "SELECT * FROM store_price"),
    )

    def level_price(sp, d, level):
        raw = star_raw(sp, d)
        return p.weekly_price(raw.prices, raw.items, raw.calendar, level)

    for level, key in (("category", "cat_id"), ("sku", "item_id")):
        add(
            f"b5b_price_{level}",
            "series_id category week_start price:4",
            lambda sp, d, level=level: level_price(sp, d, level),
            s.with_(
                PRICE_CTES,
                f"""SELECT {key} AS series_id, cat_id AS category, week_start, AVG(price) AS price
                    FROM store_price GROUP BY 1, 2, 3""",
            ),
        )
    for level, name in (("p_type", "category"), ("p_brand", "brand")):
        add(
            f"b6_dense_{name}",
            "series_id category week_start sales_units:2",
            lambda sp, d, level=level: panel_table(sp, d, level),
            s.with_(s.panel(level), "SELECT * FROM panel"),
        )
    add(
        "b6_dense_sku_coverage",
        "series_id weeks:i zero_weeks:i first_week last_week units:2",
        lambda sp, d: panel_table(sp, d, "sku")
        .groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("weeks"),
            F.count_if(F.col("sales_units") == 0).alias("zero_weeks"),
            F.min("week_start").alias("first_week"),
            F.max("week_start").alias("last_week"),
            F.sum("sales_units").alias("units"),
        ),
        s.with_(
            s.panel("sku"),
            """SELECT series_id, COUNT(*) AS weeks,
                 SUM(CASE WHEN sales_units = 0 THEN 1 ELSE 0 END) AS zero_weeks,
                 MIN(week_start) AS first_week, MAX(week_start) AS last_week,
                 SUM(sales_units) AS units FROM panel GROUP BY series_id""",
        ),
    )
    add(
        "b7_panel_with_price",
        "series_id category week_start sales_units:2 price:4 promo:2",
        priced_panel,
        s.with_(PRICED_SQL, "SELECT * FROM priced"),
    )
    add(
        "b8_top_series",
        "series_id category week_start sales_units:2",
        lambda sp, d: p.top_series(panel_table(sp, d, "sku"), 20),
        s.with_(
            s.panel("sku"),
            """SELECT * FROM panel WHERE series_id IN (
                 SELECT series_id FROM panel GROUP BY 1
                 ORDER BY SUM(sales_units) DESC, series_id LIMIT 20)""",
        ),
    )
    add(
        "b9_daily_total",
        "date sales_units:2",
        lambda sp, d: p.daily_total(star_raw(sp, d).sales),
        """SELECT CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS sales_units
           FROM lineitem GROUP BY 1""",
    )
    add(
        "b10_weekly_total",
        "timestamp sales_units:2",
        lambda sp, d: p.resample(panel_table(sp, d), "week"),
        s.with_(
            s.panel(),
            "SELECT week_start AS timestamp, SUM(sales_units) AS sales_units FROM panel GROUP BY 1",
        ),
    )
    add(
        "b10_monthly_total",
        "timestamp sales_units:2",
        lambda sp, d: p.resample(panel_table(sp, d), "month"),
        s.with_(
            s.panel(),
            """SELECT CAST(date_trunc('month', week_start) AS DATE) AS timestamp,
               SUM(sales_units) AS sales_units FROM panel GROUP BY 1""",
        ),
    )
    add(
        "b11_scenario_rollup",
        """scenario_name series_id category week_start is_history sales_units:2 price:4
           promo_planned:6 price_known_in_advance target_name""",
        lambda sp, d: sc.roll_up(scenario_table(sp, d)),
        s.with_([*s.scenario_panel(), s.ROLLED], "SELECT * FROM rolled"),
    )
    add(
        "b12_history_panel",
        "scenario_name series_id category week_start sales_units:2 price:4 promo:2",
        lambda sp, d: sc.history_panel(sc.roll_up(scenario_table(sp, d))),
        s.with_(
            [*s.scenario_panel(), s.ROLLED],
            "SELECT *, promo_planned AS promo FROM rolled WHERE is_history",
        ),
    )
    add(
        "b12_full_panel_without_covariates",
        "scenario_name series_id category week_start sales_units:2 price:4 promo:2",
        lambda sp, d: sc.full_panel(sc.roll_up(scenario_table(sp, d).drop("price", "promo_planned"))),
        s.with_(
            [*s.scenario_panel(), s.ROLLED],
            """SELECT scenario_name, series_id, category, week_start, sales_units,
                 CAST(NULL AS DOUBLE) AS price, 0 AS promo FROM rolled""",
        ),
    )

    def counts(sp, d):
        raw = star_raw(sp, d)
        return p.raw_counts(raw.sales, raw.items, raw.stores)

    add(
        "b13_raw_counts",
        """raw_item_count:i raw_store_count:i raw_state_count:i raw_department_count:i
           raw_daily_observations:i""",
        counts,
        """SELECT COUNT(DISTINCT l_partkey) AS raw_item_count,
             COUNT(DISTINCT l_suppkey) AS raw_store_count,
             COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS raw_daily_observations,
             (SELECT COUNT(DISTINCT n_name) FROM supplier JOIN nation ON n_nationkey = s_nationkey)
               AS raw_state_count,
             (SELECT COUNT(DISTINCT p_brand) FROM part) AS raw_department_count FROM lineitem""",
    )
    add(
        "b14_items_per_category",
        "category item_count:i",
        lambda sp, d: p.items_per_category(star_raw(sp, d).items),
        "SELECT p_type AS category, COUNT(DISTINCT p_partkey) AS item_count FROM part GROUP BY 1",
    )
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    add(
        "b15_category_matrix",
        "week_start total:2 " + " ".join(f"{t}:2" for t in types),
        lambda sp, d: p.pivot_categories(cut_lineage(panel_table(sp, d))),
        s.with_(
            s.panel(),
            "SELECT week_start, "
            + ", ".join(
                f"SUM(CASE WHEN category = '{t}' THEN sales_units END) AS \"{t}\"" for t in types
            )
            + ", SUM(sales_units) AS total FROM panel GROUP BY 1",
        ),
    )
    add(
        "b16_union_of_results",
        "model_name horizon:i rows:i",
        lambda sp, d: baseline_table(sp, d)
        .unionByName(baseline_table(sp, d, alignment="target"))
        .groupBy("model_name", "horizon")
        .agg(F.count(F.lit(1)).alias("rows")),
        s.with_(
            s.predictions(),
            "SELECT model_name, horizon, 2 * COUNT(*) AS rows FROM predictions GROUP BY 1, 2",
        ),
    )
