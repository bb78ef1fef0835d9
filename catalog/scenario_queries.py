"""Scenario expansion, demand formula and scenario profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlbase as s
from catalog.registry import Registry
from catalog.tables import scenario_table
from weekcast.operators import scenarios as sc
from weekcast.sources.raw import head

START, HISTORY, FUTURE = "2022-01-03", 208, 8

PARAMS_SQL = """params AS (
    SELECT scenario_name, series_id, category, category_rank,
           AVG(sales_units) AS base_level, AVG(price) AS base_price,
           AVG(promo_planned) / 2 AS promo_lift, -0.4 - AVG(discount_depth) AS elasticity,
           AVG(discount_depth) AS trend_slope, AVG(discount_depth) * 2 AS yearly_amplitude,
           AVG(discount_depth) / 2 AS monthly_amplitude,
           AVG(promo_planned) * 3 AS phase_year, AVG(promo_planned) AS phase_month
    FROM (SELECT x.*, r.category_rank FROM scenarios x JOIN (
            SELECT category, ROW_NUMBER() OVER (ORDER BY category) - 1 AS category_rank
            FROM (SELECT DISTINCT category FROM scenarios)) r ON r.category = x.category)
    GROUP BY 1, 2, 3, 4)"""

EXPANDED_SQL = f"""expanded AS (
    SELECT p.*, t.time_index, {HISTORY + FUTURE} AS total_weeks,
           CAST(DATE '{START}' + to_days(7 * CAST(t.time_index AS INTEGER)) AS DATE) AS week_start,
           t.time_index < {HISTORY} AS is_history,
           CASE WHEN (t.time_index + LENGTH(p.series_id)) % 7 = 0 THEN 1 ELSE 0 END AS promo_planned,
           p.base_price * CASE WHEN t.time_index % 9 = 0 THEN 0.9::DOUBLE ELSE 1 END AS price
    FROM params p CROSS JOIN (SELECT unnest(generate_series(0, {HISTORY + FUTURE - 1})) AS time_index) t)"""


def params(sp, d):
    """Demand parameters estimated per scenario and series from the observed panel."""
    frame = scenario_table(sp, d)
    ranks = frame.select("category").distinct()
    listed = ranks.agg(F.array_sort(F.collect_list("category"))).scalar()
    discount, promo = F.avg("discount_depth"), F.avg("promo_planned")
    return (
        frame.groupBy("scenario_name", "series_id", "category")
        .agg(
            F.avg("sales_units").alias("base_level"),
            F.avg("price").alias("base_price"),
            (promo / 2).alias("promo_lift"),
            (-0.4 - discount).alias("elasticity"),
            discount.alias("trend_slope"),
            (discount * 2).alias("yearly_amplitude"),
            (discount / 2).alias("monthly_amplitude"),
            (promo * 3).alias("phase_year"),
            promo.alias("phase_month"),
        )
        .withColumn("_categories", listed)
        .withColumn("category_rank", F.array_position("_categories", F.col("category")) - 1)
        .drop("_categories")
    )


def expanded(sp, d):
    frame = sc.expand_scenarios(params(sp, d), START, HISTORY, FUTURE)
    t = F.col("time_index")
    return frame.withColumns(
        {
            "promo_planned": F.when((t + F.length("series_id")) % 7 == 0, 1).otherwise(0),
            "price": F.col("base_price") * F.when(t % 9 == 0, 0.9).otherwise(1.0),
        }
    )


def register(q: Registry) -> None:
    add = q.add
    add(
        "i1_expand_scenarios",
        "scenario_name series_id category time_index:i week_start week_of_year:i is_history",
        expanded,
        s.with_(
            [*s.scenario_panel(), PARAMS_SQL, EXPANDED_SQL],
            "SELECT *, WEEK(week_start) AS week_of_year FROM expanded",
        ),
    )
    add(
        "i2_expected_demand",
        "scenario_name series_id time_index:i promo_planned:i price:3 expected_sales_units:3",
        lambda sp, d: expanded(sp, d).withColumn("expected_sales_units", sc.expected_demand()),
        s.with_(
            [*s.scenario_panel(), PARAMS_SQL, EXPANDED_SQL],
            """SELECT *, GREATEST(base_level * (1 + 0.03::DOUBLE * (category_rank - 1))
                 * (1 + trend_slope * time_index / GREATEST(total_weeks - 1, 1))
                 * (1 + yearly_amplitude * SIN(2 * PI() * time_index / 52 + phase_year))
                 * (1 + monthly_amplitude * SIN(2 * PI() * time_index / 13 + phase_month))
                 * (1 + promo_lift * promo_planned)
                 * COALESCE(CASE WHEN base_price > 0 THEN POW(price / base_price, elasticity) END, 1),
                 1) AS expected_sales_units FROM expanded""",
        ),
    )
    add(
        "i3_series_metadata",
        """scenario_name series_id category history_weeks:i total_weeks:i mean_sales:4 std_sales:4
           zero_share:6 promo_share:6 avg_price:3""",
        lambda sp, d: sc.series_metadata(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            """SELECT scenario_name, series_id, category,
                 SUM(CASE WHEN is_history THEN 1 ELSE 0 END) AS history_weeks,
                 COUNT(*) AS total_weeks, AVG(sales_units) AS mean_sales,
                 COALESCE(STDDEV_SAMP(sales_units), 0) AS std_sales,
                 AVG(CASE WHEN sales_units = 0 THEN 1 ELSE 0 END) AS zero_share,
                 AVG(promo_planned) AS promo_share, AVG(price) AS avg_price
               FROM scenarios GROUP BY 1, 2, 3""",
        ),
    )
    facts = [
        ("number_of_rows", "COUNT(*)"),
        ("number_of_series", "COUNT(DISTINCT series_id)"),
        ("number_of_scenarios", "COUNT(DISTINCT scenario_name)"),
        ("number_of_categories", "COUNT(DISTINCT category)"),
        ("history_rows", "SUM(CASE WHEN is_history THEN 1 ELSE 0 END)"),
        ("future_rows", "SUM(CASE WHEN is_history THEN 0 ELSE 1 END)"),
        ("mean_sales_units", "AVG(sales_units)"),
        ("zero_share", "AVG(CASE WHEN sales_units = 0 THEN 1 ELSE 0 END)"),
        ("promo_share", "AVG(promo_planned)"),
    ]
    add(
        "i4_scenario_profile",
        "metric value:6 text",
        lambda sp, d: sc.scenario_profile(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            " UNION ALL ".join(
                f"""SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS value,
                    CAST(NULL AS VARCHAR) AS text FROM scenarios"""
                for m, e in facts
            )
            + """ UNION ALL SELECT 'period_start', NULL, CAST(MIN(week_start) AS VARCHAR) FROM scenarios
                 UNION ALL SELECT 'period_end', NULL, CAST(MAX(week_start) AS VARCHAR) FROM scenarios""",
        ),
    )
    sample = "scenario_name series_id category week_start is_history sales_units:2 price:3 promo_planned:2"
    add(
        "i5_first_rows",
        sample,
        lambda sp, d: head(
            scenario_table(sp, d), ["scenario_name", "series_id", "week_start"], 20
        ),
        s.with_(
            s.scenario_panel(),
            "SELECT * FROM scenarios ORDER BY scenario_name, series_id, week_start LIMIT 20",
        ),
    )
    add(
        "i5_example_tails",
        sample,
        lambda sp, d: sc.example_tails(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            """SELECT * FROM (SELECT x.*, ROW_NUMBER() OVER (
                   PARTITION BY x.scenario_name, x.series_id ORDER BY x.week_start DESC) AS n
                 FROM scenarios x JOIN (
                   SELECT DISTINCT scenario_name, series_id FROM scenarios
                   ORDER BY scenario_name, series_id LIMIT 3) k
                 ON k.scenario_name = x.scenario_name AND k.series_id = x.series_id)
               WHERE n <= 12""",
        ),
    )
    add(
        "i6_series_per_category",
        "scenario_name category series_count:i",
        lambda sp, d: sc.series_per_category(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            """SELECT scenario_name, category, COUNT(DISTINCT series_id) AS series_count
               FROM scenarios GROUP BY 1, 2""",
        ),
    )
    add(
        "v13_scenario_weekly_totals",
        "scenario_name week_start total_sales_units:2",
        lambda sp, d: sc.scenario_weekly_totals(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            """SELECT scenario_name, week_start, SUM(sales_units) AS total_sales_units
               FROM scenarios GROUP BY 1, 2""",
        ),
    )
    add(
        "v13_scenario_series_means",
        "scenario_name series_id mean_sales_units:4",
        lambda sp, d: sc.scenario_series_means(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            """SELECT scenario_name, series_id, AVG(sales_units) AS mean_sales_units
               FROM scenarios GROUP BY 1, 2""",
        ),
    )
