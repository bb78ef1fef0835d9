"""Features, segments and backtest windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlbase as s
from catalog.panel_queries import PRICED_SQL, priced_panel
from catalog.registry import Registry
from catalog.tables import history_table, panel_table, scenario_table, setup, weekly_table
from weekcast.operators import features as f
from weekcast.operators import scenarios as sc
from weekcast.operators import windows as w
from weekcast.operators.audit import series_summary
from weekcast.operators.panel import dense_histories, densify
from weekcast.operators.segments import segment_series, segment_summary
from weekcast.session import cut_lineage

KEY = "series_id week_start"


def _rolling(sp, d, stats):
    panel = panel_table(sp, d, "p_brand")
    made = f.rolling_columns(f.series_order(), f.Features().rolling_windows)
    return panel.withColumns({k: v for k, v in made.items() if k.split("_", 2)[2] in stats})


def _rolling_pair(q: Registry, name: str, stats: tuple[str, ...]) -> None:
    names = [f"rolling_{n}_{x}" for n in s.ROLLING for x in stats]
    sql = [c for n in s.ROLLING for c in s.rolling_sql(n, stats)]
    q.add(
        name,
        f"{KEY} " + " ".join(f"{n}:4" for n in names),
        lambda sp, d: _rolling(sp, d, stats),
        s.with_([*s.panel("p_brand"), s.features(sql)], "SELECT * FROM features"),
    )


CODES = [
    """category_codes AS (
        SELECT category, ROW_NUMBER() OVER (ORDER BY category) - 1 AS category_code
        FROM (SELECT DISTINCT category FROM panel))""",
    """segment_codes AS (
        SELECT segment_label, ROW_NUMBER() OVER (ORDER BY segment_label) - 1 AS segment_code
        FROM (SELECT DISTINCT segment_label FROM segments))""",
]


def _supervised_sql(level: str) -> list[str]:
    columns = [s.lag_sql(k) for k in s.LAGS]
    columns += [c for n in s.ROLLING for c in s.rolling_sql(n)]
    columns += s.CALENDAR
    columns += [f"LEAD(sales_units, {h}) OVER ord AS target_h{h}" for h in s.HORIZONS]
    return [
        *s.panel(level),
        s.segments(),
        *CODES,
        s.features(columns),
        """supervised AS (
        SELECT f.*, g.segment_label, c.category_code, k.segment_code
        FROM features f JOIN segments g ON g.series_id = f.series_id
        JOIN category_codes c ON c.category = f.category
        JOIN segment_codes k ON k.segment_label = g.segment_label)""",
    ]


def _spec(names) -> str:
    return " ".join(f"{n}:4" for n in names)


def register(q: Registry) -> None:
    add = q.add
    lags = [f"lag_{k}" for k in s.LAGS]
    add(
        "c1_lags",
        f"{KEY} sales_units:2 " + " ".join(f"{c}:2" for c in lags),
        lambda sp, d: panel_table(sp, d, "p_brand").withColumns(
            f.lag_columns(f.series_order(), s.LAGS)
        ),
        s.with_(
            [*s.panel("p_brand"), s.features([s.lag_sql(k) for k in s.LAGS])],
            "SELECT * FROM features",
        ),
    )
    _rolling_pair(q, "c2_rolling_mean", ("mean",))
    _rolling_pair(q, "c3_rolling_median", ("median",))
    _rolling_pair(q, "c4_rolling_std", ("std",))
    _rolling_pair(q, "c5_rolling_min_max", ("min", "max"))
    _rolling_pair(q, "c6_ratio_to_rolling_mean", ("ratio_to_rolling_mean",))
    _rolling_pair(q, "c7_recent_trend_delta", ("recent_trend_delta",))
    add(
        "c8_calendar",
        "week_start week_of_year:i month:i quarter:i year:i week_in_month:i",
        lambda sp, d: panel_table(sp, d)
        .select("week_start")
        .distinct()
        .withColumns(f.calendar_columns()),
        s.with_(s.panel(), f"SELECT week_start, {', '.join(s.CALENDAR)} FROM weeks"),
    )

    def coded(sp, d):
        histories = cut_lineage(history_table(sp, d, "sku").drop("runs", "y")).withColumn("sku", F.col("series_id"))
        return f.encode(histories, segment_series(histories), ["series_id"])

    add(
        "c9_codes_sku",
        "series_id segment_label category_code:i segment_code:i sku_code:i",
        coded,
        s.with_(
            [*s.panel("sku"), s.segments(), *CODES],
            """SELECT x.series_id, g.segment_label, c.category_code, k.segment_code,
                 ROW_NUMBER() OVER (ORDER BY x.series_id) - 1 AS sku_code
               FROM series x JOIN segments g ON g.series_id = x.series_id
               JOIN category_codes c ON c.category = x.category
               JOIN segment_codes k ON k.segment_label = g.segment_label""",
        ),
    )

    def with_price(sp, d):
        panel = priced_panel(sp, d)
        chosen = f.Features(
            feature_set="F5", lags=(1,), rolling_windows=(4,), use_price=True, use_promo=True
        )
        return f.supervised(panel, segment_series(panel), chosen, horizons=(1,))

    add(
        "c10_price_promo",
        f"{KEY} lag_1:2 price:4 promo:2 target_h1:2",
        with_price,
        s.with_(
            [
                *PRICED_SQL,
                s.features([s.lag_sql(1), "LEAD(sales_units, 1) OVER ord AS target_h1"], "priced"),
            ],
            "SELECT * REPLACE (0 AS promo) FROM features",
        ),
    )

    def with_infinite(sp, d):
        zero = F.when(F.weekofyear("week_start") == 1, F.lit(float("inf"))).otherwise(
            F.col("sales_units")
        )
        panel = panel_table(sp, d).withColumn("sales_units", zero)
        plain = f.Features(feature_set="F1", lags=(1,))
        return f.supervised(panel, segment_series(panel_table(sp, d)), plain, horizons=(1,))

    add(
        "c11_infinite_to_null",
        f"{KEY} sales_units:2",
        with_infinite,
        s.with_(
            s.panel(),
            """SELECT series_id, week_start,
                 CASE WHEN WEEK(week_start) = 1 THEN NULL ELSE sales_units END AS sales_units
               FROM panel""",
        ),
    )
    targets = [f"target_h{h}" for h in s.HORIZONS]
    add(
        "c12_targets",
        f"{KEY} " + " ".join(f"{t}:2" for t in targets),
        lambda sp, d: panel_table(sp, d, "p_brand").withColumns(
            f.target_columns(f.series_order(), s.HORIZONS)
        ),
        s.with_(
            [
                *s.panel("p_brand"),
                s.features([f"LEAD(sales_units, {h}) OVER ord AS target_h{h}" for h in s.HORIZONS]),
            ],
            "SELECT * FROM features",
        ),
    )
    names = f.feature_names(["series_id"], f.Features())

    def table(sp, d, level):
        panel = panel_table(sp, d, level)
        return f.supervised(panel, segment_series(panel))

    for level, name in (("p_type", "category"), ("p_brand", "brand")):
        add(
            f"c13_supervised_{name}",
            f"{KEY} category segment_label sales_units:2 {_spec(names)} {_spec(targets)}",
            lambda sp, d, level=level: table(sp, d, level),
            s.with_(_supervised_sql(level), "SELECT * FROM supervised"),
        )
    add(
        "c14_trailing_mean",
        f"{KEY} sales_units:2 rolling_10:4",
        lambda sp, d: f.trailing_mean(panel_table(sp, d, "p_brand")),
        s.with_(
            s.panel("p_brand"),
            """SELECT series_id, week_start, sales_units, AVG(sales_units) OVER (
                 PARTITION BY series_id ORDER BY week_start
                 ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_10 FROM panel""",
        ),
    )
    add(
        "c15_example_series",
        "category series_id total_sales_units:2",
        lambda sp, d: f.example_series(panel_table(sp, d, "sku")),
        s.with_(
            s.panel("sku"),
            """SELECT category, series_id, total AS total_sales_units FROM (
                 SELECT *, ROW_NUMBER() OVER (
                   PARTITION BY category ORDER BY total DESC, series_id) AS n
                 FROM (SELECT category, series_id, SUM(sales_units) AS total
                       FROM panel GROUP BY 1, 2)) WHERE n = 1""",
        ),
    )

    def snapshot(sp, d):
        sparse = weekly_table(sp, d, "sku")
        histories = cut_lineage(dense_histories(sparse).drop("runs", "y"))
        # Only the example series are made dense.
        chosen = f.example_series(histories).select("series_id")
        panel = densify(sparse.join(chosen, "series_id", "left_semi"), period=sparse)
        return f.feature_snapshot(panel, segment_series(histories), histories=histories)

    kept = [c for c in f.SNAPSHOT_COLUMNS if c not in (*KEY.split(), "category", "segment_label")]
    add(
        "c16_feature_snapshot",
        f"{KEY} category segment_label {_spec(kept)}",
        snapshot,
        s.with_(
            [
                *s.panel("sku"),
                s.segments(name="all_segments"),
                """chosen AS (
                SELECT series_id FROM (
                  SELECT *, ROW_NUMBER() OVER (
                    PARTITION BY category ORDER BY total DESC, series_id) AS n
                  FROM (SELECT category, series_id, SUM(sales_units) AS total
                        FROM panel GROUP BY 1, 2)) WHERE n = 1)""",
                "picked AS (SELECT * FROM panel WHERE series_id IN (SELECT series_id FROM chosen))",
                """segments AS (
                SELECT * FROM all_segments WHERE series_id IN (SELECT series_id FROM chosen))""",
                CODES[0].replace("FROM panel", "FROM picked"),
                CODES[1],
                s.features(
                    [s.lag_sql(k) for k in s.LAGS]
                    + [c for n in (4, 13) for c in s.rolling_sql(n)]
                    + s.CALENDAR,
                    "picked",
                ),
            ],
            """SELECT * FROM (
                 SELECT f.*, g.segment_label, c.category_code, k.segment_code,
                   ROW_NUMBER() OVER (PARTITION BY f.series_id ORDER BY f.week_start DESC) AS n
                 FROM features f JOIN segments g ON g.series_id = f.series_id
                 JOIN category_codes c ON c.category = f.category
                 JOIN segment_codes k ON k.segment_label = g.segment_label
                 WHERE f.lag_52 IS NOT NULL) WHERE n <= 20""",
        ),
    )
    for level, name in (("p_type", "category"), ("sku", "sku")):
        add(
            f"d1_segments_{name}",
            """series_id segment_label history_weeks:i zero_share:6 short_history high_zero_share
               variance:2 high_variance""",
            lambda sp, d, level=level: segment_series(panel_table(sp, d, level)),
            s.with_([*s.panel(level), s.segments()], "SELECT * FROM segments"),
        )
    add(
        "d2_short_series_labels",
        "series_id segment_label history_weeks:i short_history",
        lambda sp, d: segment_series(weekly_table(sp, d, "sku")),
        s.with_([s.weekly("sku"), s.segments("weekly")], "SELECT * FROM segments"),
    )
    add(
        "d3_segment_summary",
        """segment_label series_count:i share_of_series:6 mean_history_weeks:4 mean_zero_share:6
           mean_outlier_share:6 mean_total_sales:4""",
        lambda sp, d: segment_summary(series_summary(panel_table(sp, d, "sku"))),
        s.with_(
            [*s.panel("sku"), s.segments(), *SUMMARY_SQL],
            """SELECT segment_label, COUNT(*) AS series_count,
                 COUNT(*) / (SELECT COUNT(*) FROM summary)::DOUBLE AS share_of_series,
                 AVG(history_weeks) AS mean_history_weeks, AVG(zero_share) AS mean_zero_share,
                 AVG(outlier_share) AS mean_outlier_share,
                 AVG(total_sales_units) AS mean_total_sales
               FROM summary GROUP BY 1""",
        ),
    )
    window_spec = "horizon:i train_start train_end forecast_origin test_start test_end"
    for name, settings in {
        "w1_rolling_windows": dict(),
        "w1_rolling_windows_stepped": dict(step=4, last=32),
    }.items():
        backtest = w.Backtest(
            step_weeks=settings.get("step", 1), max_windows=settings.get("last")
        )
        add(
            name,
            window_spec,
            lambda sp, d, b=backtest: w.rolling_windows(weekly_table(sp, d), b),
            s.with_(
                [*s.panel(), *s.windows(**settings)],
                "SELECT *, test_start AS test_end FROM windows",
            ),
        )
    add(
        "w2_broken_windows",
        "horizon:i forecast_origin train_end test_start",
        lambda sp, d: w.broken_windows(w.rolling_windows(panel_table(sp, d))),
        s.with_(
            [*s.panel(), *s.windows()], "SELECT * FROM windows WHERE NOT train_end < test_start"
        ),
    )

    add(
        "w3_window_slices",
        "horizon:i forecast_origin train_rows:i predict_rows:i",
        lambda sp, d: w.slice_sizes(*_panel_and_windows(sp, d)),
        s.with_(
            [*s.panel("p_brand"), *s.windows()],
            """SELECT w.horizon, w.forecast_origin,
                 (SELECT COUNT(*) FROM panel p WHERE p.week_start <= w.train_end) AS train_rows,
                 (SELECT COUNT(*) FROM panel p WHERE p.week_start = w.forecast_origin)
                   AS predict_rows FROM windows w""",
        ),
    )
    add(
        "w4_future_windows",
        "scenario_name horizon:i forecast_origin train_end test_start",
        lambda sp, d: w.future_windows(scenario_table(sp, d), 8, ("scenario_name",)),
        s.with_(
            s.scenario_panel(),
            """SELECT scenario_name, horizon, origin AS forecast_origin,
                 CAST(origin - to_days(7 * CAST(horizon AS INTEGER)) AS DATE) AS train_end,
                 CAST(origin + to_days(7 * CAST(horizon AS INTEGER)) AS DATE) AS test_start
               FROM (SELECT scenario_name, MAX(week_start) AS origin FROM scenarios
                     WHERE is_history GROUP BY 1)
               CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS horizon)""",
        ),
    )
    add(
        "w5_validation_windows",
        "horizon:i forecast_origin train_end test_start",
        lambda sp, d: w.validation_windows(sc.history_panel(scenario_table(sp, d)), 8),
        s.with_(
            [
                *s.scenario_panel(),
                """numbered AS (
                SELECT week_start, ROW_NUMBER() OVER (ORDER BY week_start) - 1 AS i,
                       COUNT(*) OVER () AS n
                FROM (SELECT DISTINCT week_start FROM scenarios WHERE is_history))""",
            ],
            """SELECT h.horizon, o.week_start AS forecast_origin, e.week_start AS train_end,
                 t.week_start AS test_start
               FROM (SELECT unnest(generate_series(1, 8)) AS horizon) h
               JOIN numbered t ON t.i = t.n - 1
               JOIN numbered o ON o.i = o.n - 1 - h.horizon
               JOIN numbered e ON e.i = e.n - 1 - 2 * h.horizon""",
        ),
    )
    add(
        "w6_infer_horizon",
        "horizon:i",
        lambda sp, d: w.infer_horizon(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            "SELECT COUNT(DISTINCT week_start) AS horizon FROM scenarios WHERE NOT is_history",
        ),
    )


def _panel_and_windows(sp, d):
    x = setup(sp, d, "p_brand")
    return x.panel, x.windows


SUMMARY_SQL = [
    """indexed AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY week_start) - 1 AS i FROM panel)""",
    """medians AS (
        SELECT series_id, QUANTILE_CONT(sales_units, 0.5) AS med, STDDEV_POP(sales_units) AS sd
        FROM panel GROUP BY 1)""",
    """outliers AS (
        SELECT p.series_id, CASE WHEN MAX(m.sd) > 0 THEN
            AVG(CASE WHEN ABS(p.sales_units - m.med) > 3 * m.sd THEN 1 ELSE 0 END) ELSE 0 END
            AS outlier_share
        FROM panel p JOIN medians m ON m.series_id = p.series_id GROUP BY 1)""",
    """levels AS (
        SELECT series_id, MIN(category) AS category, MIN(week_start) AS start_date,
               MAX(week_start) AS end_date, SUM(sales_units) AS total_sales_units,
               AVG(sales_units) AS mean_sales_units, REGR_SLOPE(sales_units, i) AS slope,
               AVG(CASE WHEN sales_units IS NULL THEN 1 ELSE 0 END) AS missing_share
        FROM indexed GROUP BY 1)""",
    """summary AS (
        SELECT l.*, g.history_weeks, g.zero_share, g.segment_label, g.short_history,
               g.high_zero_share, g.variance, g.high_variance, m.med AS median_sales_units,
               m.sd AS std_sales_units, o.outlier_share,
               date_diff('day', l.start_date, l.end_date) // 7 + 1 AS expected_weeks,
               g.history_weeks / (date_diff('day', l.start_date, l.end_date) // 7 + 1)::DOUBLE
                   AS grid_coverage,
               g.history_weeks / (date_diff('day', l.start_date, l.end_date) // 7 + 1)::DOUBLE
                   >= 0.999999 AS weekly_grid_complete,
               m.sd / NULLIF(l.mean_sales_units, 0) AS coefficient_of_variation,
               CASE WHEN g.history_weeks > 1 AND m.sd > 0
                    THEN ABS(l.slope) * g.history_weeks / m.sd ELSE 0 END AS trend_strength
        FROM levels l JOIN segments g ON g.series_id = l.series_id
        JOIN medians m ON m.series_id = l.series_id
        JOIN outliers o ON o.series_id = l.series_id)""",
]
