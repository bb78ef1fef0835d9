"""Common table expressions of the SQL twins."""

from __future__ import annotations

from collections.abc import Sequence

LAGS = (1, 2, 3, 4, 8, 12, 13, 26, 52)
ROLLING = (4, 8, 13, 26)
HORIZONS = tuple(range(1, 9))

WEEK = "CAST(date_trunc('week', l_shipdate) AS DATE)"
RETAIL_WEEK = "CAST(floor(date_diff('day', DATE '1994-12-31', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER)"


def with_(ctes: Sequence[str], body: str, recursive: bool = False) -> str:
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {', '.join(ctes)}\n{body}"


def weekly(level: str = "p_type") -> str:
    """Sparse weekly sales; level is a column of part, or ``sku``."""
    if level == "sku":
        ids = "CAST(l_partkey AS VARCHAR) AS series_id, p_type AS category"
    else:
        ids = f"{level} AS series_id, {level} AS category"
    return f"""weekly AS (
        SELECT {ids}, {WEEK} AS week_start, SUM(l_quantity) AS sales_units
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""


def panel(level: str = "p_type") -> list[str]:
    return [
        weekly(level),
        """weeks AS (
        SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start
        FROM (SELECT MIN(week_start) AS lo, MAX(week_start) AS hi FROM weekly))""",
        "series AS (SELECT DISTINCT series_id, category FROM weekly)",
        """panel AS (
        SELECT s.series_id, s.category, w.week_start, COALESCE(x.sales_units, 0) AS sales_units
        FROM series s CROSS JOIN weeks w
        LEFT JOIN weekly x ON x.series_id = s.series_id AND x.week_start = w.week_start)""",
    ]


def segments(source: str = "panel", keys: str = "series_id", name: str = "segments") -> str:
    return f"""{name} AS (
        SELECT *, CASE WHEN history_weeks < 26 THEN 'problematic'
                       WHEN zero_share >= 0.4 THEN 'intermittent'
                       WHEN sd / NULLIF(mu, 0) <= 0.3 THEN 'stable'
                       ELSE 'medium_noise' END AS segment_label,
               history_weeks < 52 AS short_history, zero_share >= 0.4 AS high_zero_share,
               COALESCE(sd / NULLIF(mu, 0) > 1, TRUE) AS high_variance
        FROM (SELECT {keys}, COUNT(*) AS history_weeks,
                     AVG(CASE WHEN sales_units = 0 THEN 1 ELSE 0 END) AS zero_share,
                     STDDEV_POP(sales_units) AS sd, AVG(sales_units) AS mu,
                     VAR_POP(sales_units) AS variance
              FROM {source} GROUP BY {keys}))"""


def lag_sql(k: int) -> str:
    return f"LAG(sales_units, {k}) OVER ord AS lag_{k}"


def frame(w: int) -> str:
    return f"(PARTITION BY series_id ORDER BY week_start ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def rolling_sql(w: int, stats: Sequence[str] | None = None) -> list[str]:
    f = frame(w)
    full = f"COUNT(sales_units) OVER {f} = {w}"
    made = {
        "mean": f"CASE WHEN {full} THEN AVG(sales_units) OVER {f} END",
        "median": f"CASE WHEN {full} THEN QUANTILE_CONT(sales_units, 0.5) OVER {f} END",
        "std": f"CASE WHEN {full} THEN STDDEV_SAMP(sales_units) OVER {f} END",
        "min": f"CASE WHEN {full} THEN MIN(sales_units) OVER {f} END",
        "max": f"CASE WHEN {full} THEN MAX(sales_units) OVER {f} END",
        "ratio_to_rolling_mean": f"LAG(sales_units, 1) OVER ord / NULLIF(CASE WHEN {full} THEN AVG(sales_units) OVER {f} END, 0)",
        "recent_trend_delta": f"LAG(sales_units, 1) OVER ord - LAG(sales_units, {w}) OVER ord",
    }
    return [f"{made[s]} AS rolling_{w}_{s}" for s in (stats or made)]


CALENDAR = [
    "WEEK(week_start) AS week_of_year",
    "MONTH(week_start) AS month",
    "QUARTER(week_start) AS quarter",
    "YEAR(week_start) AS year",
    "(DAY(week_start) - 1) // 7 + 1 AS week_in_month",
]


def features(columns: Sequence[str], source: str = "panel", name: str = "features") -> str:
    return f"""{name} AS (
        SELECT *, {', '.join(columns)} FROM {source}
        WINDOW ord AS (PARTITION BY series_id ORDER BY week_start))"""


def windows(
    h_min: int = 1, h_max: int = 8, min_train: int = 64, step: int = 1, last: int | None = None
) -> list[str]:
    keep = f"WHERE back <= {last}" if last else ""
    return [
        """numbered AS (
        SELECT week_start, ROW_NUMBER() OVER (ORDER BY week_start) - 1 AS i, COUNT(*) OVER () AS n
        FROM (SELECT DISTINCT week_start FROM panel))""",
        f"""origins AS (
        SELECT week_start, i FROM (
            SELECT *, ROW_NUMBER() OVER (ORDER BY i DESC) AS back FROM numbered
            WHERE i >= {min_train - 1} AND i < n - {h_max} AND (i - {min_train - 1}) % {step} = 0)
        {keep})""",
        f"""windows AS (
        SELECT f.week_start AS train_start, e.week_start AS train_end,
               o.week_start AS forecast_origin, h.horizon, t.week_start AS test_start
        FROM origins o
        CROSS JOIN (SELECT unnest(generate_series({h_min}, {h_max})) AS horizon) h
        JOIN numbered f ON f.i = 0
        JOIN numbered e ON e.i = o.i - h.horizon
        JOIN numbered t ON t.i = o.i + h.horizon
        WHERE o.i >= {min_train - 1} + h.horizon)""",
    ]


def baseline_predictions(alignment: str = "reference") -> list[str]:
    """panel, segments and windows must come before."""
    if alignment == "reference":
        naive, seasonal = "p.lag_1", "COALESCE(p.lag_52, p.lag_1)"
    else:
        naive, seasonal = "p.sales_units", "COALESCE(y.sales_units, p.sales_units)"
    shared = """g.segment_label, w.forecast_origin, w.test_start AS target_date, w.horizon,
               a.sales_units AS actual"""
    tables = """FROM windows w
        JOIN lagged p ON p.week_start = w.forecast_origin
        JOIN panel a ON a.series_id = p.series_id AND a.week_start = w.test_start
        LEFT JOIN panel y ON y.series_id = p.series_id
             AND y.week_start = w.test_start - INTERVAL 364 DAY
        LEFT JOIN segments g ON g.series_id = p.series_id"""
    return [
        features([lag_sql(1), lag_sql(52)], name="lagged"),
        f"""predictions AS (
        SELECT 'naive' AS model_name, 'baseline' AS model_family, p.series_id, p.category, {shared},
               {naive} AS prediction {tables}
        UNION ALL
        SELECT 'seasonal_naive', 'baseline', p.series_id, p.category, {shared},
               {seasonal} {tables})""",
    ]


def predictions(level: str = "p_type", alignment: str = "reference") -> list[str]:
    return [*panel(level), segments(), *windows(), *baseline_predictions(alignment)]


METRICS = """SUM(ABS(prediction - actual)) / NULLIF(SUM(ABS(actual)), 0) AS "WAPE",
       AVG(200 * ABS(prediction - actual) / CASE WHEN ABS(actual) + ABS(prediction) = 0 THEN 1
           ELSE ABS(actual) + ABS(prediction) END) AS "sMAPE",
       AVG(ABS(prediction - actual)) AS "MAE",
       SQRT(AVG((prediction - actual) * (prediction - actual))) AS "RMSE",
       AVG(prediction - actual) AS "Bias",
       QUANTILE_CONT(ABS(prediction - actual), 0.5) AS "MedianAE\""""
METRIC_SPEC = "WAPE:6 sMAPE:4 MAE:4 RMSE:4 Bias:4 MedianAE:4"


def metrics(by: str, source: str = "predictions") -> str:
    return f"SELECT {by}, {METRICS} FROM {source} GROUP BY {by}"


def scenario_panel(future_weeks: int = 8) -> list[str]:
    return [
        f"""scen_weekly AS (
        SELECT l_returnflag AS scenario_name, p_brand || '/' || p_type AS series_id,
               p_type AS category, {WEEK} AS week_start, SUM(l_quantity) AS sales_units,
               AVG(l_extendedprice / l_quantity) AS price,
               CAST(MAX(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS DOUBLE) AS promo_planned,
               MAX(l_discount) AS discount_depth
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4)""",
        """scen_weeks AS (
        SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start
        FROM (SELECT MIN(week_start) AS lo, MAX(week_start) AS hi FROM scen_weekly))""",
        "scen_keys AS (SELECT DISTINCT scenario_name, series_id, category FROM scen_weekly)",
        f"""scenarios AS (
        SELECT k.scenario_name, k.series_id, k.category, w.week_start,
               w.week_start <= (SELECT MAX(week_start) FROM scen_weekly) - INTERVAL {7 * future_weeks} DAY
                   AS is_history,
               COALESCE(x.sales_units, 0) AS sales_units, x.price,
               COALESCE(x.promo_planned, 0) AS promo_planned,
               COALESCE(x.discount_depth, 0) AS discount_depth,
               TRUE AS price_known_in_advance, 'sales_units' AS target_name
        FROM scen_keys k CROSS JOIN scen_weeks w
        LEFT JOIN scen_weekly x ON x.scenario_name = k.scenario_name
             AND x.series_id = k.series_id AND x.week_start = w.week_start)""",
    ]


ROLLED = """rolled AS (
        SELECT scenario_name, category AS series_id, category, week_start, is_history,
               SUM(sales_units) AS sales_units, AVG(price) AS price,
               AVG(promo_planned) AS promo_planned,
               BOOL_AND(price_known_in_advance) AS price_known_in_advance,
               MIN(target_name) AS target_name
        FROM scenarios GROUP BY scenario_name, category, week_start, is_history)"""
