"""Audit tables, seasonality tests and chart tables."""

from __future__ import annotations



from catalog import sqlbase as s
from catalog.feature_queries import SUMMARY_SQL
from catalog.registry import Registry
from catalog.tables import baseline_table, history_table, panel_table, weekly_table
from weekcast.operators import audit as a
from weekcast.operators import charts as c
from weekcast.operators import evaluate as ev
from weekcast.operators import panel as p
from weekcast.operators import seasonality as se
from weekcast.operators import windows as w
from weekcast.operators.features import example_series
from weekcast.operators.segments import segment_series
from weekcast.session import cut_lineage
from weekcast.sources.star import star_raw

SUMMARY_SPEC = """series_id start_date end_date history_weeks:i total_sales_units:2
    mean_sales_units:4 median_sales_units:4 std_sales_units:4 zero_share:6 missing_share:6
    outlier_share:6 category segment_label short_history high_zero_share variance:2 high_variance
    expected_weeks:i grid_coverage:6 weekly_grid_complete coefficient_of_variation:6
    trend_strength:6"""
ACF_SPEC = "series_id " + " ".join(f"acf_lag_{k}:6" for k in a.ACF_LAGS)


def summary_sql(level: str) -> list[str]:
    return [*s.panel(level), s.segments(), *SUMMARY_SQL]


def summary_table(sp, d, level="sku"):
    """Written once: rankings and totals read it more than once."""
    return cut_lineage(a.series_summary(history_table(sp, d, level)))


def metric_sql(pairs: list[tuple[str, str]], source: str, name: str = "metric") -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS {name}, CAST({e} AS DOUBLE) AS value FROM {source}" for m, e in pairs
    )


def acf_sql(lags=a.ACF_LAGS) -> list[str]:
    def one(k: int) -> str:
        r = f"CORR(sales_units, lag_{k})"
        return f"""CASE WHEN COUNT(*) <= {k} THEN NULL WHEN STDDEV_POP(sales_units) = 0 THEN 0
            WHEN ISNAN({r}) THEN NULL ELSE {r} END AS acf_lag_{k}"""

    return [
        s.features([s.lag_sql(k) for k in lags], name="lagged"),
        f"""acf AS (SELECT series_id, {', '.join(one(k) for k in lags)}
            FROM lagged GROUP BY series_id)""",
    ]


RANKED = """ranked AS (
    SELECT *, ROW_NUMBER() OVER big AS sales_rank,
           total_sales_units / SUM(total_sales_units) OVER () AS sales_share,
           SUM(total_sales_units) OVER big / SUM(total_sales_units) OVER ()
               AS cumulative_sales_share
    FROM summary WINDOW big AS (
        ORDER BY total_sales_units DESC, mean_sales_units DESC, series_id))"""

CATEGORY_WEEKLY = """cw AS (
    SELECT category, week_start, SUM(sales_units) AS value FROM panel GROUP BY 1, 2)"""


def correlation_sql(source: str) -> str:
    return f"""SELECT x.category AS category_a, y.category AS category_b,
        CASE WHEN ISNAN(CORR(x.value, y.value)) THEN NULL ELSE CORR(x.value, y.value) END
            AS correlation
        FROM {source} x JOIN {source} y ON y.week_start = x.week_start
        WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2"""


SEASONAL_INDEX = """seasonal AS (
    SELECT x.*, m.category_mean_sales_units,
           x.mean_sales_units / NULLIF(m.category_mean_sales_units, 0) AS seasonal_index
    FROM (SELECT category, WEEK(week_start) AS week_of_year, AVG(sales_units) AS mean_sales_units
          FROM panel GROUP BY 1, 2) x
    JOIN (SELECT category, AVG(sales_units) AS category_mean_sales_units
          FROM panel GROUP BY 1) m ON m.category = x.category)"""

RESIDUALS = [
    """res AS (
    SELECT series_id, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY week_start) - 1 AS i,
           COUNT(*) OVER (PARTITION BY series_id) AS n,
           sales_units - AVG(sales_units) OVER (PARTITION BY series_id) AS e
    FROM panel)""",
    """sizes AS (SELECT series_id, MAX(n) AS n, SUM(e * e) AS ss FROM res GROUP BY 1)""",
]


def lag_products(top: int) -> str:
    return f"""products AS (
        SELECT x.series_id, x.i - y.i AS k, SUM(x.e * y.e) AS v
        FROM res x JOIN res y ON y.series_id = x.series_id AND x.i - y.i BETWEEN 1 AND {top}
        GROUP BY 1, 2)"""


KPSS_TAIL = """SELECT z.series_id, l.lags AS kpss_lags,
        z.walk / (z.n * z.n)
          / ((z.ss + COALESCE((SELECT SUM(2 * p.v * (1 - p.k / (l.lags + 1.0))) FROM products p
                WHERE p.series_id = z.series_id AND p.k <= l.lags), 0)) / z.n) AS kpss_stat
    FROM (SELECT c.series_id, MAX(z.n) AS n, MAX(z.ss) AS ss, SUM(c.walk * c.walk) AS walk
          FROM (SELECT series_id, SUM(e) OVER (PARTITION BY series_id ORDER BY i
                  ROWS UNBOUNDED PRECEDING) AS walk FROM res) c
          JOIN sizes z ON z.series_id = c.series_id GROUP BY 1) z
    JOIN lags l ON l.series_id = z.series_id WHERE z.ss > 0"""
KPSS_P = """CASE WHEN kpss_stat <= 0.347 THEN 0.10
    WHEN kpss_stat <= 0.463 THEN 0.10 + (kpss_stat - 0.347) * (0.05 - 0.10) / (0.463 - 0.347)
    WHEN kpss_stat <= 0.574 THEN 0.05 + (kpss_stat - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
    WHEN kpss_stat <= 0.739 THEN 0.025 + (kpss_stat - 0.574) * (0.01 - 0.025) / (0.739 - 0.574)
    ELSE 0.01 END AS kpss_pvalue"""
AUTO_LAGS = """lags AS (
    SELECT series_id, LEAST(CAST(FLOOR(1.1447 * POW(POW(s1 / s0, 2), 1 / 3.0::DOUBLE)
                            * POW(n, 1 / 3.0::DOUBLE)) AS BIGINT), n - 1) AS lags
    FROM (SELECT z.series_id, z.n, z.ss / z.n + SUM(p.v) / (z.n / 2.0) AS s0,
                 SUM(p.k * p.v) / (z.n / 2.0) AS s1
          FROM sizes z JOIN products p ON p.series_id = z.series_id
               AND p.k <= FLOOR(POW(z.n, 2 / 9.0::DOUBLE)) GROUP BY z.series_id, z.n, z.ss))"""


def decompose_sql(extrapolate: bool) -> list[str]:
    ends = (
        """CASE WHEN raw IS NOT NULL THEN raw WHEN i < 26 THEN h0 + h1 * i ELSE t0 + t1 * i END"""
        if extrapolate
        else "raw"
    )
    return [
        """idx AS (
        SELECT *, ROW_NUMBER() OVER ord - 1 AS i, COUNT(*) OVER (PARTITION BY series_id) AS n,
               (SUM(sales_units) OVER (ord ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)
                + 0.5 * (LAG(sales_units, 26) OVER ord + LEAD(sales_units, 26) OVER ord)) / 52 AS raw
        FROM panel WINDOW ord AS (PARTITION BY series_id ORDER BY week_start))""",
        """lines AS (
        SELECT series_id,
               REGR_INTERCEPT(raw, i) FILTER (WHERE i BETWEEN 26 AND 76) AS h0,
               REGR_SLOPE(raw, i) FILTER (WHERE i BETWEEN 26 AND 76) AS h1,
               REGR_INTERCEPT(raw, i) FILTER (WHERE i BETWEEN n - 78 AND n - 28) AS t0,
               REGR_SLOPE(raw, i) FILTER (WHERE i BETWEEN n - 78 AND n - 28) AS t1
        FROM idx GROUP BY 1)""",
        f"""trended AS (
        SELECT idx.*, {ends} AS trend FROM idx JOIN lines ON lines.series_id = idx.series_id
        WHERE n >= 104)""",
        """phases AS (
        SELECT series_id, i % 52 AS phase, AVG(sales_units - trend) AS m FROM trended GROUP BY 1, 2)""",
        """centred AS (
        SELECT series_id, phase, m - AVG(m) OVER (PARTITION BY series_id) AS seasonal FROM phases)""",
    ]


DECOMPOSED = """SELECT t.series_id, t.week_start, t.sales_units, t.trend, c.seasonal,
    t.sales_units - t.trend - c.seasonal AS resid
    FROM trended t JOIN centred c ON c.series_id = t.series_id AND c.phase = t.i % 52"""
DECOMPOSE_SPEC = "series_id week_start sales_units:2 trend:4 seasonal:4 resid:4"


def histogram_sql(values: str, bins: int) -> str:
    return f"""WITH v AS ({values}),
        b AS (SELECT measure, COUNT(*) AS n,
                CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
                CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi
              FROM v GROUP BY 1),
        c AS (SELECT v.measure,
                LEAST(FLOOR((v.value - b.lo) / (b.hi - b.lo) * {bins}) + 1, {bins}) AS bin,
                COUNT(*) AS count FROM v JOIN b ON b.measure = v.measure GROUP BY 1, 2)
        SELECT b.measure, k.bin, b.lo + (k.bin - 1) * ((b.hi - b.lo) / {bins}) AS bin_start,
               b.lo + k.bin * ((b.hi - b.lo) / {bins}) AS bin_end,
               COALESCE(c.count, 0) AS count,
               COALESCE(c.count, 0) / (b.n * ((b.hi - b.lo) / {bins})) AS density
        FROM b CROSS JOIN (SELECT unnest(generate_series(1, {bins})) AS bin) k
        LEFT JOIN c ON c.measure = b.measure AND c.bin = k.bin"""


def histogram_query(ctes: list[str], values: str, bins: int) -> str:
    """The histogram's own WITH is merged into the outer one."""
    body = histogram_sql(values, bins).removeprefix("WITH ")
    return f"WITH {', '.join(ctes)}, {body}"


HIST_SPEC = "measure bin:i bin_start:6 bin_end:6 count:i density:6"


def adf_sql(max_lags: int | None = None) -> list[str]:
    """``adf`` (series_id, adf_stat, adf_pvalue, adf_lags) from one Gram matrix per series: sweeping
    its columns one by one gives every candidate's residual sum of squares, and a second matrix,
    with the level's column last, the statistic of the chosen one."""
    lags = "CAST(least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2{}) AS INTEGER)".format("" if max_lags is None else f", {max_lags}")
    taken = lambda name, first: f"list_transform(range({first} + 1, n), lambda i: {name}[i])"
    lagged = lambda first, upto: f"list_transform(range(1, {upto} + 1), lambda j: list_transform(range({first} + 1, n), lambda i: d[i - j]))"
    gram = "list_transform(cols, lambda a: list_transform(cols, lambda b: list_inner_product(a, b)))"
    swept = """list_transform(g, lambda r: list_transform(range(1, len(g) + 1),
        lambda j: r[CAST(j AS INTEGER)] - r[p + 1] * g[p + 1][CAST(j AS INTEGER)] / g[p + 1][p + 1]))"""
    surface = lambda c: " + ".join(f"{x!r} * pow(adf_stat, {k})" for k, x in enumerate(c))
    # The normal distribution function as its power series.
    normal = """0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 121),
        lambda k: z * exp(2 * k * ln(greatest(abs(z), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"""
    return [
        """ys AS (
        SELECT series_id, n, y, list_transform(y, lambda v: v - list_avg(y)) AS e,
               list_transform(range(1, n), lambda i: y[i + 1] - y[i]) AS d
        FROM (SELECT series_id, CAST(COUNT(*) AS INTEGER) AS n, list(CAST(sales_units AS DOUBLE) ORDER BY week_start) AS y
              FROM panel WHERE sales_units IS NOT NULL GROUP BY 1)
        WHERE n >= 10 AND list_stddev_pop(y) > 0)""",
        f"""candidates AS (
        SELECT series_id, n, top, {gram} AS g FROM (
          SELECT series_id, n, top, list_concat([list_transform(range(top + 1, n), lambda i: CAST(1 AS DOUBLE)), {taken("e", "top")}],
            {lagged("top", "top")}, [{taken("d", "top")}]) AS cols
          FROM (SELECT *, {lags} AS top FROM ys)))""",
        f"""sweeps AS (
        SELECT series_id, n, top, 0 AS p, g FROM candidates
        UNION ALL
        SELECT series_id, n, top, p + 1, {swept} FROM sweeps WHERE p < top + 2)""",
        """chosen AS (
        SELECT series_id, n, p - 2 AS lags FROM sweeps WHERE p >= 2
        QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY
          (n - 1 - top) * ln(greatest(g[top + 3][top + 3], 1e-300) / (n - 1 - top)) + 2 * p, p) = 1)""",
        f"""refits AS (
        SELECT series_id, n, lags, 0 AS p, {gram} AS g FROM (
          SELECT c.series_id, c.n, lags, list_concat([list_transform(range(lags + 1, c.n), lambda i: CAST(1 AS DOUBLE))],
            {lagged("lags", "lags").replace("n)", "c.n)")}, [{taken("e", "lags").replace("n)", "c.n)")}, {taken("d", "lags").replace("n)", "c.n)")}]) AS cols
          FROM chosen c JOIN ys ON ys.series_id = c.series_id)
        UNION ALL
        SELECT series_id, n, lags, p + 1, {swept} FROM refits WHERE p < lags + 1)""",
        f"""adf AS (
        SELECT series_id, adf_stat, lags AS adf_lags,
          CASE WHEN adf_stat > {se.ADF_MAX} THEN 1 WHEN adf_stat < {se.ADF_MIN} THEN 0 ELSE {normal} END AS adf_pvalue
        FROM (SELECT *, CASE WHEN adf_stat <= {se.ADF_SWITCH} THEN {surface(se.ADF_LOW)} ELSE {surface(se.ADF_HIGH)} END AS z
          FROM (SELECT series_id, lags, b / sqrt((tt - b * yt) / (n - 1 - lags - lags - 2) / yy) AS adf_stat
            FROM (SELECT series_id, n, lags, g[lags + 2][lags + 2] AS yy, g[lags + 2][lags + 3] AS yt, g[lags + 3][lags + 3] AS tt,
                    g[lags + 2][lags + 3] / g[lags + 2][lags + 2] AS b
                  FROM refits WHERE p = lags + 1))))""",
    ]


def register(q: Registry) -> None:
    add = q.add
    for level, name in (("p_type", "category"), ("sku", "sku")):
        add(
            f"e1_series_summary_{name}",
            SUMMARY_SPEC,
            lambda sp, d, level=level: a.series_summary(history_table(sp, d, level)),
            s.with_(summary_sql(level), "SELECT * FROM summary"),
        )
    add(
        "e1_series_summary_sparse",
        SUMMARY_SPEC,
        lambda sp, d: a.series_summary(weekly_table(sp, d, "sku")),
        s.with_(
            [s.weekly("sku"), "panel AS (SELECT * FROM weekly)", s.segments(), *SUMMARY_SQL],
            "SELECT * FROM summary",
        ),
    )
    for name, column in {
        "e2_outlier_share": "outlier_share:6",
        "e3_coefficient_of_variation": "coefficient_of_variation:6",
        "e4_trend_strength": "trend_strength:6",
        "e5_grid_coverage": "expected_weeks:i grid_coverage:6 weekly_grid_complete",
    }.items():
        add(
            name,
            f"series_id {column}",
            lambda sp, d: a.series_summary(panel_table(sp, d, "p_brand")),
            s.with_(summary_sql("p_brand"), "SELECT * FROM summary"),
        )

    def profile(sp, d):
        raw = star_raw(sp, d)
        return a.dataset_profile(
            summary_table(sp, d), p.raw_counts(raw.sales, raw.items, raw.stores)
        )

    def share(e: str) -> str:
        return f"AVG(CASE WHEN {e} THEN 1 ELSE 0 END)"

    add(
        "e6_dataset_profile",
        "metric value:6 text",
        profile,
        s.with_(
            summary_sql("sku"),
            """SELECT 'period_start' AS metric, CAST(NULL AS DOUBLE) AS value,
                 CAST(MIN(start_date) AS VARCHAR) AS text FROM summary
               UNION ALL SELECT 'period_end', NULL, CAST(MAX(end_date) AS VARCHAR) FROM summary
               UNION ALL SELECT metric, value, NULL FROM ("""
            + metric_sql(
                [
                    ("number_of_series", "COUNT(*)"),
                    ("number_of_categories", "COUNT(DISTINCT category)"),
                    ("history_weeks_min", "MIN(history_weeks)"),
                    ("history_weeks_median", "QUANTILE_CONT(history_weeks, 0.5)"),
                    ("history_weeks_max", "MAX(history_weeks)"),
                    ("zero_share_mean", "AVG(zero_share)"),
                    ("missing_share_mean", "AVG(missing_share)"),
                    ("outlier_share_mean", "AVG(outlier_share)"),
                    ("mean_cv", "AVG(coefficient_of_variation)"),
                    ("mean_trend_strength", "AVG(trend_strength)"),
                    ("short_history_share", share("short_history")),
                    ("high_zero_share_share", share("high_zero_share")),
                    ("high_variance_share", share("high_variance")),
                    ("problematic_share", share("segment_label = 'problematic'")),
                    ("intermittent_share", share("segment_label = 'intermittent'")),
                    ("weekly_grid_complete_share", share("weekly_grid_complete")),
                ],
                "summary",
            )
            + """ UNION ALL SELECT 'raw_item_count', COUNT(DISTINCT l_partkey) FROM lineitem
               UNION ALL SELECT 'raw_store_count', COUNT(DISTINCT l_suppkey) FROM lineitem
               UNION ALL SELECT 'raw_daily_observations',
                 COUNT(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem
               UNION ALL SELECT 'raw_state_count', COUNT(DISTINCT s_nationkey) FROM supplier
               UNION ALL SELECT 'raw_department_count', COUNT(DISTINCT p_brand) FROM part)""",
        ),
    )
    add(
        "e7_frequency_comparison",
        """frequency period_count:i period_start period_end mean_sales_units:4 std_sales_units:4
           coefficient_of_variation:6 first_order_autocorr:6""",
        lambda sp, d: a.frequency_comparison(
            panel_table(sp, d), p.daily_total(star_raw(sp, d).sales)
        ),
        s.with_(
            [
                *s.panel(),
                """totals AS (
                SELECT 'weekly' AS frequency, week_start AS t, SUM(sales_units) AS y
                FROM panel GROUP BY 2
                UNION ALL SELECT 'monthly', CAST(date_trunc('month', week_start) AS DATE),
                  SUM(sales_units) FROM panel GROUP BY 2
                UNION ALL SELECT 'daily', CAST(l_shipdate AS DATE), SUM(l_quantity)
                FROM lineitem GROUP BY 2)""",
            ],
            """SELECT frequency, COUNT(*) AS period_count, MIN(t) AS period_start,
                 MAX(t) AS period_end, AVG(y) AS mean_sales_units,
                 STDDEV_POP(y) AS std_sales_units,
                 STDDEV_POP(y) / AVG(y) AS coefficient_of_variation,
                 CORR(y, before) AS first_order_autocorr
               FROM (SELECT *, LAG(y) OVER (PARTITION BY frequency ORDER BY t) AS before
                     FROM totals) GROUP BY 1""",
        ),
    )

    def categories(sp, d):
        sparse = weekly_table(sp, d, "sku")
        counts = p.items_per_category(star_raw(sp, d).items)
        return a.category_summary(p.densify(sparse), a.series_summary(p.dense_histories(sparse)), counts)

    add(
        "e8_category_summary",
        """category number_of_series:i total_sales_units:2 mean_weekly_sales:6
           median_weekly_sales:4 mean_zero_share:6 mean_outlier_share:6 item_count:i""",
        categories,
        s.with_(
            summary_sql("sku"),
            """SELECT x.*, y.number_of_series, y.mean_zero_share, y.mean_outlier_share, z.item_count
               FROM (SELECT category, SUM(sales_units) AS total_sales_units,
                       AVG(sales_units) AS mean_weekly_sales,
                       QUANTILE_CONT(sales_units, 0.5) AS median_weekly_sales
                     FROM panel GROUP BY 1) x
               JOIN (SELECT category, COUNT(*) AS number_of_series,
                       AVG(zero_share) AS mean_zero_share,
                       AVG(outlier_share) AS mean_outlier_share
                     FROM summary GROUP BY 1) y ON y.category = x.category
               JOIN (SELECT p_type AS category, COUNT(*) AS item_count FROM part GROUP BY 1) z
                 ON z.category = x.category""",
        ),
    )
    add(
        "e9_sku_ranking",
        """sales_rank:i series_id category segment_label total_sales_units:2 sales_share:8
           cumulative_sales_share:8 mean_sales_units:4 median_sales_units:4 zero_share:6
           outlier_share:6 coefficient_of_variation:6 trend_strength:6""",
        lambda sp, d: a.sku_ranking(summary_table(sp, d)),
        s.with_([*summary_sql("sku"), RANKED], "SELECT * FROM ranked"),
    )
    add(
        "e10_category_correlation",
        "category_a category_b correlation:6",
        lambda sp, d: a.correlation(a.category_weekly(panel_table(sp, d, "sku"))),
        s.with_([*s.panel("sku"), CATEGORY_WEEKLY], correlation_sql("cw")),
    )
    add(
        "e11_growth_correlation",
        "category_a category_b correlation:6",
        lambda sp, d: a.correlation(a.log_growth(a.category_weekly(panel_table(sp, d, "p_brand")))),
        s.with_(
            [
                *s.panel("p_brand"),
                CATEGORY_WEEKLY,
                """growth AS (
                SELECT category, week_start, LN(1 + value) - LAG(LN(1 + value)) OVER (
                  PARTITION BY category ORDER BY week_start) AS value FROM cw)""",
            ],
            correlation_sql("growth"),
        ),
    )
    for level, name in (("p_brand", "brand"), ("sku", "sku")):
        add(
            f"e12_autocorrelation_{name}",
            ACF_SPEC,
            lambda sp, d, level=level: a.autocorrelations(history_table(sp, d, level)),
            s.with_([*s.panel(level), *acf_sql()], "SELECT * FROM acf"),
        )
    add(
        "e13_acf",
        "series_id lag:i acf:6",
        lambda sp, d: se.acf(panel_table(sp, d, "p_brand")),
        s.with_(
            [*s.panel("p_brand"), *RESIDUALS, lag_products(24)],
            """SELECT p.series_id, p.k AS lag, p.v / z.ss AS acf
               FROM products p JOIN sizes z ON z.series_id = p.series_id
               UNION ALL SELECT series_id, 0, 1 FROM sizes""",
        ),
    )
    add(
        "e13_pacf",
        "series_id lag:i pacf:6",
        lambda sp, d: se.pacf(panel_table(sp, d, "p_brand")),
        s.with_(
            [
                *s.panel("p_brand"),
                *RESIDUALS,
                lag_products(24),
                """r AS (SELECT series_id, LIST(rho ORDER BY k) AS r FROM (
                    SELECT p.series_id, p.k, p.v / z.ss AS rho
                    FROM products p JOIN sizes z ON z.series_id = p.series_id) GROUP BY 1)""",
                """dl AS (
                SELECT series_id, 1 AS k, r[1] AS pacf, [r[1]] AS phi, r FROM r
                UNION ALL
                SELECT series_id, k + 1, refl,
                  list_append(list_transform(generate_series(1, k),
                    lambda j: phi[j] - refl * phi[k + 1 - j]), refl), r
                FROM (SELECT *, (r[k + 1] - list_sum(list_transform(generate_series(1, k),
                          lambda j: phi[j] * r[k + 1 - j])))
                        / (1 - list_sum(list_transform(generate_series(1, k),
                          lambda j: phi[j] * r[j]))) AS refl FROM dl WHERE k < 24))""",
            ],
            """SELECT series_id, k AS lag, pacf FROM dl
               UNION ALL SELECT series_id, 0, 1 FROM sizes""",
            recursive=True,
        ),
    )
    add(
        "e14_seasonal_index",
        """category week_of_year:i mean_sales_units:4 category_mean_sales_units:4
           seasonal_index:6""",
        lambda sp, d: a.seasonal_index(panel_table(sp, d)),
        s.with_([*s.panel(), SEASONAL_INDEX], "SELECT * FROM seasonal"),
    )
    tops = " UNION ALL ".join(
        f"""SELECT 'top_{k}_sales_share', SUM(total_sales_units) / MAX(grand) FROM
            (SELECT *, SUM(total_sales_units) OVER () AS grand, COUNT(*) OVER () AS n,
               ROW_NUMBER() OVER (ORDER BY total_sales_units DESC, series_id) AS r FROM totals)
            WHERE r <= {k} AND n >= {k} HAVING COUNT(*) > 0"""
        for k in a.TOP_LIMITS
    )
    add(
        "e15_concentration",
        "metric value:6",
        lambda sp, d: a.concentration(panel_table(sp, d, "sku")),
        s.with_(
            [
                *s.panel("sku"),
                """totals AS (
                SELECT series_id, SUM(sales_units) AS total_sales_units FROM panel GROUP BY 1)""",
                """facts AS (
                SELECT COUNT(*) AS n, SUM(sh * sh) AS hhi, SUM(r * sh) AS ranked FROM (
                  SELECT total_sales_units / SUM(total_sales_units) OVER () AS sh,
                    ROW_NUMBER() OVER (ORDER BY total_sales_units) AS r FROM totals))""",
            ],
            metric_sql(
                [
                    ("sku_count", "n"),
                    ("effective_sku_count_inverse_hhi", "1 / hhi"),
                    ("hhi_sales_concentration", "hhi"),
                    ("gini_sales_concentration", "2 * ranked / n - (n + 1) / n::DOUBLE"),
                ],
                "facts",
            )
            + " UNION ALL "
            + tops,
        ),
    )
    add(
        "e16_share_stability",
        """series_id category total_sales_units:2 mean_weekly_share:6 std_weekly_share:6
           min_weekly_share:6 max_weekly_share:6 zero_share:6 share_cv:6""",
        lambda sp, d: a.share_stability(panel_table(sp, d, "sku")),
        s.with_(
            [
                *s.panel("sku"),
                """chosen AS (SELECT series_id FROM panel GROUP BY 1
                   ORDER BY SUM(sales_units) DESC, series_id LIMIT 50)""",
                """shares AS (
                SELECT *, sales_units / NULLIF(SUM(sales_units) OVER (
                    PARTITION BY week_start, category), 0) AS sh
                FROM panel WHERE series_id IN (SELECT series_id FROM chosen))""",
            ],
            """SELECT series_id, category, SUM(sales_units) AS total_sales_units,
                 AVG(sh) AS mean_weekly_share, STDDEV_POP(sh) AS std_weekly_share,
                 MIN(sh) AS min_weekly_share, MAX(sh) AS max_weekly_share,
                 AVG(CASE WHEN sales_units = 0 THEN 1 ELSE 0 END) AS zero_share,
                 STDDEV_POP(sh) / NULLIF(AVG(sh), 0) AS share_cv
               FROM shares GROUP BY 1, 2""",
        ),
    )

    def diagnostics(sp, d):
        histories = cut_lineage(history_table(sp, d, "sku").drop("runs"))
        return a.diagnostic_summary(a.series_summary(histories), a.autocorrelations(histories))

    add(
        "e17_diagnostic_summary",
        "diagnostic value:6",
        diagnostics,
        s.with_(
            [*summary_sql("sku"), *acf_sql()],
            metric_sql(
                [
                    ("mean_history_weeks", "AVG(history_weeks)"),
                    ("mean_zero_share", "AVG(zero_share)"),
                    ("mean_cv", "AVG(coefficient_of_variation)"),
                    ("mean_trend_strength", "AVG(trend_strength)"),
                ],
                "summary",
                "diagnostic",
            )
            + " UNION ALL "
            + metric_sql(
                [
                    ("seasonal_acf_lag_52_mean", "AVG(acf_lag_52)"),
                    ("seasonal_acf_lag_13_mean", "AVG(acf_lag_13)"),
                    ("seasonal_acf_lag_26_mean", "AVG(acf_lag_26)"),
                    (
                        "strong_seasonality_share_lag_52",
                        "AVG(CASE WHEN acf_lag_52 >= 0.30 THEN 1 ELSE 0 END)",
                    ),
                ],
                "acf",
                "diagnostic",
            ),
        ),
    )
    kpss_spec = "series_id kpss_lags:i kpss_stat:6 kpss_pvalue:6"
    add(
        "e18_kpss_fixed_lags",
        kpss_spec,
        lambda sp, d: se.kpss(panel_table(sp, d, "p_brand"), lags=8),
        s.with_(
            [
                *s.panel("p_brand"),
                *RESIDUALS,
                lag_products(8),
                "lags AS (SELECT series_id, 8 AS lags FROM sizes)",
                f"stat AS ({KPSS_TAIL})",
            ],
            f"SELECT *, {KPSS_P} FROM stat",
        ),
    )
    add(
        "e18_kpss_auto_lags",
        kpss_spec,
        lambda sp, d: se.kpss(panel_table(sp, d, "p_brand")),
        s.with_(
            [
                *s.panel("p_brand"),
                *RESIDUALS,
                lag_products(60),
                AUTO_LAGS,
                f"stat AS ({KPSS_TAIL})",
            ],
            f"SELECT *, {KPSS_P} FROM stat",
        ),
    )
    add(
        "e19_adf_no_lags",
        "series_id adf_stat:6",
        lambda sp, d: se.adf_no_lags(history_table(sp, d, "sku")),
        s.with_(
            [
                *s.panel("sku"),
                """pairs AS (
                SELECT series_id, before AS x, sales_units - before AS dy FROM (
                  SELECT *, LAG(sales_units) OVER (PARTITION BY series_id ORDER BY week_start)
                    AS before FROM panel) WHERE before IS NOT NULL)""",
            ],
            """SELECT series_id, REGR_SLOPE(dy, x) / NULLIF(SQRT(
                 (REGR_SYY(dy, x) - REGR_SLOPE(dy, x) * REGR_SXY(dy, x)) / (COUNT(*) - 2)
                 / NULLIF(REGR_SXX(dy, x), 0)), 0) AS adf_stat
               FROM pairs GROUP BY 1 HAVING COUNT(*) >= 9""",
        ),
    )
    for name, level, most in (("e19_adf_aic_lags", "sku", None), ("e19_adf_one_lag", "p_brand", 1)):
        add(
            name,
            "series_id adf_stat:6 adf_pvalue:6 adf_lags:i",
            lambda sp, d, level=level, most=most: se.adf(history_table(sp, d, level), max_lags=most),
            s.with_(
                [*s.panel(level), *adf_sql(most)],
                "SELECT x.series_id, adf_stat, adf_pvalue, adf_lags FROM (SELECT DISTINCT series_id FROM panel) x LEFT JOIN adf ON adf.series_id = x.series_id",
                recursive=True,
            ),
        )
    add(
        "e20_stationarity",
        "series_id adf_stat:6 adf_pvalue:6 kpss_stat:6 kpss_pvalue:6 stationarity_hint",
        lambda sp, d: se.stationarity(panel_table(sp, d, "p_brand")),
        s.with_(
            [
                *s.panel("p_brand"),
                *RESIDUALS,
                lag_products(60),
                AUTO_LAGS,
                f"stat AS ({KPSS_TAIL})",
                f"kpss AS (SELECT *, {KPSS_P} FROM stat)",
                *adf_sql(),
            ],
            f"""SELECT k.series_id, adf_stat, adf_pvalue, kpss_stat, kpss_pvalue,
                  CASE WHEN adf_pvalue IS NULL OR kpss_pvalue IS NULL THEN 'inconclusive'
                       WHEN adf_pvalue < {se.SIGNIFICANCE} AND kpss_pvalue > {se.SIGNIFICANCE} THEN 'likely_stationary'
                       WHEN adf_pvalue >= {se.SIGNIFICANCE} AND kpss_pvalue <= {se.SIGNIFICANCE} THEN 'likely_non_stationary'
                       ELSE 'mixed_signal' END AS stationarity_hint
                FROM kpss k LEFT JOIN adf ON adf.series_id = k.series_id""",
            recursive=True,
        ),
    )
    for name, extend in (("extended", True), ("open_ends", False)):
        add(
            f"e21_decomposition_{name}",
            DECOMPOSE_SPEC,
            lambda sp, d, extend=extend: se.decompose(panel_table(sp, d, "p_brand"), extend),
            s.with_([*s.panel("p_brand"), *decompose_sql(extend)], DECOMPOSED),
        )

    # Chart tables.
    add(
        "v1_target_histogram",
        HIST_SPEC,
        lambda sp, d: c.target_histogram(panel_table(sp, d, "sku")),
        histogram_query(
            s.panel("sku"),
            """SELECT 'raw' AS measure, sales_units AS value FROM panel
               UNION ALL SELECT 'log1p', LN(1 + sales_units) FROM panel""",
            25,
        ),
    )
    add(
        "v2_summary_histograms",
        HIST_SPEC,
        lambda sp, d: c.summary_histograms(summary_table(sp, d)),
        histogram_query(
            summary_sql("sku"),
            " UNION ALL ".join(
                f"SELECT '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM summary"
                for m in c.SUMMARY_MEASURES
            ),
            25,
        ),
    )
    add(
        "v3_segment_counts",
        "segment_label series_count:i",
        lambda sp, d: c.segment_counts(segment_series(weekly_table(sp, d, "sku"))),
        s.with_(
            [s.weekly("sku"), s.segments("weekly")],
            "SELECT segment_label, COUNT(*) AS series_count FROM segments GROUP BY 1",
        ),
    )
    add(
        "v3_series_by_category",
        "category number_of_series:i",
        lambda sp, d: c.series_by_category(weekly_table(sp, d, "sku")),
        s.with_(
            [s.weekly("sku")],
            """SELECT category, COUNT(DISTINCT series_id) AS number_of_series
               FROM weekly GROUP BY 1""",
        ),
    )
    add(
        "v4_category_totals",
        "category sales_units:2",
        lambda sp, d: c.category_totals(panel_table(sp, d)),
        s.with_(
            s.panel(), "SELECT category, SUM(sales_units) AS sales_units FROM panel GROUP BY 1"
        ),
    )
    add(
        "v5_normalised_categories",
        "category week_start sales_units:2 normalised:6",
        lambda sp, d: c.normalised_categories(panel_table(sp, d, "sku")),
        s.with_(
            [*s.panel("sku"), CATEGORY_WEEKLY],
            """SELECT category, week_start, value AS sales_units,
                 value / AVG(value) OVER (PARTITION BY category) AS normalised FROM cw""",
        ),
    )
    add(
        "v5_normalised_top_series",
        "series_id week_start normalised:6",
        lambda sp, d: c.normalised_top_series(panel_table(sp, d, "sku")),
        s.with_(
            s.panel("sku"),
            """SELECT series_id, week_start,
                 sales_units / AVG(sales_units) OVER (PARTITION BY series_id) AS normalised
               FROM panel WHERE series_id IN (
                 SELECT series_id FROM panel GROUP BY 1
                 ORDER BY SUM(sales_units) DESC, AVG(sales_units) DESC, series_id LIMIT 8)""",
        ),
    )
    add(
        "v6_seasonal_heatmap",
        "category " + " ".join(f"week_{n}:6" for n in range(1, 54)),
        lambda sp, d: c.seasonal_heatmap(a.seasonal_index(panel_table(sp, d))),
        s.with_(
            [*s.panel(), SEASONAL_INDEX],
            "SELECT category, "
            + ", ".join(
                f"MAX(CASE WHEN week_of_year = {n} THEN seasonal_index END) AS week_{n}"
                for n in range(1, 54)
            )
            + " FROM seasonal GROUP BY 1",
        ),
    )
    add(
        "v7_acf_profile",
        "lag:i mean_acf:6",
        lambda sp, d: c.acf_profile(a.autocorrelations(history_table(sp, d, "sku"))),
        s.with_(
            [*s.panel("sku"), *acf_sql()],
            " UNION ALL ".join(
                f"SELECT {k} AS lag, AVG(acf_lag_{k}) AS mean_acf FROM acf" for k in a.ACF_LAGS
            ),
        ),
    )
    add(
        "v8_top_skus",
        "series_id category total_sales_units:2",
        lambda sp, d: c.top_skus(a.series_summary(history_table(sp, d, "sku"))),
        s.with_(
            [*summary_sql("sku"), RANKED], "SELECT * FROM ranked WHERE sales_rank <= 20"
        ),
    )
    add(
        "v8_cumulative_share",
        "sales_rank:i series_id cumulative_sales_share:8",
        lambda sp, d: c.cumulative_share(summary_table(sp, d)),
        s.with_(
            [*summary_sql("sku"), RANKED], "SELECT * FROM ranked WHERE sales_rank <= 200"
        ),
    )
    schematic = w.Backtest(1, 3, 60, 4, 2)
    add(
        "v9_first_windows",
        "forecast_origin train_end test_start horizon:i",
        lambda sp, d: c.first_windows(w.rolling_windows(panel_table(sp, d), schematic)),
        s.with_(
            [*s.panel(), *s.windows(1, 3, 60, 4, 2)],
            "SELECT * FROM windows ORDER BY forecast_origin, horizon LIMIT 6",
        ),
    )

    def leader_errors(sp, d):
        table = baseline_table(sp, d)
        return c.error_histogram(ev.leader_predictions(table, ev.overall(table)))

    add(
        "v12_error_histogram",
        HIST_SPEC,
        leader_errors,
        histogram_query(
            [
                *s.predictions(),
                """leader AS (
                SELECT model_name FROM predictions GROUP BY 1
                ORDER BY SUM(ABS(prediction - actual)) / SUM(ABS(actual)), model_name LIMIT 1)""",
            ],
            """SELECT 'abs_error' AS measure, ABS(actual - prediction) AS value
               FROM predictions WHERE model_name IN (SELECT model_name FROM leader)""",
            20,
        ),
    )
    add(
        "c14_example_overlay",
        "series_id category week_start sales_units:2 lag_52:2 rolling_10:4",
        lambda sp, d: _overlay(sp, d),
        s.with_(
            [
                *s.panel("sku"),
                """chosen AS (
                SELECT series_id FROM (
                  SELECT *, ROW_NUMBER() OVER (
                    PARTITION BY category ORDER BY total DESC, series_id) AS n
                  FROM (SELECT category, series_id, SUM(sales_units) AS total
                        FROM panel GROUP BY 1, 2)) WHERE n = 1)""",
            ],
            """SELECT series_id, category, week_start, sales_units,
                 LAG(sales_units, 52) OVER ord AS lag_52,
                 AVG(sales_units) OVER (ord ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_10
               FROM panel WHERE series_id IN (SELECT series_id FROM chosen)
               WINDOW ord AS (PARTITION BY series_id ORDER BY week_start)""",
        ),
    )


def _overlay(sp, d):
    panel = panel_table(sp, d, "sku")
    return c.example_overlay(panel, example_series(panel))
