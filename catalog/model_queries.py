"""Forecasters: baselines, Holt, ridge, boosted trees."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import sqlbase as s
from catalog.registry import Registry
from catalog.tables import (
    baseline_rows,
    baseline_table,
    panel_table,
    scenario_table,
    setup,
    weekly_table,
)
from weekcast.operators import baselines as b
from weekcast.operators import evaluate as ev
from weekcast.operators import features as f
from weekcast.operators import holt as h
from weekcast.operators import ridge as r
from weekcast.operators import scenarios as sc
from weekcast.operators import trees as t
from weekcast.operators import windows as w
from weekcast.operators.panel import densify
from weekcast.operators.segments import segment_series
from weekcast.plans.predict import score_baselines, score_ridge
from weekcast.plans.experiment import Experiment, backtest
from weekcast.plans.winner import forecast_saved, save_final
from weekcast.session import cut_lineage, shared_folder
from weekcast.sources.sinks import complete_runs, read_run, write_table, write_tables

PREDICTION_SPEC = """model_name model_family series_id category segment_label forecast_origin
    target_date horizon:i actual:2 prediction:4"""
NAMES = f.feature_names(["series_id"], f.Features())
# Few and shallow trees, the same for both losses: settings of the models, stated here openly.
FEW_TREES = {"maxIter": 8, "stepSize": 0.3, "maxDepth": 3, "maxBins": 16}
ALL_MODELS = {**Experiment().models, "gbt_squared": FEW_TREES, "gbt_absolute": FEW_TREES}


def supervised_table(sp, d, level="p_brand") -> DataFrame:
    """Written once: the models read it several times."""
    panel = cut_lineage(panel_table(sp, d, level))
    return cut_lineage(f.supervised(panel, segment_series(panel)))


def only(model: str, alignment: str):
    def query(sp, d):
        x = setup(sp, d, "p_brand")
        return b.baselines(x.panel, x.segments, x.windows, [model], alignment=alignment)

    return query


def holt_sql(alignment: str) -> list[str]:
    """The smoothing recursion over weeks for every grid point, then the best per week."""
    state, steps = ("w.forecast_origin", "w.horizon")
    if alignment == "reference":
        state = "w.train_end"
    return [
        """grid AS (
        SELECT a.k AS a, b.k AS b, CAST(a.k AS DOUBLE) / 10 AS alpha, CAST(b.k AS DOUBLE) / 10 AS beta
        FROM (SELECT unnest(generate_series(1, 10)) AS k) a
        CROSS JOIN (SELECT unnest(generate_series(0, 8)) AS k) b)""",
        """idx AS (
        SELECT series_id, week_start, CAST(sales_units AS DOUBLE) AS y,
               ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY week_start) - 1 AS i FROM panel)""",
        """smooth AS (
        SELECT series_id, i, a, b, alpha, beta, y AS level, CAST(0 AS DOUBLE) AS trend,
               CAST(0 AS DOUBLE) AS sse FROM idx CROSS JOIN grid WHERE i = 0
        UNION ALL
        SELECT h.series_id, x.i, h.a, h.b, h.alpha, h.beta,
               (h.level + h.trend) + h.alpha * (x.y - (h.level + h.trend)),
               h.trend + (h.alpha * h.beta) * (x.y - (h.level + h.trend)),
               h.sse + (x.y - (h.level + h.trend)) * (x.y - (h.level + h.trend))
        FROM smooth h JOIN idx x ON x.series_id = h.series_id AND x.i = h.i + 1)""",
        """states AS (
        SELECT x.series_id, x.week_start,
               CASE WHEN x.i < 7 THEN x.y ELSE z.level END AS level,
               CASE WHEN x.i < 7 THEN 0 ELSE z.trend END AS trend
        FROM idx x JOIN (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, i ORDER BY sse, a, b) AS n
          FROM smooth) z ON z.series_id = x.series_id AND z.i = x.i AND z.n = 1)""",
        f"""predictions AS (
        SELECT 'ets' AS model_name, 'statistical' AS model_family, x.series_id, p.category,
               g.segment_label, w.forecast_origin, w.test_start AS target_date, w.horizon,
               p.sales_units AS actual, x.level + {steps} * x.trend AS prediction
        FROM windows w JOIN states x ON x.week_start = {state}
        JOIN panel p ON p.series_id = x.series_id AND p.week_start = w.test_start
        LEFT JOIN segments g ON g.series_id = x.series_id)""",
    ]


SEASONAL = (0.3, 0.1, 0.2, 0.95)


def seasonal_sql() -> list[str]:
    """The recursion over weeks with the coming 52 seasonal numbers as a list."""
    alpha, beta, gamma, phi = SEASONAL
    error = f"(x.y - (h.level + {phi} * h.trend) - h.season[1])"
    return [
        """idx AS (
        SELECT series_id, week_start, CAST(sales_units AS DOUBLE) AS y,
               ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY week_start) - 1 AS i FROM panel)""",
        f"""season AS (
        SELECT series_id, CAST(51 AS BIGINT) AS i, AVG(y) AS level, CAST(0 AS DOUBLE) AS trend,
               list_transform(list(y ORDER BY i), lambda v: v - list_avg(list(y ORDER BY i))) AS season
        FROM idx WHERE i < 52 GROUP BY 1
        UNION ALL
        SELECT h.series_id, x.i, h.level + {phi} * h.trend + {alpha} * {error},
               {phi} * h.trend + {alpha * beta!r} * {error},
               list_append(h.season[2:], h.season[1] + {gamma * (1 - alpha)!r} * {error})
        FROM season h JOIN idx x ON x.series_id = h.series_id AND x.i = h.i + 1)""",
        f"""steps AS (
        SELECT horizon, list_sum(list_transform(range(1, horizon + 1), lambda k: pow({phi}, k))) AS damped
        FROM (SELECT unnest(generate_series(1, 8)) AS horizon))""",
        """predictions AS (
        SELECT 'ets' AS model_name, 'statistical' AS model_family, x.series_id, p.category,
               g.segment_label, w.forecast_origin, w.test_start AS target_date, w.horizon,
               p.sales_units AS actual, z.level + d.damped * z.trend + z.season[CAST(w.horizon AS INTEGER)] AS prediction
        FROM windows w JOIN idx x ON x.week_start = w.forecast_origin
        JOIN season z ON z.series_id = x.series_id AND z.i = x.i
        JOIN steps d ON d.horizon = w.horizon
        JOIN panel p ON p.series_id = x.series_id AND p.week_start = w.test_start
        LEFT JOIN segments g ON g.series_id = x.series_id)""",
    ]


TWO = ["lag_1", "lag_52"]


def two_feature_sql() -> list[str]:
    """Ridge on two lags, alpha 1, in closed form: running sums over weeks, then a 2 x 2
    system per horizon and last training week. ``coef`` has it by train_end."""
    sums = {
        "n": "1", "s1": "x1", "s2": "x2", "sy": "y", "s11": "x1 * x1", "s12": "x1 * x2",
        "s22": "x2 * x2", "s1y": "x1 * y", "s2y": "x2 * y",
    }
    weekly = ", ".join(f"SUM(CAST({e} AS DOUBLE)) AS {c}" for c, e in sums.items())
    running = ", ".join(f"SUM({c}) OVER upto AS {c}" for c in sums)
    return [
        s.features([s.lag_sql(1), s.lag_sql(52)], name="two"),
        """two_rows AS (
        SELECT f.week_start, h.horizon, f.lag_1 AS x1, f.lag_52 AS x2, a.sales_units AS y
        FROM two f CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS horizon) h
        JOIN panel a ON a.series_id = f.series_id AND a.week_start = f.week_start + INTERVAL 7 DAY * h.horizon
        WHERE f.lag_52 IS NOT NULL)""",
        f"two_weeks AS (SELECT horizon, week_start, {weekly} FROM two_rows GROUP BY 1, 2)",
        f"""two_sums AS (SELECT horizon, week_start AS train_end, {running} FROM two_weeks
        WINDOW upto AS (PARTITION BY horizon ORDER BY week_start))""",
        """two_moments AS (
        SELECT horizon, train_end, n, s1 / n AS m1, s2 / n AS m2, sy / n AS my,
               SQRT(s11 / n - (s1 / n) * (s1 / n)) AS d1, SQRT(s22 / n - (s2 / n) * (s2 / n)) AS d2,
               s12 - s1 * s2 / n AS c12, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y
        FROM two_sums)""",
        """two_solved AS (
        SELECT *, ((n + 1) * c1y / d1 - c12 / (d1 * d2) * c2y / d2)
                 / ((n + 1) * (n + 1) - (c12 / (d1 * d2)) * (c12 / (d1 * d2))) / d1 AS b1,
               ((n + 1) * c2y / d2 - c12 / (d1 * d2) * c1y / d1)
                 / ((n + 1) * (n + 1) - (c12 / (d1 * d2)) * (c12 / (d1 * d2))) / d2 AS b2
        FROM two_moments)""",
        "coef AS (SELECT horizon, train_end, b1, b2, my - b1 * m1 - b2 * m2 AS intercept FROM two_solved)",
        # All rows with a known target: those up to so many weeks before the last one.
        """final AS (
        SELECT c.* FROM coef c, (SELECT MAX(week_start) AS last FROM panel)
        WHERE c.train_end = last - INTERVAL 7 DAY * c.horizon)""",
    ]


LAST_WEEK_KEYS = """model_name model_family series_id category segment_label forecast_origin
    target_date horizon:i"""


def last_week_sql(model: str) -> str:
    """What a final model forecasts: every series of the last week, at every horizon. Lags of
    a year are known there for each of them, as the panel is dense and older than that."""
    return f"""SELECT '{model}' AS model_name, 'ml' AS model_family, p.series_id, p.category,
          g.segment_label, p.week_start AS forecast_origin,
          CAST(p.week_start + INTERVAL 7 DAY * h.horizon AS DATE) AS target_date, h.horizon
        FROM panel p JOIN segments g ON g.series_id = p.series_id
        CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS horizon) h
        WHERE p.week_start = (SELECT MAX(week_start) FROM panel)"""


LAST_WEEK = [*s.panel(), s.segments()]


def register(q: Registry) -> None:
    add = q.add
    for name, model, alignment in (
        ("g1_naive", "naive", "reference"),
        ("g1_naive_aligned", "naive", "target"),
        ("g2_seasonal_naive", "seasonal_naive", "reference"),
        ("g2_seasonal_naive_aligned", "seasonal_naive", "target"),
    ):
        add(
            name,
            PREDICTION_SPEC,
            only(model, alignment),
            s.with_(
                s.predictions("p_brand", alignment),
                f"SELECT * FROM predictions WHERE model_name = '{model}'",
            ),
        )
    add(
        "g2b_demo_forecast",
        """scenario_name series_id category model_name forecast_origin target_date horizon:i
           actual:2 prediction:3""",
        lambda sp, d: b.demo_forecast(scenario_table(sp, d), 8),
        s.with_(
            s.scenario_panel(),
            """SELECT f.scenario_name, f.series_id, f.category, 'seasonal_naive' AS model_name,
                 o.origin AS forecast_origin, f.week_start AS target_date,
                 date_diff('day', o.origin, f.week_start) // 7 AS horizon,
                 f.sales_units AS actual,
                 GREATEST(CASE WHEN o.n >= 52 THEN y.sales_units ELSE l.sales_units END, 0)
                   AS prediction
               FROM scenarios f
               JOIN (SELECT scenario_name, series_id, MAX(week_start) AS origin, COUNT(*) AS n
                     FROM scenarios WHERE is_history GROUP BY 1, 2) o
                 ON o.scenario_name = f.scenario_name AND o.series_id = f.series_id
               JOIN scenarios l ON l.scenario_name = f.scenario_name
                 AND l.series_id = f.series_id AND l.week_start = o.origin
               JOIN scenarios y ON y.scenario_name = f.scenario_name
                 AND y.series_id = f.series_id AND y.week_start = f.week_start - INTERVAL 364 DAY
               WHERE NOT f.is_history""",
        ),
    )

    def smoothed(alignment):
        def query(sp, d):
            x = setup(sp, d)
            return h.holt(x.panel, x.segments, x.windows, alignment=alignment)

        return query

    for name, alignment in (("g3_holt", "target"), ("g3_holt_unaligned", "reference")):
        add(
            name,
            PREDICTION_SPEC,
            smoothed(alignment),
            s.with_(
                [*s.panel(), s.segments(), *s.windows(), *holt_sql(alignment)],
                "SELECT * FROM predictions",
                recursive=True,
            ),
        )

    def seasonal(weights):
        def query(sp, d):
            x = setup(sp, d)
            return h.holt(x.panel, x.segments, x.windows, seasonal="add", weights=weights)

        return query

    add(
        "g3_seasonal",
        PREDICTION_SPEC,
        seasonal(SEASONAL),
        s.with_([*s.panel(), s.segments(), *s.windows(), *seasonal_sql()], "SELECT * FROM predictions", recursive=True),
    )
    add("g3_seasonal_fitted", PREDICTION_SPEC, seasonal(None))

    def ridge(sp, d):
        table = supervised_table(sp, d)
        return r.ridge(table, w.rolling_windows(table), NAMES)

    def two_ridge(sp, d):
        table = supervised_table(sp, d)
        return r.ridge(table, w.rolling_windows(table), TWO)

    add("g4_ridge", PREDICTION_SPEC, ridge)

    def forest(model):
        def query(sp, d):
            table = supervised_table(sp, d, "p_type")
            folder = f"{shared_folder(sp)}/models/{uuid.uuid4().hex}"
            # Ten small trees each: settings of the model, which the query states openly.
            saved = t.fit_trees(table, NAMES, s.HORIZONS, model, folder, maxIter=10, maxDepth=4)
            return t.score_trees(table, NAMES, model, saved)

        return query

    for name, model in (
        ("g5_boosted_trees_squared", "gbt_squared"),
        ("g6_boosted_trees_absolute", "gbt_absolute"),
    ):
        add(name, LAST_WEEK_KEYS, forest(model), s.with_(LAST_WEEK, last_week_sql(model)))
    add(
        "g7_incomplete_predictions",
        PREDICTION_SPEC,
        lambda sp, d: b.incomplete_predictions(baseline_table(sp, d, "p_brand")),
        s.with_(
            s.predictions("p_brand"),
            "SELECT * FROM predictions WHERE actual IS NULL OR prediction IS NULL",
        ),
    )
    add(
        "g7_backtest_all_models",
        f"model_name {s.METRIC_SPEC}",
        lambda sp, d: ev.overall(backtest(cut_lineage(panel_table(sp, d)), Experiment(models=ALL_MODELS))),
    )

    def written(sp, d):
        path = write_table(
            baseline_rows(sp, d),
            f"{shared_folder(sp)}/tables",
            uuid.uuid4().hex,
            "predictions",
            ["model_name"],
        )
        table = sp.read.parquet(path).where("model_name = 'naive'")
        return table.groupBy("horizon").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("prediction").alias("predicted")
        )

    add(
        "a4_partitioned_table",
        "horizon:i rows:i predicted:2",
        written,
        s.with_(
            s.predictions(),
            """SELECT horizon, COUNT(*) AS rows, SUM(prediction) AS predicted
               FROM predictions WHERE model_name = 'naive' GROUP BY 1""",
        ),
    )
    def reruns(sp, d):
        """Two runs side by side, and a third write into the first run, which must fail."""
        root, table = f"{shared_folder(sp)}/tables/{uuid.uuid4().hex}", weekly_table(sp, d)
        paths = [write_table(table, root, run, "weekly") for run in ("first", "second")]
        try:
            write_table(table.limit(0), root, "first", "weekly")
            refused = False
        except AnalysisException:
            refused = True
        runs = [
            sp.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.sum("sales_units").alias("units"))
            .select(F.lit(run).alias("run"), "rows", "units", F.lit(refused).alias("second_write_refused"))
            for run, path in zip(("first", "second"), paths)
        ]
        return runs[0].unionByName(runs[1])

    add(
        "a5_reruns_stay_apart",
        "run rows:i units:2 second_write_refused",
        reruns,
        s.with_(
            [s.weekly()],
            """SELECT run, COUNT(*) AS rows, SUM(sales_units) AS units, TRUE AS second_write_refused
               FROM weekly CROSS JOIN (SELECT unnest(['first', 'second']) AS run) GROUP BY run""",
        ),
    )
    def complete(sp, d):
        """One whole run of two tables, and one that broke off after its first table."""
        root, weekly = f"{shared_folder(sp)}/tables/{uuid.uuid4().hex}", weekly_table(sp, d)
        write_table(weekly, root, "broken", "weekly")
        write_tables({"weekly": weekly, "predictions": baseline_rows(sp, d)}, root, "whole")
        read = [
            table.agg(F.count(F.lit(1)).alias("rows_read")).withColumn("name", F.lit(name))
            for name, table in read_run(sp, root, "whole").items()
        ]
        return complete_runs(sp, root).join(read[0].unionByName(read[1]), "name")

    add(
        "a5_complete_runs",
        "run_id name rows:i rows_read:i",
        complete,
        s.with_(
            s.predictions(),
            """SELECT 'whole' AS run_id, name, rows, rows AS rows_read FROM (
                 SELECT 'weekly' AS name, COUNT(*) AS rows FROM weekly
                 UNION ALL SELECT 'predictions', COUNT(*) FROM predictions)""",
        ),
    )
    add(
        "g8_best_model",
        "model_name WAPE:6",
        lambda sp, d: ev.best_model(
            ev.overall(baseline_table(sp, d)), ["naive", "seasonal_naive"]
        ),
        s.with_(
            s.predictions(),
            f"""SELECT model_name, "WAPE" FROM ({s.metrics('model_name')})
                ORDER BY "WAPE", model_name LIMIT 1""",
        ),
    )
    add(
        "g9_ridge_final_fit",
        "model_name horizon:i training_last_week alpha:4 intercept:4",
        lambda sp, d: r.fit(supervised_table(sp, d), NAMES),
    )

    def saved(sp, d):
        model = r.fit(supervised_table(sp, d), NAMES)
        path = write_table(model, f"{shared_folder(sp)}/models", uuid.uuid4().hex, "model")
        return sp.read.parquet(path).select(
            "*", F.size("features").alias("feature_count"), F.size("coefficients").alias("size")
        )

    add("g10_saved_model", "model_name horizon:i feature_count:i size:i", saved)

    def scored(sp, d):
        table = supervised_table(sp, d)
        return r.score(r.fit(table, NAMES), table.drop(*[f"target_h{n}" for n in s.HORIZONS]), NAMES)

    add(
        "g11_score_last_week",
        """model_name series_id category segment_label forecast_origin target_date horizon:i
           prediction:4""",
        scored,
    )
    def winner(sp, d):
        """Backtest, best model, final fit, save, load, forecast from the last week."""
        sparse = weekly_table(sp, d)
        panel = cut_lineage(densify(sparse))
        chosen = Experiment(models={"naive": {}, "seasonal_naive": {}})
        best = ev.best_model(ev.metrics(backtest(panel, chosen), names=["WAPE"])).first()["model_name"]
        folder = f"{shared_folder(sp)}/models/{uuid.uuid4().hex}"
        save_final(panel, chosen, best, folder)
        return forecast_saved(panel, folder)

    add(
        "g8_winner_saved_and_scored",
        "model_name model_family series_id category segment_label forecast_origin target_date horizon:i prediction:3",
        winner,
        s.with_(
            [
                *s.predictions(),
                f"""best AS (SELECT model_name FROM ({s.metrics('model_name')}) ORDER BY "WAPE", model_name LIMIT 1)""",
            ],
            """SELECT b.model_name, 'baseline' AS model_family, p.series_id, p.category, g.segment_label,
                 p.week_start AS forecast_origin, h.horizon,
                 CAST(p.week_start + INTERVAL 7 DAY * h.horizon AS DATE) AS target_date,
                 CASE WHEN b.model_name = 'naive' THEN p.lag_1 ELSE COALESCE(p.lag_52, p.lag_1) END AS prediction
               FROM lagged p JOIN segments g ON g.series_id = p.series_id CROSS JOIN best b
               CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS horizon) h
               WHERE p.week_start = (SELECT MAX(week_start) FROM panel)""",
        ),
    )
    scenario_spec = "scenario_name " + PREDICTION_SPEC
    add(
        "g12_scenario_baselines",
        scenario_spec,
        lambda sp, d: score_baselines(cut_lineage(sc.roll_up(scenario_table(sp, d))), 8),
        s.with_(SCENARIO_PREDICTIONS, "SELECT * FROM predictions"),
    )
    add(
        "g12_scenario_ridge",
        scenario_spec,
        lambda sp, d: score_ridge(
            cut_lineage(sc.roll_up(scenario_table(sp, d))), r.fit(supervised_table(sp, d, "p_type"), NAMES), NAMES
        ),
    )

    two_spec = "series_id category segment_label forecast_origin target_date horizon:i prediction:3"
    add(
        "g4_ridge_two_features",
        "series_id category segment_label forecast_origin target_date horizon:i actual:2 prediction:3",
        lambda sp, d: two_ridge(sp, d),
        s.with_(
            [*s.panel("p_brand"), s.segments(), *s.windows(), *two_feature_sql()],
            """SELECT p.series_id, p.category, g.segment_label, w.forecast_origin,
                 w.test_start AS target_date, w.horizon, a.sales_units AS actual,
                 c.intercept + c.b1 * p.lag_1 + c.b2 * p.lag_52 AS prediction
               FROM windows w JOIN coef c ON c.horizon = w.horizon AND c.train_end = w.train_end
               JOIN two p ON p.week_start = w.forecast_origin AND p.lag_52 IS NOT NULL
               JOIN panel a ON a.series_id = p.series_id AND a.week_start = w.test_start
               LEFT JOIN segments g ON g.series_id = p.series_id""",
        ),
    )
    final_ctes = [*s.panel("p_brand"), s.segments(), *two_feature_sql()]
    add(
        "g9_ridge_final_fit_two_features",
        "model_name horizon:i training_last_week alpha:4 intercept:3 b1:6 b2:6",
        lambda sp, d: r.fit(supervised_table(sp, d), TWO).select(
            "*", F.col("coefficients")[0].alias("b1"), F.col("coefficients")[1].alias("b2")
        ),
        s.with_(
            final_ctes,
            """SELECT 'ridge' AS model_name, horizon, last AS training_last_week, 1 AS alpha, intercept, b1, b2
               FROM final, (SELECT MAX(week_start) AS last FROM panel)""",
        ),
    )
    scored_sql = s.with_(
        final_ctes,
        """SELECT p.series_id, p.category, g.segment_label, p.week_start AS forecast_origin,
             CAST(p.week_start + INTERVAL 7 DAY * c.horizon AS DATE) AS target_date, c.horizon,
             c.intercept + c.b1 * p.lag_1 + c.b2 * p.lag_52 AS prediction
           FROM final c JOIN two p ON p.week_start = (SELECT MAX(week_start) FROM panel)
           LEFT JOIN segments g ON g.series_id = p.series_id""",
    )

    def scored_two(sp, d, saved_first: bool):
        table = supervised_table(sp, d)
        model = r.fit(table, TWO)
        if saved_first:
            model = r.load(sp, write_table(model, f"{shared_folder(sp)}/models", uuid.uuid4().hex, "model"))
        return r.score(model, table.drop(*[f"target_h{n}" for n in s.HORIZONS]), TWO)

    add("g10_saved_model_scores", two_spec, lambda sp, d: scored_two(sp, d, True), scored_sql)
    add("g11_score_last_week_two_features", two_spec, lambda sp, d: scored_two(sp, d, False), scored_sql)
    add(
        "g12_scenario_ridge_two_features",
        "scenario_name " + two_spec.replace("prediction", "actual:2 prediction"),
        lambda sp, d: score_ridge(
            cut_lineage(sc.roll_up(scenario_table(sp, d))), r.fit(supervised_table(sp, d, "p_type"), TWO), TWO
        ),
        s.with_(
            [
                *s.panel(),
                *two_feature_sql(),
                *[c for c in SCENARIO_PREDICTIONS if not c.startswith("predictions AS")],
            ],
            """SELECT p.scenario_name, p.series_id, p.category, g.segment_label, o.forecast_origin,
                 a.week_start AS target_date, c.horizon, a.sales_units AS actual,
                 GREATEST(c.intercept + c.b1 * p.lag_1 + c.b2 * p.lag_52, 0) AS prediction
               FROM origin o
               JOIN lagged p ON p.scenario_name = o.scenario_name AND p.week_start = o.forecast_origin
               CROSS JOIN final c
               JOIN rolled a ON a.scenario_name = p.scenario_name AND a.series_id = p.series_id
                 AND a.week_start = o.forecast_origin + INTERVAL 7 DAY * c.horizon
               JOIN segments g ON g.scenario_name = p.scenario_name AND g.series_id = p.series_id
               WHERE p.lag_52 IS NOT NULL""",
        ),
    )

    def uncovered(sp, d):
        frame = cut_lineage(sc.roll_up(scenario_table(sp, d)))
        made = score_baselines(frame, 8).where((F.col("horizon") < 7) | (F.col("scenario_name") == "A"))
        return sc.missing_horizons(made, frame, 8)

    add(
        "g13_missing_horizons",
        "scenario_name horizon:i",
        uncovered,
        """SELECT scenario_name, horizon FROM (
             SELECT DISTINCT l_returnflag AS scenario_name FROM lineitem)
           CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS horizon)
           WHERE NOT (horizon < 7 OR scenario_name = 'A')""",
    )


SCENARIO_PREDICTIONS = [
    *s.scenario_panel(),
    s.ROLLED,
    "history AS (SELECT * FROM rolled WHERE is_history)",
    s.segments("history", "scenario_name, series_id"),
    """origin AS (
    SELECT scenario_name, MAX(week_start) AS forecast_origin FROM history GROUP BY 1)""",
    """lagged AS (
    SELECT *, LAG(sales_units, 1) OVER ord AS lag_1, LAG(sales_units, 52) OVER ord AS lag_52
    FROM rolled WINDOW ord AS (PARTITION BY scenario_name, series_id ORDER BY week_start))""",
    """predictions AS (
    SELECT m.model_name, 'baseline' AS model_family, p.scenario_name, p.series_id, p.category,
           g.segment_label, o.forecast_origin, a.week_start AS target_date,
           date_diff('day', o.forecast_origin, a.week_start) // 7 AS horizon,
           a.sales_units AS actual,
           GREATEST(CASE WHEN m.model_name = 'naive' THEN p.lag_1
                         ELSE COALESCE(p.lag_52, p.lag_1) END, 0) AS prediction
    FROM origin o
    JOIN lagged p ON p.scenario_name = o.scenario_name AND p.week_start = o.forecast_origin
    JOIN rolled a ON a.scenario_name = p.scenario_name AND a.series_id = p.series_id
         AND a.week_start > o.forecast_origin
    JOIN segments g ON g.scenario_name = p.scenario_name AND g.series_id = p.series_id
    CROSS JOIN (SELECT unnest(['naive', 'seasonal_naive']) AS model_name) m)""",
]
