"""Metrics, rankings, bootstrap, error cases and their chart tables."""

from __future__ import annotations

from catalog import sqlbase as s
from catalog.model_queries import SCENARIO_PREDICTIONS
from catalog.registry import Registry
from catalog.tables import baseline_counted, baseline_rows, baseline_table, scenario_table
from weekcast.functions import hashing
from weekcast.functions.errors import METRICS
from weekcast.operators import bootstrap as bs
from weekcast.operators import charts as c
from weekcast.operators import evaluate as ev
from weekcast.operators import scenarios as sc
from weekcast.plans.predict import score_baselines
from weekcast.session import cut_lineage

SPEC = s.METRIC_SPEC
REPS, SEED = 300, 42
CI_SPEC = """model_a model_b metric mean_difference:6 median_difference:6 ci95_low:6 ci95_high:6
    n_bootstrap:i bootstrap_unit"""
CASE_SPEC = """case_type model_name series_id category segment_label forecast_origin target_date
    horizon:i actual:2 prediction:2 baseline_prediction:2 model_abs_error:2 baseline_abs_error:2
    abs_error_gain_vs_baseline:2"""


def _mixed(source: str, name: str) -> str:
    """The 32-bit mixer as nested selects."""
    folded = f"xor({name} >> 16, {name})"
    scrambled = f"({folded} * {hashing.MULTIPLIER}) & {hashing.MASK}"
    for step in (scrambled, scrambled, folded):
        source = f"SELECT * REPLACE ({step} AS {name}) FROM ({source})"
    return source


def draw_sql(source: str, seed: int, rep: str, index: str) -> str:
    """``source`` plus column ``u``, the 63-bit number of (seed, rep, index)."""
    q = _mixed(f"SELECT *, xor(CAST({rep} AS BIGINT), {hashing.mix_int(seed)}) AS ma FROM ({source})", "ma")
    q = _mixed(f"SELECT *, xor({index} & {hashing.MASK}, ma) AS mb FROM ({q})", "mb")
    low = f"(({index} & {hashing.MASK}) + ma + {hashing.INCREMENT}) & {hashing.MASK}"
    q = _mixed(f"SELECT *, {low} AS mc FROM ({q})", "mc")
    q = _mixed(f"SELECT * REPLACE (xor({index} >> 32, mc) AS mc) FROM ({q})", "mc")
    return f"SELECT *, (mb & {0x7FFFFFFF}) * {2**32} + mc AS u FROM ({q})"


def stream_sql(source: str, seed: int) -> str:
    """``source`` plus ``u``: number ``k`` of the stream of (seed, r, name)."""
    keyed = f"SELECT * EXCLUDE (ma, mb, mc, u), u & {hashing.MASK} AS low, ((u >> 32) << 32) | k AS i FROM ({draw_sql(source, seed, 'r', 'name')})"
    return draw_sql(keyed, seed, "low", "i")


MIXED = ("sku", "p_brand")


def mixed_rows(sp, d, by=("segment_label",)):
    """Counted predictions at two grains together: SKUs are intermittent, brands are not, so
    there is more than one segment."""
    return baseline_counted(sp, d, MIXED[0], by).unionByName(baseline_counted(sp, d, MIXED[1], by))


MIXED_SQL = ["predictions AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({s.with_(s.predictions(level), 'SELECT * FROM predictions')})" for level in MIXED
) + ")"]


BLOCKS = [
    """numbered_blocks AS (
    SELECT series_id, forecast_origin, horizon,
           ROW_NUMBER() OVER (ORDER BY series_id, forecast_origin, horizon) - 1 AS block_id,
           COUNT(*) OVER () AS n
    FROM (SELECT DISTINCT series_id, forecast_origin, horizon FROM predictions))""",
    """block_sums AS (
    SELECT b.block_id, p.model_name, COUNT(*) AS cnt, SUM(ABS(prediction - actual)) AS ae,
           SUM(prediction - actual) AS er, SUM((prediction - actual) * (prediction - actual)) AS sq,
           SUM(ABS(actual)) AS aa,
           SUM(200 * ABS(prediction - actual) / CASE WHEN ABS(actual) + ABS(prediction) = 0 THEN 1
               ELSE ABS(actual) + ABS(prediction) END) AS sm
    FROM predictions p JOIN numbered_blocks b ON b.series_id = p.series_id
         AND b.forecast_origin = p.forecast_origin AND b.horizon = p.horizon GROUP BY 1, 2)""",
]
METRIC_SUMS = {
    "WAPE": "SUM(w * ae) / NULLIF(SUM(w * aa), 0)",
    "sMAPE": "SUM(w * sm) / SUM(w * cnt)",
    "MAE": "SUM(w * ae) / SUM(w * cnt)",
    "RMSE": "SQRT(SUM(w * sq) / SUM(w * cnt))",
    "Bias": "SUM(w * er) / SUM(w * cnt)",
}


def splitting_sql() -> list[str]:
    """``drawn`` (rep, block_id, w): segments of equal cells, the draws of each found by comparing
    random bits with a fraction, halved down the tree of its cells, and drawn inside a cell."""
    word, cell = bs.WORD, bs.CELL
    bits = f"bit_count(u & ((CAST(1 AS BIGINT) << CAST(least({word}, greatest(n_bits - {word} * k, 0)) AS INTEGER)) - 1))"
    words = lambda n: f"unnest(generate_series(CAST(0 AS BIGINT), greatest(CAST(({n} + {word - 1}) // {word} AS BIGINT), 1) - 1)) AS k"
    chained = f"""SELECT c.*, c.u AS n_bits, (rep * 64 + least(t, 63)) * 8 + seg AS r, {words("c.u")} FROM chain c"""
    chained = stream_sql(f"SELECT *, CAST(greatest(t - 63, 0) AS BIGINT) AS name FROM (SELECT * EXCLUDE (u) FROM ({chained}))", SEED)
    halved = stream_sql(f"SELECT *, c AS n_bits, rep * 512 + seg AS r, node AS name, {words('c')} FROM tree WHERE level < depth AND c > 0", SEED)
    local = "SELECT *, rep * 8 + seg AS r, node - (1 << depth) AS name, unnest(generate_series(CAST(0 AS BIGINT), c - 1)) AS k FROM tree WHERE level = depth AND c > 0"
    local = stream_sql(local, SEED + 1)
    depth = f"list_filter(range(0, 40), lambda d: (n >> CAST(d AS INTEGER)) <= {cell})[1]"
    return [
        f"""segs AS (
        SELECT 0 AS seg, CAST(0 AS BIGINT) AS start, n, depth, n >> depth AS size
        FROM (SELECT n, CAST({depth} AS INTEGER) AS depth FROM (SELECT COUNT(*) AS n FROM numbered_blocks))
        UNION ALL
        SELECT seg, start, n, depth, n >> depth FROM (
          SELECT seg, start, n, CAST({depth} AS INTEGER) AS depth FROM (
            SELECT seg + 1 AS seg, start + (size << depth) AS start, n - (size << depth) AS n FROM segs
            WHERE n > (size << depth))))""",
        f"""chain AS (
        SELECT CAST(rep AS BIGINT) AS rep, seg, n AS c, n AS u, CAST(0 AS BIGINT) AS got, n - (size << depth) AS rest, n AS whole, 1 AS t
        FROM segs CROSS JOIN (SELECT unnest(generate_series(0, {REPS - 1})) AS rep) WHERE seg = 0
        UNION ALL
        SELECT w.rep, CASE WHEN over THEN w.seg + 1 ELSE w.seg END, CASE WHEN over THEN got ELSE c END,
          CASE WHEN over THEN got WHEN 2 * rest >= whole THEN ones ELSE n_bits - ones END,
          CASE WHEN over THEN 0 WHEN 2 * rest >= whole THEN got + n_bits - ones ELSE got END,
          CASE WHEN over THEN s.n - (s.size << s.depth) WHEN 2 * rest >= whole THEN 2 * rest - whole ELSE 2 * rest END,
          CASE WHEN over THEN s.n ELSE whole END, CASE WHEN over THEN 1 ELSE t + 1 END
        FROM (SELECT rep, seg, c, n_bits, got, rest, whole, t, n_bits = 0 OR rest = 0 AS over, CAST(SUM({bits}) AS BIGINT) AS ones
              FROM ({chained}) GROUP BY rep, seg, c, n_bits, got, rest, whole, t) w
        LEFT JOIN segs s ON s.seg = w.seg + 1 WHERE NOT over OR s.seg IS NOT NULL)""",
        f"""tree AS (
        SELECT c.rep, c.seg, s.depth, 0 AS level, CAST(1 AS BIGINT) AS node, c.c - c.got AS c
        FROM chain c JOIN segs s ON s.seg = c.seg WHERE c.u = 0 OR c.rest = 0
        UNION ALL
        SELECT rep, seg, depth, level + 1, node * 2 + side, CASE WHEN side = 1 THEN ones ELSE c - ones END
        FROM (SELECT rep, seg, depth, level, node, c, CAST(SUM({bits}) AS BIGINT) AS ones FROM ({halved}) GROUP BY ALL)
        CROSS JOIN (VALUES (0), (1)) sides(side))""",
        f"""drawn AS (
        SELECT rep, start + (node - (1 << l.depth)) * size + u % size AS block_id, COUNT(*) AS w
        FROM ({local}) l JOIN segs s ON s.seg = l.seg GROUP BY 1, 2)""",
    ]


def bootstrap_sql(metric: str, method: str = "multinomial") -> str:
    slots = f"""SELECT block_id, n, rep FROM numbered_blocks
        CROSS JOIN (SELECT unnest(generate_series(0, {REPS - 1})) AS rep)"""
    if method == "multinomial":
        made, weights = splitting_sql(), "SELECT rep, block_id, w FROM drawn"
    else:
        passed = " + ".join(f"CASE WHEN u >= {v} THEN 1 ELSE 0 END" for v in bs.poisson_bounds())
        made, weights = [], f"SELECT rep, block_id, {passed} AS w FROM ({draw_sql(slots, SEED, 'rep', 'block_id')})"
    if metric == "MedianAE":
        value = f"""SELECT d.rep, p.model_name, QUANTILE_CONT(ABS(p.prediction - p.actual), 0.5) AS value
            FROM (SELECT rep, block_id, unnest(generate_series(1, w)) AS k FROM ({weights})) d
            JOIN numbered_blocks b ON b.block_id = d.block_id
            JOIN predictions p ON p.series_id = b.series_id
                 AND p.forecast_origin = b.forecast_origin AND p.horizon = b.horizon
            GROUP BY 1, 2"""
    else:
        value = f"""SELECT d.rep, x.model_name, {METRIC_SUMS[metric]} AS value
            FROM ({weights}) d JOIN block_sums x ON x.block_id = d.block_id GROUP BY 1, 2"""
    return s.with_(
        [*s.predictions(), *BLOCKS, *made, f"per_model AS ({value})"],
        f"""SELECT a.model_name AS model_a, b.model_name AS model_b, '{metric}' AS metric,
              AVG(a.value - b.value) AS mean_difference,
              QUANTILE_CONT(a.value - b.value, 0.5) AS median_difference,
              QUANTILE_CONT(a.value - b.value, 0.025) AS ci95_low,
              QUANTILE_CONT(a.value - b.value, 0.975) AS ci95_high,
              {REPS} AS n_bootstrap, '{bs.UNIT}' AS bootstrap_unit
            FROM per_model a JOIN per_model b ON b.rep = a.rep AND a.model_name < b.model_name
            GROUP BY 1, 2""",
        recursive=bool(made),
    )


def scenario_predictions(sp, d):
    frame = cut_lineage(sc.roll_up(scenario_table(sp, d)))
    return cut_lineage(score_baselines(frame, 8))


def register(q: Registry) -> None:
    add = q.add
    for name, by in {
        "h5_metrics_overall": "model_name",
        "h5_metrics_by_horizon": "model_name, horizon",
        "h6_metrics_by_segment": "model_name, segment_label",
        "h6_metrics_by_category": "model_name, category",
    }.items():
        keys = by.split(", ")
        mixed = "segment" in name
        spec = " ".join(f"{k}:i" if k == "horizon" else k for k in keys)
        add(
            name,
            f"{spec} {SPEC}",
            lambda sp, d, keys=keys, rows=mixed_rows if mixed else baseline_rows: ev.metrics(rows(sp, d), keys),
            s.with_(MIXED_SQL if mixed else s.predictions(), s.metrics(by)),
        )
    every_key = ["model_name", "horizon", "segment_label", "category"]
    cuts = " UNION ALL ".join(
        "SELECT '{}' AS cut, {}, {} FROM ({})".format(
            name,
            ", ".join(k if k in by else f"NULL AS {k}" for k in every_key),
            ", ".join(f'"{m}"' for m in METRICS),
            s.metrics(", ".join(by)),
        )
        for name, by in ev.CUTS.items()
    )
    add(
        "h5_metrics_all_cuts",
        f"cut model_name horizon:i segment_label category {SPEC}",
        lambda sp, d: ev.metrics_by_cuts(mixed_rows(sp, d, every_key[1:])),
        s.with_(MIXED_SQL, cuts),
    )
    for name, metric in {
        "h1_wape": "WAPE:6",
        "h2_smape": "sMAPE:4",
        "h3_mae_rmse_bias": "MAE:4 RMSE:4 Bias:4",
        "h4_median_absolute_error": "MedianAE:4",
    }.items():
        add(
            name,
            f"model_name series_id {metric}",
            lambda sp, d, names=[m.partition(":")[0] for m in metric.split()]: ev.metrics(
                baseline_rows(sp, d, "p_brand"), ["model_name", "series_id"], names
            ),
            s.with_(s.predictions("p_brand"), s.metrics("model_name, series_id")),
        )
    add(
        "h7_metrics_by_scenario",
        f"scenario_name horizon:i {SPEC}",
        lambda sp, d: ev.metrics(scenario_predictions(sp, d), ["scenario_name", "horizon"]),
        s.with_(SCENARIO_PREDICTIONS, s.metrics("scenario_name, horizon")),
    )
    add(
        "h8_rolling_vs_holdout",
        """model_name origins_count:i rolling_WAPE:6 holdout_WAPE_last_origin:6
           holdout_minus_rolling_WAPE:6 origin_WAPE_std:6 rolling_WAPE_standard_error:6
           variance_reduction_factor_vs_single_holdout:4""",
        lambda sp, d: ev.rolling_vs_holdout(baseline_table(sp, d)),
        s.with_(
            [
                *s.predictions(),
                """per_origin AS (
                SELECT model_name, forecast_origin, SUM(ABS(prediction - actual)) AS ae,
                       SUM(ABS(actual)) AS aa FROM predictions GROUP BY 1, 2)""",
                """by_model AS (
                SELECT model_name, COUNT(*) AS n, SUM(ae) / SUM(aa) AS rolling,
                       STDDEV_SAMP(ae / aa) AS sd,
                       MAX(CASE WHEN forecast_origin = (SELECT MAX(forecast_origin) FROM per_origin)
                           THEN ae / aa END) AS holdout FROM per_origin GROUP BY 1)""",
            ],
            """SELECT model_name, n AS origins_count, rolling AS "rolling_WAPE",
                 holdout AS "holdout_WAPE_last_origin",
                 holdout - rolling AS "holdout_minus_rolling_WAPE", sd AS "origin_WAPE_std",
                 sd / SQRT(n) AS "rolling_WAPE_standard_error",
                 n AS variance_reduction_factor_vs_single_holdout FROM by_model""",
        ),
    )

    def leader(sp, d):
        table = baseline_table(sp, d)
        return ev.leader_predictions(table, ev.overall(table))

    best = """(SELECT model_name FROM predictions GROUP BY 1
        ORDER BY SUM(ABS(prediction - actual)) / SUM(ABS(actual)), model_name LIMIT 1)"""
    add(
        "h9_leader_predictions",
        "model_name series_id forecast_origin horizon:i actual:2 prediction:2",
        leader,
        s.with_(s.predictions(), f"SELECT * FROM predictions WHERE model_name IN {best}"),
    )
    cases = """cases AS (
        SELECT p.*, b.prediction AS baseline_prediction,
               ABS(p.prediction - p.actual) AS model_abs_error,
               ABS(b.prediction - p.actual) AS baseline_abs_error,
               ABS(b.prediction - p.actual) - ABS(p.prediction - p.actual)
                   AS abs_error_gain_vs_baseline
        FROM predictions p JOIN predictions b ON b.model_name = 'seasonal_naive'
             AND b.series_id = p.series_id AND b.forecast_origin = p.forecast_origin
             AND b.target_date = p.target_date AND b.horizon = p.horizon AND b.actual = p.actual
        WHERE p.model_name <> 'seasonal_naive')"""
    ties = "model_name, series_id, forecast_origin, horizon"
    add(
        "h10_error_cases",
        CASE_SPEC,
        lambda sp, d: ev.error_cases(baseline_table(sp, d, "p_brand")),
        s.with_(
            [*s.predictions("p_brand"), cases],
            f"""SELECT * FROM (SELECT 'best_win' AS case_type, * FROM cases
                  ORDER BY abs_error_gain_vs_baseline DESC, {ties} LIMIT 20)
                UNION ALL
                SELECT * FROM (SELECT 'worst_loss' AS case_type, * FROM cases
                  ORDER BY abs_error_gain_vs_baseline, {ties} LIMIT 20)""",
        ),
    )
    for name, metric, method in (
        ("h11_bootstrap_wape", "WAPE", "multinomial"),
        ("h11_bootstrap_wape_poisson", "WAPE", "poisson"),
        ("h12_bootstrap_smape", "sMAPE", "multinomial"),
        ("h12_bootstrap_mae", "MAE", "multinomial"),
        ("h12_bootstrap_rmse", "RMSE", "multinomial"),
        ("h12_bootstrap_bias", "Bias", "multinomial"),
        ("h12_bootstrap_median_ae", "MedianAE", "multinomial"),
    ):
        add(
            name,
            CI_SPEC,
            lambda sp, d, m=metric, how=method: bs.bootstrap_ci(
                baseline_table(sp, d), m, REPS, SEED, how
            ),
            bootstrap_sql(metric, method),
        )
    add(
        "h13_ranking",
        "model_name WAPE:6 gap_to_leader:6 gap_to_baseline:6",
        lambda sp, d: ev.ranking(cut_lineage(ev.overall(baseline_table(sp, d)))),
        s.with_(
            [*s.predictions(), f"scores AS ({s.metrics('model_name')})"],
            """SELECT model_name, "WAPE",
                 "WAPE" - (SELECT MIN("WAPE") FROM scores) AS gap_to_leader,
                 "WAPE" - (SELECT "WAPE" FROM scores WHERE model_name = 'seasonal_naive')
                   AS gap_to_baseline FROM scores""",
        ),
    )
    add(
        "h14_best_per_segment",
        "segment_label model_name WAPE:6",
        lambda sp, d: ev.best_per_segment(
            ev.metrics(mixed_rows(sp, d), ["model_name", "segment_label"])
        ),
        s.with_(
            [*MIXED_SQL, f"scores AS ({s.metrics('model_name, segment_label')})"],
            """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (
                 PARTITION BY segment_label ORDER BY "WAPE", model_name) AS n FROM scores)
               WHERE n = 1""",
        ),
    )
    add(
        "h15_best_row",
        "scenario_name horizon:i WAPE:6",
        lambda sp, d: ev.best_row(
            ev.metrics(scenario_predictions(sp, d), ["scenario_name", "horizon"])
        ),
        s.with_(
            [*SCENARIO_PREDICTIONS, f"scores AS ({s.metrics('scenario_name, horizon')})"],
            """SELECT * FROM scores ORDER BY "WAPE", scenario_name, horizon LIMIT 1""",
        ),
    )
    add(
        "h15_scenario_coverage",
        "scenario_name series:i rows:i",
        lambda sp, d: ev.scenario_coverage(scenario_table(sp, d)),
        s.with_(
            s.scenario_panel(),
            """SELECT scenario_name, COUNT(DISTINCT series_id) AS series, COUNT(*) AS rows
               FROM scenarios GROUP BY 1""",
        ),
    )
    add(
        "v10_error_by_horizon",
        "scenario_name horizon:i abs_error:4",
        lambda sp, d: c.error_by_horizon(scenario_predictions(sp, d)),
        s.with_(
            SCENARIO_PREDICTIONS,
            """SELECT scenario_name, horizon, AVG(ABS(actual - prediction)) AS abs_error
               FROM predictions GROUP BY 1, 2""",
        ),
    )
    add(
        "v11_wape_model_horizon",
        "model_name " + " ".join(f"horizon_{h}:6" for h in s.HORIZONS),
        lambda sp, d: c.wape_matrix(
            ev.metrics(baseline_rows(sp, d), ["model_name", "horizon"]),
            "model_name",
            "horizon",
            s.HORIZONS,
        ),
        s.with_(
            [*s.predictions(), f"scores AS ({s.metrics('model_name, horizon')})"],
            "SELECT model_name, "
            + ", ".join(
                f'MAX(CASE WHEN horizon = {h} THEN "WAPE" END) AS horizon_{h}' for h in s.HORIZONS
            )
            + " FROM scores GROUP BY 1",
        ),
    )
    models = ("naive", "seasonal_naive")
    add(
        "v11_wape_segment_model",
        "segment_label " + " ".join(f"model_name_{m}:6" for m in models),
        lambda sp, d: c.wape_matrix(
            ev.metrics(mixed_rows(sp, d), ["model_name", "segment_label"]),
            "segment_label",
            "model_name",
            models,
        ),
        s.with_(
            [*MIXED_SQL, f"scores AS ({s.metrics('model_name, segment_label')})"],
            "SELECT segment_label, "
            + ", ".join(
                f"""MAX(CASE WHEN model_name = '{m}' THEN "WAPE" END) AS model_name_{m}"""
                for m in models
            )
            + " FROM scores GROUP BY 1",
        ),
    )
