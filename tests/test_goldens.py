"""Published result values, recomputed."""

import datetime

import pytest
from pyspark.sql import functions as F

from weekcast.operators import audit as a
from weekcast.operators import evaluate as ev
from weekcast.operators import features as f
from weekcast.operators import seasonality as se
from weekcast.operators import windows as w

D = datetime.date


@pytest.fixture(scope="module")
def mondays(spark):
    """278 weeks from 2011-01-24."""
    return spark.sql(
        "SELECT explode(sequence(DATE'2011-01-24', DATE'2016-05-16', INTERVAL 7 DAYS)) AS week_start"
    ).withColumns({"series_id": F.lit("x"), "category": F.lit("x"), "sales_units": F.lit(1.0)})


def rows(df):
    return sorted(
        (r.horizon, r.train_start, r.train_end, r.forecast_origin, r.test_start, r.test_end)
        for r in df.collect()
    )


def test_all_windows(mondays):
    made = w.rolling_windows(mondays, w.Backtest())
    assert made.count() == 1620
    assert made.select("forecast_origin").distinct().count() == 206


def test_reduced_windows(mondays):
    made = rows(w.rolling_windows(mondays, w.Backtest(step_weeks=4, max_windows=32)))
    start = D(2011, 1, 24)
    assert len(made) == 256
    assert made[0] == (1, start, D(2013, 10, 14), D(2013, 10, 21), D(2013, 10, 28), D(2013, 10, 28))
    assert made[1] == (1, start, D(2013, 11, 11), D(2013, 11, 18), D(2013, 11, 25), D(2013, 11, 25))
    assert made[-2] == (8, start, D(2015, 12, 14), D(2016, 2, 8), D(2016, 4, 4), D(2016, 4, 4))
    assert made[-1] == (8, start, D(2016, 1, 11), D(2016, 3, 7), D(2016, 5, 2), D(2016, 5, 2))


def test_smoke_windows(mondays):
    made = rows(w.rolling_windows(mondays, w.Backtest(1, 2, 60, 4, 1)))
    start = D(2011, 1, 24)
    assert made == [
        (1, start, D(2016, 4, 25), D(2016, 5, 2), D(2016, 5, 9), D(2016, 5, 9)),
        (2, start, D(2016, 4, 18), D(2016, 5, 2), D(2016, 5, 16), D(2016, 5, 16)),
    ]


def test_too_few_weeks(mondays):
    short = mondays.where("week_start < DATE'2012-01-01'")
    with pytest.raises(Exception, match="need 72 weeks"):
        w.rolling_windows(short).collect()


# Six published forecasts and the metrics of each horizon.
FORECASTS = [
    ("foods", 1, 5500.0, 4791.5849609375),
    ("hobbies", 1, 6191.0, 5248.99609375),
    ("household", 1, 5538.0, 5343.32421875),
    ("foods", 2, 5478.0, 5101.95947265625),
    ("hobbies", 2, 6820.0, 5136.40966796875),
    ("household", 2, 5009.0, 5252.95849609375),
]
SCORES = {
    1: (
        0.10709238647411341,
        11.271216028491132,
        615.0315755208334,
        689.7153728810845,
        -615.0315755208334,
        708.4150390625,
    ),
    2: (
        0.1331015979354452,
        13.341767025482852,
        767.8631184895834,
        1005.8824702933546,
        -605.22412109375,
        376.04052734375,
    ),
}


def test_metrics(spark):
    table = spark.createDataFrame(
        FORECASTS, "series_id string, horizon int, actual double, prediction double"
    )
    made = {r.horizon: r for r in ev.metrics(table, ["horizon"]).collect()}
    for horizon, scores in SCORES.items():
        got = [made[horizon][m] for m in ("WAPE", "sMAPE", "MAE", "RMSE", "Bias", "MedianAE")]
        assert got == pytest.approx(scores, abs=1e-9)


# Units of 33 weeks and the published features of the last 20.
BEFORE = (
    "200451 188906 170327 165798 177296 178766 163600 150214 172158 171224 172620 140943 166308"
)
UNITS = (
    "188614 192196 177317 171099 196176 207012 198657 178807 199561 202687 193108 195565 189164 "
    "211390 201045 189333 191019 213122 225812 202535"
)
SNAPSHOT = {
    0: (162773.75, 170662.38461538462, 1.0217126532994416, -34143.0),
    1: (167121.25, 169751.84615384616, 1.1286057278772148, -292.0),
    6: (187901.0, 174575.46153846153, 1.1017078142213186, 43412.0),
    12: (197730.25, 189777.46153846153, 0.9890494752320396, 29257.0),
    19: (204821.5, 199174.61538461538, 1.1024819171815459, 27155.0),
}


def test_feature_snapshot(make_panel):
    values = [int(v) for v in (BEFORE + " " + UNITS).split()]
    panel = make_panel({"x": values})
    table = panel.withColumns(f.rolling_columns(f.series_order(), (4, 13)))
    made = [r.asDict() for r in table.orderBy("week_start").collect()][13:]
    for n, expected in SNAPSHOT.items():
        got = [
            made[n][c]
            for c in (
                "rolling_4_mean",
                "rolling_13_mean",
                "rolling_4_ratio_to_rolling_mean",
                "rolling_13_recent_trend_delta",
            )
        ]
        assert got == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(
    "stat, p",
    [
        (-2.525774076617216, 0.10932848467355777),
        (-1.6466115201787548, 0.4588082111106588),
        (-1.4365670584555257, 0.5646253631693648),
    ],
)
def test_unit_root_p_values(stat, p):
    assert se.adf_p_value(stat) == pytest.approx(p, abs=1e-9)


def test_stationarity_hint(spark):
    cases = [(0.10932848467355777, 0.01), (0.01, 0.1), (0.01, 0.01), (None, 0.1)]
    table = spark.createDataFrame(cases, "a double, k double")
    got = [r.h for r in table.select(se.hint("a", "k").alias("h")).collect()]
    assert got == ["likely_non_stationary", "likely_stationary", "mixed_signal", "inconclusive"]


def test_seasonal_index_is_a_ratio(make_panel):
    made = a.seasonal_index(make_panel({"x": [float(n % 53 + 1) for n in range(120)]})).collect()
    for r in made:
        assert r.seasonal_index == pytest.approx(r.mean_sales_units / r.category_mean_sales_units)


def test_standard_error_identity(spark):
    data = [("m", D(2020, 1, 6 + 7 * n), 10.0 + n, 11.0 + 2 * n) for n in range(3)]
    table = spark.createDataFrame(
        data, "model_name string, forecast_origin date, actual double, prediction double"
    )
    r = ev.rolling_vs_holdout(table).first()
    assert r.rolling_WAPE_standard_error == pytest.approx(r.origin_WAPE_std / 3**0.5)
    assert r.variance_reduction_factor_vs_single_holdout == 3.0
    assert r.holdout_WAPE_last_origin == pytest.approx(3 / 12)
