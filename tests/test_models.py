"""Forecasters and tests against brute force."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekcast.operators import features as f
from weekcast.operators import holt as h
from weekcast.operators import ridge as r
from weekcast.operators import seasonality as se
from weekcast.operators import windows as w
from weekcast.operators.baselines import baselines
from weekcast.operators.segments import segment_series
from weekcast.plans.experiment import Experiment, backtest, compare, final_ridge
from weekcast.session import cut_lineage


@pytest.fixture(scope="module")
def panel(make_panel):
    rng = np.random.default_rng(7)
    t = np.arange(110)
    return cut_lineage(
        make_panel(
            {
                f"s{k}": np.round(80 + 10 * k + 0.2 * t + 15 * np.sin(t / 8 + k) + rng.normal(0, 5, 110))
                for k in range(4)
            }
        )
    )


BACKTEST = w.Backtest(1, 3, 90, 4, None)
HORIZONS = (1, 2, 3)


@pytest.fixture(scope="module")
def table(panel):
    return cut_lineage(f.supervised(panel, segment_series(panel), horizons=HORIZONS))


def test_naive_traps(panel):
    windows = w.rolling_windows(panel, BACKTEST)
    segments = segment_series(panel)
    y = panel.toPandas().set_index(["series_id", "week_start"])["sales_units"]
    week = datetime.timedelta(weeks=1)
    for alignment in ("reference", "target"):
        made = baselines(panel, segments, windows, horizons=HORIZONS, alignment=alignment)
        for x in made.collect():
            at = {"naive": x.forecast_origin - week, "seasonal_naive": x.forecast_origin - 52 * week}
            if alignment == "target":
                at = {"naive": x.forecast_origin, "seasonal_naive": x.target_date - 52 * week}
            assert x.prediction == y[x.series_id, at[x.model_name]]
            assert x.actual == y[x.series_id, x.target_date]


def test_ridge_equals_one_fit_per_window(panel, table):
    names = f.feature_names(panel.columns, f.Features())
    windows = w.rolling_windows(table, BACKTEST)
    made = r.ridge(table, windows, names, HORIZONS, alpha=1.0).toPandas()
    rows = table.toPandas().dropna(subset=names)
    ends = windows.toPandas().set_index(["horizon", "forecast_origin"])["train_end"]
    assert len(made) == len(ends) * 4
    for (horizon, origin), part in made.groupby(["horizon", "forecast_origin"]):
        train = rows[rows["week_start"] <= ends[horizon, origin]].dropna(subset=[f"target_h{horizon}"])
        x, y = train[names].to_numpy(float), train[f"target_h{horizon}"].to_numpy(float)
        mean, std = x.mean(0), x.std(0)
        std[std == 0] = 1.0
        z = (x - mean) / std
        beta = np.linalg.solve(z.T @ z + np.eye(len(names)), z.T @ (y - y.mean()))
        test = rows[rows["week_start"] == origin].set_index("series_id")
        for x in part.itertuples():
            q = (test.loc[x.series_id, names].to_numpy(float) - mean) / std
            assert x.prediction == pytest.approx(y.mean() + q @ beta, abs=1e-6)


def test_ridge_trains_only_on_known_targets(make_panel):
    """Gaps inside the series: no row without its target is trained on."""
    rng = np.random.default_rng(3)
    series = {
        f"s{k}": [None if n % 15 == 7 + k else 130 + 10 * np.sin(n / 5 + k) + rng.normal(0, 3) for n in range(140)]
        for k in range(4)
    }
    panel = make_panel(series)
    segments = segment_series(panel)
    names = ["lag_1", "lag_2", "rolling_4_mean"]
    table = cut_lineage(f.supervised(panel, segments, horizons=HORIZONS))
    windows = w.rolling_windows(table, BACKTEST)
    made = r.ridge(table, windows, names, HORIZONS).toPandas()
    rows = table.toPandas().dropna(subset=names)
    ends = windows.toPandas().set_index(["horizon", "forecast_origin"])["train_end"]
    assert len(made) and rows["target_h1"].isna().sum() > 30
    for x in made.itertuples():
        train = rows[rows["week_start"] <= ends[x.horizon, x.forecast_origin]].dropna(subset=[f"target_h{x.horizon}"])
        z, y = train[names].to_numpy(float), train[f"target_h{x.horizon}"].to_numpy(float)
        mean, std = z.mean(0), z.std(0)
        beta = np.linalg.solve(((z - mean) / std).T @ ((z - mean) / std) + np.eye(3), ((z - mean) / std).T @ (y - y.mean()))
        test = rows[(rows["week_start"] == x.forecast_origin) & (rows["series_id"] == x.series_id)]
        want = y.mean() + ((test[names].to_numpy(float)[0] - mean) / std) @ beta
        assert x.prediction == pytest.approx(want, abs=1e-6)


def test_trees_have_the_windows_of_all_models(panel):
    chosen = Experiment(
        models={"seasonal_naive": {}, "gbt_squared": {"maxIter": 2, "maxDepth": 2}},
        backtest=w.Backtest(min_train_weeks=64, horizon_max=2, step_weeks=8, max_windows=3),
    )
    made = backtest(panel, chosen).toPandas()
    keys = ["series_id", "forecast_origin", "horizon", "target_date", "actual"]
    parts = [set(map(tuple, p[keys].to_numpy().tolist())) for _, p in made.groupby("model_name")]
    assert len(parts) == 2 and parts[0] == parts[1] and made["forecast_origin"].nunique() == 3


def test_ridge_final_fit_and_score(panel, table):
    names = f.feature_names(panel.columns, f.Features())
    model = r.fit(table, names, HORIZONS)
    made = r.score(model, table, names).toPandas()
    assert len(made) == 12 and made["actual"].isna().all()
    rows = table.toPandas().dropna(subset=names)
    train = rows.dropna(subset=["target_h2"])
    x, y = train[names].to_numpy(float), train["target_h2"].to_numpy(float)
    std = x.std(0)
    std[std == 0] = 1.0
    z = (x - x.mean(0)) / std
    beta = np.linalg.solve(z.T @ z + np.eye(len(names)), z.T @ (y - y.mean()))
    last = rows[rows["week_start"] == rows["week_start"].max()].set_index("series_id")
    for n in made[made["horizon"] == 2].itertuples():
        q = (last.loc[n.series_id, names].to_numpy(float) - x.mean(0)) / std
        assert n.prediction == pytest.approx(y.mean() + q @ beta, abs=1e-6)


def test_holt_equals_step_by_step(panel):
    states = h.holt_states(panel).toPandas().sort_values(["series_id", "week_start"])
    for _, own in states.groupby("series_id"):
        y = own["sales_units"].to_numpy()
        n = 40
        best = None
        for a in h.ALPHAS:
            for b in h.BETAS:
                level, trend, sse = y[0], 0.0, 0.0
                for v in y[1:n]:
                    gap = v - (level + trend)
                    sse += gap * gap
                    level, trend = level + trend + a * gap, trend + a * b * gap
                if best is None or sse < best[0]:
                    best = (sse, level, trend)
        assert own["level"].iloc[n - 1] == pytest.approx(best[1])
        assert own["trend"].iloc[n - 1] == pytest.approx(best[2])
        assert own["level"].iloc[3] == y[3] and own["trend"].iloc[3] == 0


def test_holt_with_unequal_lengths(make_panel):
    states = h.holt_states(make_panel({"a": [5.0] * 12, "b": [1.0, 2.0, 3.0]})).toPandas()
    assert states.groupby("series_id").size().to_dict() == {"a": 12, "b": 3}
    assert states[["level", "trend"]].notna().all().all()


def adf_brute(y):
    n = len(y)
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(y)

    def fit(lags, skip):
        t = np.arange(skip, len(d))
        x = np.column_stack([np.ones(len(t)), y[t], *[d[t - j] for j in range(1, lags + 1)]])
        beta = np.linalg.pinv(x) @ d[t]
        gap = d[t] - x @ beta
        return x, beta, gap @ gap

    scores = []
    for lags in range(top + 1):
        x, _, rss = fit(lags, top)
        scores.append(len(x) * np.log(rss / len(x)) + 2 * x.shape[1])
    lags = int(np.argmin(scores))
    x, beta, rss = fit(lags, lags)
    cov = np.linalg.inv(x.T @ x) * rss / (len(x) - x.shape[1])
    return beta[1] / np.sqrt(cov[1, 1])


def test_adf_equals_brute_force(panel, make_panel):
    own = panel.toPandas().sort_values(["series_id", "week_start"])
    want = {k: adf_brute(v["sales_units"].to_numpy()) for k, v in own.groupby("series_id")}
    for x in se.adf(panel).collect():
        assert x.adf_stat == pytest.approx(want[x.series_id], abs=1e-8)
        assert 0 <= x.adf_pvalue <= 1
    short = se.stationarity(make_panel({"flat": [1] * 30, "short": [1, 5, 2]})).collect()
    assert {x.stationarity_hint for x in short} == {"inconclusive"}


def test_pacf_equals_yule_walker(panel):
    own = panel.toPandas().sort_values(["series_id", "week_start"])
    made = se.pacf(panel, 10).toPandas()
    for name, v in own.groupby("series_id"):
        e = v["sales_units"].to_numpy() - v["sales_units"].mean()
        rho = np.array([e[k:] @ e[: len(e) - k] for k in range(11)]) / (e @ e)
        got = made[made["series_id"] == name].set_index("lag")["pacf"]
        assert got[0] == 1.0
        for k in range(1, 11):
            toeplitz = rho[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
            assert got[k] == pytest.approx(np.linalg.solve(toeplitz, rho[1 : k + 1])[-1])


def test_decomposition_adds_up(panel):
    made = se.decompose(panel).toPandas().sort_values(["series_id", "week_start"])
    parts = made["trend"] + made["seasonal"] + made["resid"]
    assert np.allclose(parts, made["sales_units"])
    assert made.groupby("series_id")["seasonal"].apply(lambda s: abs(s.iloc[:52].sum())).max() < 1e-9


def test_experiment_end_to_end(panel):
    chosen = Experiment(
        models={"naive": {}, "seasonal_naive": {}, "ets": {}, "ridge": {"alpha": 1.0}},
        backtest=BACKTEST,
        bootstrap_samples=20,
    )
    made = backtest(panel, chosen)
    counts = {x.model_name: x["count"] for x in made.groupBy("model_name").count().collect()}
    assert len(set(counts.values())) == 1 and set(counts) == set(chosen.models)
    tables = compare(made, chosen)
    assert tables["bootstrap_ci"].count() == 6
    assert tables["error_cases"].count() == 40
    best = tables["overall"].first().model_name
    assert {x.model_name for x in tables["leader_predictions"].collect()} == {best}
    assert final_ridge(panel, chosen).count() == 3


def test_experiment_settings(panel):
    with pytest.raises(ValueError, match="seasonal_naive"):
        backtest(panel, Experiment(models={"naive": {}}))
    with pytest.raises(ValueError, match="unknown models"):
        backtest(panel, Experiment(models={"seasonal_naive": {}, "mlp": {}}))
    with pytest.raises(ValueError, match="longest lag"):
        backtest(panel, Experiment(backtest=w.Backtest(min_train_weeks=20)))


def test_audit_plan(spark):
    from weekcast.plans.audit import audit
    from weekcast.sources.star import star_raw

    tables = audit(star_raw(spark, "/root/testdata/sf0.001"), "sku")
    for name, table in tables.items():
        if name not in ("stationarity_summary", "decomposition"):  # every SKU: slow here, tested apart
            assert table.count() > 0, name


def test_scenario_scoring_needs_only_recent_weeks(spark):
    """Trimming the weeks before scoring leaves the forecasts as they are on all weeks."""
    from weekcast.operators.scenarios import full_panel, history_panel, roll_up
    from weekcast.operators.windows import future_windows
    from weekcast.plans.predict import KEYS, score_ridge
    from weekcast.sources.star import star_scenarios

    frame = cut_lineage(roll_up(star_scenarios(spark, "/root/testdata/sf0.001", 3)))
    names = f.feature_names(frame.columns, f.Features())
    panel = frame.where("scenario_name = 'A'")
    train = cut_lineage(f.supervised(panel, segment_series(panel), horizons=(1, 2)))
    model = cut_lineage(r.fit(train, names, (1, 2)))
    made = score_ridge(frame, model, names).toPandas()
    everything = f.supervised(
        full_panel(frame), segment_series(history_panel(frame), KEYS), keys=KEYS
    )
    origin = future_windows(frame, 1, ("scenario_name",))
    want = r.score(model, everything, names, origin, KEYS, 0.0).toPandas()
    both = made.merge(want, on=["scenario_name", "series_id", "horizon"])
    assert len(both) == len(want) == len(made) > 0
    assert np.allclose(both["prediction_x"], both["prediction_y"])
    assert (both["actual_x"] == both["actual_y"]).all()


def test_scenario_refit(spark):
    from weekcast.operators.scenarios import full_panel, roll_up
    from weekcast.plans.predict import KEYS, predict, refit
    from weekcast.sources.star import star_scenarios

    frame = cut_lineage(roll_up(star_scenarios(spark, "/root/testdata/sf0.001", 3)))
    names = f.feature_names(frame.columns, f.Features())
    made = refit(frame, names, 3).toPandas()
    assert (made["prediction"] >= 0).all()
    # Every series with a full set of features at the origin, for each horizon.
    table = f.supervised(
        full_panel(frame), segment_series(full_panel(frame), KEYS), horizons=(1,), keys=KEYS
    ).toPandas()
    origin = made["forecast_origin"].unique()
    known = table[table["week_start"].isin(origin)].dropna(subset=names)
    assert len(origin) == 1 and len(made) == 3 * len(known)
    # One scenario alone gives the same forecasts: no row of another one is trained on.
    alone = refit(frame.where("scenario_name = 'A'"), names, 3).toPandas()
    both = made.merge(alone, on=["scenario_name", "series_id", "horizon"])
    assert len(both) == len(alone)
    assert np.allclose(both["prediction_x"], both["prediction_y"], rtol=1e-6)
    panel = frame.where("scenario_name = 'A'")
    table = cut_lineage(f.supervised(panel, segment_series(panel), horizons=(1,)))
    tables = predict(frame, r.fit(table, names, (1,)), names, 3)
    # The saved model knows one horizon only, so a refit supplies the rest.
    assert set(tables["metrics_by_horizon"].toPandas()["horizon"]) == {1, 2, 3}
    assert isinstance(tables["coverage"].toPandas(), pd.DataFrame)


def test_scenario_horizons(spark):
    """No more horizons than asked for, and as many as the model has, past eight too."""
    from weekcast.operators.scenarios import roll_up
    from weekcast.plans.predict import predict, score_ridge
    from weekcast.sources.star import star_scenarios

    frame = cut_lineage(roll_up(star_scenarios(spark, "/root/testdata/sf0.001", 12)))
    names = ["lag_1", "lag_52"]
    panel = frame.where("scenario_name = 'A' AND is_history")
    long = tuple(range(1, 13))
    model = cut_lineage(r.fit(cut_lineage(f.supervised(panel, segment_series(panel), horizons=long)), names, long))
    assert {x.horizon for x in score_ridge(frame, model, names).select("horizon").distinct().collect()} == set(long)
    made = predict(frame, model, names, 3)["predictions"]
    assert {x.horizon for x in made.select("horizon").distinct().collect()} == {1, 2, 3}


def test_only_the_short_scenario_is_refitted(spark, monkeypatch):
    from weekcast.operators.scenarios import roll_up
    from weekcast.plans import predict as pp
    from weekcast.sources.star import star_scenarios

    frame = cut_lineage(roll_up(star_scenarios(spark, "/root/testdata/sf0.001", 3)))
    names = ["lag_1", "lag_52"]
    panel = frame.where("scenario_name = 'A' AND is_history")
    model = cut_lineage(r.fit(cut_lineage(f.supervised(panel, segment_series(panel), horizons=(1, 2, 3))), names, (1, 2, 3)))
    score = pp.score_ridge
    monkeypatch.setattr(pp, "score_ridge", lambda *a, **k: score(*a, **k).where("scenario_name <> 'A' OR horizon < 3"))
    key = lambda df: {(x.scenario_name, x.series_id, x.horizon): round(x.prediction, 6) for x in df.collect()}
    made = key(pp.predict(frame, model, names, 3)["predictions"])
    saved = key(score(frame, model, names))
    anew = key(pp.refit(frame, names, 3))
    assert made == {k: (anew if k[0] == "A" else saved)[k] for k in made}
    assert {k[0] for k in made} == {k[0] for k in saved} and len({k[0] for k in made}) == 3


def test_any_winner_is_saved_and_scored(panel, tmp_path):
    """Saved, loaded and scored, each model forecasts what its fit on all weeks says."""
    from weekcast.plans.winner import forecast_saved, save_final

    small = f.Features(feature_set="F1")
    chosen = Experiment(
        models={
            "naive": {},
            "seasonal_naive": {"alignment": "target"},
            "ets": {"alignment": "target"},
            "ridge": {"alpha": 1.0},
            "gbt_squared": {"maxIter": 2, "maxDepth": 2, "features": small},
        },
        backtest=BACKTEST,
    )
    last = panel.agg(F.max("week_start")).first()[0]
    y = {(x.series_id, x.week_start): x.sales_units for x in panel.collect()}
    week = datetime.timedelta(weeks=1)
    made = {}
    for name in chosen.models:
        save_final(panel, chosen, name, f"{tmp_path}/{name}")
        made[name] = forecast_saved(panel, f"{tmp_path}/{name}").collect()
        assert {(x.horizon, x.forecast_origin, x.target_date) for x in made[name]} == {(h, last, last + h * week) for h in HORIZONS}
        assert len(made[name]) == 4 * len(HORIZONS) and all(x.prediction is not None for x in made[name])
    assert all(x.prediction == y[x.series_id, last - week] for x in made["naive"])
    assert all(x.prediction == y[x.series_id, x.target_date - 52 * week] for x in made["seasonal_naive"])
    table = cut_lineage(f.supervised(panel, segment_series(panel), horizons=HORIZONS))
    names = f.feature_names(panel.columns, f.Features())
    want = {(x.series_id, x.horizon): x.prediction for x in r.score(r.fit(table, names, HORIZONS), table, names).collect()}
    assert {(x.series_id, x.horizon): pytest.approx(x.prediction) for x in made["ridge"]} == want
    states = {x.series_id: x for x in h.holt_states(panel).where(F.col("week_start") == F.lit(last)).collect()}
    for x in made["ets"]:
        s = states[x.series_id]
        assert x.prediction == pytest.approx(s.level + x.horizon * s.trend)
