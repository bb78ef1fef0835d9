"""Seasonal smoothing against a plain loop, its fits against the grid, and the two forecast tables."""

import numpy as np
import pytest

from weekcast.operators import smoothing as sm
from weekcast.operators import windows as w
from weekcast.operators.holt import holt, latest_holt
from weekcast.operators.segments import segment_series


def plain(y, weights, m, horizons):
    """Squared errors week by week, and forecasts by week and horizon."""
    alpha, beta, gamma, phi = weights
    level, trend = sum(y[:m]) / m, 0.0
    season = {k: y[k] - level for k in range(m)}
    errors, made = {}, {}
    for t in range(m - 1, len(y)):
        if t >= m:
            ahead = level + phi * trend
            e = y[t] - ahead - season[t - m]
            errors[t] = e * e
            level, trend = ahead + alpha * e, phi * trend + alpha * beta * e
            season[t] = season[t - m] + gamma * (1 - alpha) * e
        made[t] = [level + sum(phi**k for k in range(1, h + 1)) * trend + season[t - m + h] for h in horizons]
    return errors, made


def series(n=61, m=7, count=5):
    rng = np.random.default_rng(2)
    t = np.arange(n)
    return np.array([50 + 3 * k + 0.3 * k * t + (4 + k) * np.sin(2 * np.pi * t / m + k) + rng.normal(0, 1 + k, n) for k in range(count)])


def test_like_a_plain_loop():
    y, m, horizons = series(), 7, (1, 3, 7)
    weights = np.array([[[0.3, 0.1, 0.2, 0.95], [1.0, 0.0, 0.5, 1.0]]] * len(y))
    sse, made = sm.smooth(y, weights, m, y.shape[1], horizons, m - 1)
    for s in range(len(y)):
        for c in range(2):
            errors, want = plain(y[s].tolist(), weights[s, c], m, horizons)
            assert sse[s, c] == pytest.approx(sum(errors.values()))
            assert made[s, c] == pytest.approx(np.array([want[t] for t in range(m - 1, len(y[s]))]))


@pytest.mark.parametrize("damped", (True, False))
def test_fits_are_never_worse_than_the_grid(damped):
    y, m = series(), 7
    for upto in (20, 61):
        chosen = sm.fit(y, m, upto, damped)
        own = sm.smooth(y, chosen[:, None, :], m, upto)[0][:, 0]
        grid = np.array([g for g in sm.GRID if damped or g[3] == 1.0])
        best = sm.smooth(y, np.broadcast_to(grid, (len(y), *grid.shape)), m, upto)[0].min(axis=1)
        assert (own <= best).all() and (own < best * 0.999).any()
        assert (chosen >= sm.LOW).all() and (chosen <= sm.HIGH).all() and (damped or (chosen[:, 3] == 1).all())


def test_no_forecast_knows_a_later_week():
    y, m = series(), 7
    whole = sm.forecasts(y, m, [1, 2], 5, True, None)
    for t in (3, 6, 7, 20, 33):
        changed = y.copy()
        changed[:, t + 1 :] += 1000
        assert np.array_equal(sm.forecasts(changed, m, [1, 2], 5, True, None)[:, : t + 1], whole[:, : t + 1])
    assert np.array_equal(whole[:, : m - 1, 0], y[:, : m - 1])


def test_backtest_and_latest_forecast(make_panel):
    y = series(n=40, m=7, count=3)
    panel = make_panel({f"s{k}": y[k] for k in range(3)} | {"short": list(y[0][:5]) + [None] * 0})
    segments, given = segment_series(panel), (0.3, 0.1, 0.2, 0.95)
    settings = {"seasonal": "add", "seasonal_periods": 7, "weights": given}
    windows = w.rolling_windows(panel.where("series_id <> 'short'"), w.Backtest(1, 2, 20, 3, None))
    want = {f"s{k}": plain(y[k].tolist(), given, 7, (1, 2))[1] for k in range(3)}
    first = panel.agg({"week_start": "min"}).first()[0]
    for alignment in ("target", "reference"):
        made = holt(panel.where("series_id <> 'short'"), segments, windows, (1, 2), alignment, **settings).collect()
        assert len(made) > 20
        for r in made:
            at = (r["forecast_origin"] - first).days // 7 - (r["horizon"] if alignment == "reference" else 0)
            assert r["prediction"] == pytest.approx(want[r["series_id"]][at][r["horizon"] - 1])
    last = latest_holt(panel.where("series_id <> 'short'"), segments, (1, 2), seasonal="add", seasonal_periods=7, weights=given).collect()
    assert {(r["series_id"], r["horizon"]): r["prediction"] for r in last} == pytest.approx({(s, h): want[s][39][h - 1] for s in want for h in (1, 2)})
    short = latest_holt(panel.where("series_id = 'short'"), segments, (1, 2), seasonal="add", seasonal_periods=7).collect()
    assert {r["prediction"] for r in short} == {y[0][4]}
    with pytest.raises(ValueError):
        latest_holt(panel, segments, (1, 2), seasonal="mul")
