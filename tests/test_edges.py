"""Small hand-made panels for the corners of the operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.functions import hashing
from weekcast.operators import audit as a
from weekcast.operators import charts as c
from weekcast.operators import evaluate as ev
from weekcast.operators import features as f
from weekcast.operators import panel as p
from weekcast.operators import ranking as rk
from weekcast.operators import scenarios as sc
from weekcast.operators.segments import segment_series
from weekcast.sources.sinks import complete_runs, read_run, write_table, write_tables


def by_series(df):
    return {r.series_id: r for r in df.collect()}


def test_densify_fills_leading_inner_and_trailing_gaps(make_panel):
    sparse = make_panel({"a": {0: 1, 3: 4}, "b": {2: 7}, "c": {5: 9}})
    dense = p.densify(sparse)
    for name, want in {
        "a": [1, 0, 0, 4, 0, 0],
        "b": [0, 0, 7, 0, 0, 0],
        "c": [0, 0, 0, 0, 0, 9],
    }.items():
        got = dense.where(F.col("series_id") == name).orderBy("week_start").collect()
        assert [r.sales_units for r in got] == want
        assert {r.category for r in got} == {name}
    assert p.check_panel(dense).count() == 0


def test_densify_needs_no_join_or_cross_product(make_panel):
    plan = p.densify(make_panel({"a": {0: 1, 3: 4}}))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_weekly_sales_joins_items_once_summed(spark):
    from weekcast.sources.star import star_raw

    raw = star_raw(spark, "/root/testdata/sf0.001")
    made = p.weekly_sales(raw.sales, raw.items, "category")
    want = raw.sales.join(raw.items, "item_id").agg(F.sum("units").cast("double")).first()[0]
    assert made.agg(F.sum("sales_units")).first()[0] == pytest.approx(want)
    with pytest.raises(ValueError, match="level must be"):
        p.weekly_sales(raw.sales, raw.items, "store")


def test_contract_raises(make_panel):
    panel = make_panel({"a": [1, 2]})
    with pytest.raises(ValueError, match="lacks columns"):
        p.check_panel(panel.drop("category"))
    with pytest.raises(ValueError, match="must be a date"):
        p.check_panel(panel.withColumn("week_start", F.col("week_start").cast("string")))
    with pytest.raises(ValueError, match="duplicate_key"):
        p.require_panel(panel.unionByName(panel))
    assert p.require_panel(panel) is panel


def test_segments(make_panel):
    panel = make_panel(
        {
            "short": [5] * 25,
            "sparse": [0, 0, 0, 9] * 10,
            "steady": [100, 101] * 30,
            "noisy": [10, 100, 40] * 20,
            "zero": [0] * 60,
        }
    )
    made = by_series(segment_series(panel))
    labels = {k: v.segment_label for k, v in made.items()}
    assert labels == {
        "short": "problematic",
        "sparse": "intermittent",
        "steady": "stable",
        "noisy": "medium_noise",
        "zero": "intermittent",
    }
    assert made["zero"].high_variance and made["short"].short_history
    assert not made["noisy"].short_history


def test_summary_corners(make_panel):
    panel = make_panel(
        {"flat": [3] * 10, "one": [4], "spike": [1] * 30 + [1000], "line": list(range(20))}
    )
    made = by_series(a.series_summary(panel))
    assert made["flat"].outlier_share == 0 and made["flat"].trend_strength == 0
    assert made["one"].trend_strength == 0 and made["one"].outlier_share == 0
    assert made["spike"].outlier_share == pytest.approx(1 / 31)
    y = np.arange(20.0)
    assert made["line"].trend_strength == pytest.approx(20 / y.std())


def test_summary_counts_gaps(make_panel):
    r = a.series_summary(make_panel({"g": {0: 1, 1: None, 4: 3}})).first()
    assert (r.history_weeks, r.expected_weeks) == (3, 5)
    assert r.grid_coverage == pytest.approx(0.6) and not r.weekly_grid_complete
    assert r.missing_share == pytest.approx(1 / 3)


def test_autocorrelation_corners(make_panel):
    made = by_series(
        a.autocorrelations(
            make_panel({"flat": [2] * 60, "short": [1, 2, 3], "wave": [1, 2, 3, 4] * 20})
        )
    )
    assert made["flat"].acf_lag_1 == 0.0
    assert made["short"].acf_lag_4 is None
    assert made["wave"].acf_lag_4 == pytest.approx(1.0)


def test_rolling_needs_a_full_window(make_panel):
    panel = make_panel({"a": [1, 2, 3, 4, 5, None, 7, 8, 9, 10, 11]})
    made = panel.withColumns(f.rolling_columns(f.series_order(), (4,))).orderBy("week_start").collect()
    means = [r.rolling_4_mean for r in made]
    assert means[:4] == [None] * 4 and means[4] == 2.5
    assert means[6:10] == [None] * 4 and means[10] == 8.5


def test_features_do_not_leak(make_panel):
    """A changed week leaves every feature up to and including that week alone."""
    rng = np.random.default_rng(1)
    base = {s: list(rng.integers(1, 50, 80)) for s in ("a", "b")}
    changed = {**base, "a": base["a"][:60] + [10_000.0] * 20}
    tables = []
    for series in (base, changed):
        panel = make_panel(series)
        segments = segment_series(make_panel(base))
        table = f.supervised(panel, segments, horizons=())
        cut = datetime.date(2020, 1, 6) + datetime.timedelta(weeks=60)
        names = f.feature_names(panel.columns, f.Features())
        tables.append(
            table.where(F.col("week_start") <= cut)
            .orderBy("series_id", "week_start")
            .select("series_id", "week_start", *names)
            .collect()
        )
    assert tables[0] == tables[1]


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(4000), rng.integers(0, 900, 6000)]).astype(float)
    groups = rng.integers(0, 3, len(values))
    df = spark.createDataFrame(
        [(f"g{g}", float(v)) for g, v in zip(groups, values)], "g string, v double"
    )
    made = rk.exact_quantiles(df, "v", ["g"], {"lo": 0.1, "mid": 0.5, "hi": 0.93})
    for r in made.collect():
        own = values[groups == int(r.g[1:])]
        assert [r.lo, r.mid, r.hi] == pytest.approx(np.quantile(own, [0.1, 0.5, 0.93]))


def test_running_over_many_ranges(spark):
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("v")
    )
    made = rk.running(df.repartition(16), [F.desc("v"), F.asc("id")], sums=["v"])
    got = made.orderBy("position").collect()
    want = sorted(((7 if i % 3 == 0 else i % 1000, i) for i in range(20_000)), key=lambda t: (-t[0], t[1]))
    assert [(r.v, r.id) for r in got] == want
    assert [r.position for r in got] == list(range(1, 20_001))
    assert [r.cum_v for r in got] == list(np.cumsum([v for v, _ in want]))
    assert got[0].total_v == got[-1].cum_v and got[0].total_rows == 20_000


def test_hash_matches_plain_integers(spark):
    numbers = [0, 1, 12345, 2**32 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "x bigint")
    got = [r.m for r in df.select(hashing.mix(F.col("x")).alias("m")).collect()]
    assert got == [hashing.mix_int(n) for n in numbers]


def test_hash_draws_look_multinomial(spark):
    """Counts of n draws from n blocks have variance about 1 − 1/n, as independent draws do."""
    n, reps = 500, 40
    df = spark.range(n).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    picks = df.select("rep", (hashing.draw63(42, "rep", "id") % n).alias("b"))
    counts = np.zeros((reps, n))
    for r in picks.groupBy("rep", "b").count().collect():
        counts[r.rep, r.b] = r["count"]
    assert counts.sum() == n * reps
    assert counts.var() == pytest.approx(1 - 1 / n, rel=0.05)
    assert abs(np.corrcoef(counts[0], counts[1])[0, 1]) < 0.2


def test_metric_corners(spark):
    rows = [("z", 0.0, 0.0), ("z", 0.0, 0.0), ("n", 0.0, 5.0), (None, 1.0, 2.0)]
    table = spark.createDataFrame(rows, "model_name string, actual double, prediction double")
    made = {r.model_name: r for r in ev.metrics(table).collect()}
    assert set(made) == {"z", "n"}
    assert made["z"].WAPE is None and made["z"].sMAPE == 0.0
    assert made["n"].sMAPE == 200.0 and made["n"].WAPE is None


def test_no_lag_unit_root_on_a_constant_series(make_panel):
    from weekcast.operators import seasonality as se

    panel = make_panel({"flat": [4] * 30, "noise": [1, 5, 2, 8, 3, 9] * 5})
    made = by_series(se.adf_no_lags(panel))
    assert made["flat"].adf_stat is None and made["noise"].adf_stat < 0
    assert by_series(se.kpss(panel))["flat"].kpss_stat is None
    assert {r.series_id for r in se.acf(panel).collect()} == {"noise"}


def test_error_cases_without_baseline(spark):
    table = spark.createDataFrame(
        [("m", "s", "c", "stable", datetime.date(2020, 1, 6), datetime.date(2020, 1, 13), 1, 1.0, 2.0)],
        """model_name string, series_id string, category string, segment_label string,
           forecast_origin date, target_date date, horizon int, actual double, prediction double""",
    )
    assert ev.error_cases(table).count() == 0


def test_concentration(make_panel):
    panel = make_panel({"a": [1, 2], "b": [3, 3], "c": [3, 3], "d": [0, 0]})
    made = {r.metric: r.value for r in a.concentration(panel).collect()}
    x = np.sort(np.array([3.0, 6, 6, 0])) / 15
    n = len(x)
    gini = 2 * (np.arange(1, n + 1) * x).sum() / n - (n + 1) / n
    assert made["gini_sales_concentration"] == pytest.approx(gini)
    assert made["hhi_sales_concentration"] == pytest.approx((x**2).sum())
    assert made["top_1_sales_share"] == pytest.approx(0.4)
    assert "top_5_sales_share" not in made and made["sku_count"] == 4


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("m", float(v)) for v in range(11)] + [("k", 2.0)], "measure string, value double")
    made = {(r.measure, r.bin): r for r in c.histogram(df, 5).collect()}
    counts, edges = np.histogram(np.arange(11.0), bins=5)
    assert [made["m", b]["count"] for b in range(1, 6)] == list(counts)
    assert made["m", 5].bin_end == pytest.approx(edges[-1])
    flat, _ = np.histogram([2.0], bins=5)
    assert [made["k", b]["count"] for b in range(1, 6)] == list(flat)


def test_scenario_checks(make_panel):
    panel = make_panel({"a": [1, 2]}).withColumn("is_history", F.lit(True))
    with pytest.raises(ValueError, match="lacks columns"):
        sc.prepare_scenarios(panel.drop("is_history"))
    with pytest.raises(ValueError, match="no scenario_name"):
        sc.prepare_scenarios(panel, "x")
    with pytest.raises(ValueError, match="no rows"):
        sc.prepare_scenarios(panel.withColumn("scenario_name", F.lit("y")), "x")
    assert sc.roll_up(panel).columns == ["category", "week_start", "is_history", "sales_units", "series_id"]


def test_writing_twice_fails(make_panel, tmp_path):
    panel = make_panel({"a": [1]})
    path = write_table(panel, str(tmp_path), "r1", "panel")
    assert panel.sparkSession.read.parquet(path).count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_table(panel, str(tmp_path), "r1", "panel")
    write_table(panel, str(tmp_path), "r2", "panel", fmt="csv")


def test_wide_csv_round_trip(spark, tmp_path):
    from weekcast.sources.raw import read_raw

    (tmp_path / "sales.csv").write_text(
        "item_id,dept_id,cat_id,store_id,state_id,d_1,d_2,d_3\n"
        "i1,dA,cA,s1,st,5,3,1\ni2,dA,cA,s1,st,0,2,0\n"
    )
    (tmp_path / "calendar.csv").write_text(
        "d,date,wm_yr_wk\nd_1,2011-01-29,1\nd_2,2011-01-30,1\nd_3,2011-01-31,1\nd_4,2011-02-01,1\n"
    )
    (tmp_path / "prices.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\ns1,i1,1,2.5\n")
    raw = read_raw(spark, *[str(tmp_path / f"{n}.csv") for n in ("sales", "calendar", "prices")])
    made = p.weekly_sales(raw.sales, raw.items, "category").orderBy("week_start").collect()
    assert [(str(r.week_start), r.sales_units) for r in made] == [
        ("2011-01-24", 10.0),
        ("2011-01-31", 1.0),
    ]
    assert raw.calendar.count() == 3
    days = {str(r.week_start): r.day_count for r in p.day_counts(raw.calendar).collect()}
    assert days == {"2011-01-24": 2, "2011-01-31": 1}


def test_only_complete_runs_are_read(spark, make_panel, tmp_path):
    panel, root = make_panel({"a": [1, 2, 3]}), str(tmp_path)
    assert complete_runs(spark, root).count() == 0
    broken = panel.withColumn("bad", F.assert_true(F.col("sales_units") < 3))
    with pytest.raises(Exception, match="sales_units"):
        write_tables({"first": panel, "second": broken}, root, "2026-01-05")
    with pytest.raises(ValueError, match="no complete run"):
        read_run(spark, root, "2026-01-05")
    empty = panel.where("sales_units > 9")
    write_tables({"first": panel, "none": empty}, root, "2026-01-06")
    runs = sorted(tuple(r) for r in complete_runs(spark, root).collect())
    assert runs == [("2026-01-06", "first", 3), ("2026-01-06", "none", 0)]
    tables = read_run(spark, root, "2026-01-06")
    assert tables["first"].count() == 3 and tables["none"].columns == panel.columns
    with pytest.raises(ValueError, match="manifest"):
        write_tables({"manifest": panel}, root, "2026-01-07")
