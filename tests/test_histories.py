"""One row per series gives what the dense rows give, without sorting or grouping dense rows."""

import pytest

from weekcast.operators import audit as a
from weekcast.operators import panel as p
from weekcast.operators import seasonality as se
from weekcast.operators.features import example_series
from weekcast.operators.segments import segment_series


@pytest.fixture()
def sparse(spark, make_panel):
    series = {
        "a": {3: 2.0, 4: 7.0, 20: 1.5, 69: 4.0},
        "b": {0: 3.0},
        "c": {k: 5.0 for k in range(70)},
        "d": {k: float(k * k % 11) for k in range(0, 70, 2)},
        "e": {11: None, 40: 0.0},
    }
    lost = spark.createDataFrame([("a", "a", None, 9.0)], "series_id string, category string, week_start date, sales_units double")
    return make_panel(series).unionByName(lost)


def rows(df):
    near = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(near(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_like_the_dense_rows(sparse):
    dense, histories = p.densify(sparse), p.dense_histories(sparse)
    lengths = {r["series_id"]: len(r["y"]) for r in histories.collect()}
    assert lengths == {r["series_id"]: r["count"] for r in dense.groupBy("series_id").count().collect()}
    for made in (a.series_summary, segment_series, a.autocorrelations, se.adf_no_lags, se.adf, example_series):
        assert rows(made(histories)) == rows(made(dense)), made.__name__
    found = p.check_histories(histories)
    assert rows(found) == rows(p.check_panel(dense)) and found.count() == 1  # the null week repeats weeks


def test_off_grid_weeks_are_no_mondays(spark):
    table = [("a", "a", d, 1.0) for d in ("2020-01-07", "2020-01-21")]
    df = spark.createDataFrame(table, "series_id string, category string, week_start string, sales_units double")
    df = df.withColumn("week_start", df["week_start"].cast("date"))
    assert rows(p.check_histories(p.dense_histories(df))) == rows(p.check_panel(p.densify(df))) != []


def test_empty(sparse):
    none = p.dense_histories(sparse.where("false"))
    assert none.count() == 0 and p.check_histories(none).count() == 0 and a.series_summary(none).count() == 0


def test_dense_rows_are_not_sorted(spark):
    from catalog.all import REGISTRY

    for name in ("e1_series_summary_sku", "e12_autocorrelation_sku", "e19_adf_no_lags", "a3_panel_ok"):
        plan = REGISTRY.queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Window")] if "Window" in plan else plan
        assert plan.count("Window [") == 1 and ("Generate" not in plan or "Generate" in above), name
