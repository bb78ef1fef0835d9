"""Counted predictions stand for the rows of the baselines; summaries read no zero weeks."""

import pytest
from pyspark.sql import functions as F

from weekcast.operators import audit as a
from weekcast.operators import evaluate as ev
from weekcast.operators import panel as p
from weekcast.operators.baselines import baseline_counts, baselines
from weekcast.operators.segments import labelled, segment_series
from weekcast.operators.windows import Backtest, rolling_windows

SHORT = Backtest(min_train_weeks=2, horizon_max=3)


@pytest.fixture()
def sparse(make_panel):
    series = {
        "a": {0: 2.5, 30: 7.0, 58: -1.0, 69: 4.0},
        "b": {k: float(k * k % 7) for k in range(0, 70, 2)},
        "c": {k: 0.1 * k for k in range(70)},
        "d": {3: 7.0},
        None: {5: 2.0, 61: 3.0},
    }
    return make_panel(series, "x")


def rows(df):
    near = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(near(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("alignment", ["reference", "target"])
@pytest.mark.parametrize("backtest", [SHORT, Backtest(min_train_weeks=1, horizon_max=8)])
def test_counts_stand_for_rows(sparse, alignment, backtest):
    histories, windows = p.dense_histories(sparse), rolling_windows(sparse, backtest)
    plain = baselines(p.densify(sparse), segment_series(histories), windows, alignment=alignment)
    by = ["segment_label", "horizon", "category"]
    counts = baseline_counts(labelled(histories), windows, by, alignment=alignment)
    cells = ["model_name", *by, "actual", "prediction"]
    merged = counts.groupBy(*cells).agg(F.sum("rows").alias("rows"))
    assert rows(merged) == rows(plain.groupBy(*cells).agg(F.count(F.lit(1)).alias("rows")))
    for names in (ev.METRICS, ev.METRICS[:-1]):
        assert rows(ev.metrics(counts, ["model_name", "segment_label"], names)) == rows(ev.metrics(plain, ["model_name", "segment_label"], names))
    assert rows(ev.metrics_by_cuts(counts)) == rows(ev.metrics_by_cuts(plain))


def test_batches_and_parts(spark, sparse, monkeypatch):
    windows = rolling_windows(sparse, SHORT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        counts = baseline_counts(labelled(p.dense_histories(sparse).coalesce(1)), windows, ["segment_label"])
        found = counts.groupBy("model_name", "segment_label").agg(F.sum("rows").alias("n"))
        plain = baselines(p.densify(sparse), segment_series(p.densify(sparse)), windows)
        assert rows(found) == rows(plain.groupBy("model_name", "segment_label").agg(F.count(F.lit(1)).alias("n")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(sparse):
    none = labelled(p.dense_histories(sparse.where("false")))
    assert baseline_counts(none, rolling_windows(sparse, SHORT)).count() == 0


def test_summary_with_negative_units(make_panel):
    sparse = make_panel({"a": {0: -3.0, 1: 4.0, 9: 1.0}, "b": {k: -1.0 - k for k in range(10)}, "c": {2: 8.0}, "d": {k: 0.1 for k in range(10)}})
    assert rows(a.series_summary(p.dense_histories(sparse))) == rows(a.series_summary(p.densify(sparse)))


def test_no_rows_per_prediction(spark):
    from catalog.all import REGISTRY

    sf = "/root/testdata/sf0.001"
    for name in ("h5_metrics_all_cuts", "h6_metrics_by_segment", "h14_best_per_segment", "v11_wape_segment_model"):
        plan = REGISTRY.queries[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "target_h1" not in plan and "sequence(_start" not in plan, name
    plan = REGISTRY.queries["e1_series_summary_sku"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" not in plan


def test_dense_rows_of_some_series(sparse):
    some = sparse.where("series_id in ('a', 'd')")
    assert rows(p.densify(some, period=sparse)) == rows(p.densify(sparse).where("series_id in ('a', 'd')"))


def test_snapshot_makes_few_series_dense(spark):
    from catalog.all import REGISTRY

    plan = REGISTRY.queries["c16_feature_snapshot"](spark, "/root/testdata/sf0.001")
    lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [x for i, x in enumerate(lines) if any("Generate explode(sequence(_start" in y for y in lines[:i])]
    assert any("Join LeftSemi" in x for x in below[:12])


def test_repeated_weeks_are_refused(make_panel):
    twice = make_panel({"a": {0: 1.0, 3: 2.0}})
    with pytest.raises(Exception, match="repeats"):
        a.series_summary(p.dense_histories(twice.unionByName(twice))).collect()
