"""Boosted trees against a plain grower, and the bootstrap against its definition."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.functions import hashing
from weekcast.operators import bootstrap as bs
from weekcast.operators import trees as t

FIRST = datetime.date(2021, 1, 4)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = []
    for s in range(5):
        for k in range(90):
            x = [float(rng.randrange(12)), rng.choice((0.0, 1.0)), rng.uniform(-3, 3)]
            y = 30 + 5 * (x[0] > 6) * x[1] - 4 * x[2] + rng.uniform(0, 2)
            x[2] = None if rng.random() < 0.03 else x[2]
            rows.append((f"s{s}", "cat", "smooth", FIRST + datetime.timedelta(weeks=k), *x, y if k < 89 else None, 2 * y if k < 88 else None))
    names = "series_id string, category string, segment_label string, week_start date, a double, b double, c double, target_h1 double, target_h2 double"
    return spark.createDataFrame(rows, names).repartition(4).cache()


def grown(rows, cuts, s, loss):
    """rows: (features, y). A function from features to a prediction, grown row by row."""
    bins = lambda x: [sum(v > c for c in own) for v, own in zip(x, cuts)]
    data = [(bins(x), y) for x, y in rows]
    base = sum(y for _, y in data) / len(data)
    forest = []

    def at(x, tree):
        while "feature" in tree:
            tree = tree["right"] if x[tree["feature"]] > tree["bin"] else tree["left"]
        return tree["value"]

    def build(some, depth, scale):
        total, n = sum(g for _, g in some), len(some)
        best = []
        for f in range(len(cuts)):
            for b in range(s.maxBins):
                left = [g for x, g in some if x[f] <= b]
                if len(left) >= s.minInstancesPerNode and n - len(left) >= s.minInstancesPerNode:
                    r = total - sum(left)
                    best.append((sum(left) ** 2 / len(left) + r**2 / (n - len(left)) - total**2 / n, f, b))
        most = max((g for g, _, _ in best), default=0)
        if depth == s.maxDepth or most <= 1e-9 * max(1, total**2 / max(n, 1)):
            return {"value": s.stepSize * scale * total / max(n, 1)}
        _, f, b = next(x for x in best if x[0] >= most * (1 - 1e-9))
        return {
            "feature": f, "bin": b,
            "left": build([x for x in some if x[0][f] <= b], depth + 1, scale),
            "right": build([x for x in some if x[0][f] > b], depth + 1, scale),
        }

    for _ in range(s.maxIter):
        res = [(x, y - base - sum(at(x, tr) for tr in forest)) for x, y in data]
        scale = sum(abs(r) for _, r in res) / len(res) if loss == "absolute" else 1
        forest.append(build([(x, np.sign(r) if loss == "absolute" else r) for x, r in res], 0, scale))
    return lambda x: base + sum(at(bins(x), tr) for tr in forest)


@pytest.mark.parametrize("model", sorted(t.LOSSES))
@pytest.mark.parametrize("block", (8192, 40))
def test_windows_grow_like_single_fits(spark, table, monkeypatch, model, block):
    monkeypatch.setattr(t, "BLOCK", block)
    s = t.Settings(maxIter=3, stepSize=0.4, maxDepth=3, maxBins=8, minInstancesPerNode=7)
    weeks = lambda k: FIRST + datetime.timedelta(weeks=k)
    wanted = [(h, weeks(k - h), weeks(k)) for k in (40, 55, 86) for h in (1, 2)]
    windows = spark.createDataFrame(wanted, "horizon int, train_end date, forecast_origin date")
    got = t.trees(table, windows, NAMES, model, maxIter=3, stepSize=0.4, maxDepth=3, maxBins=8, minInstancesPerNode=7).collect()
    rows = [r for r in table.collect() if r["c"] is not None]
    cuts = t.cut_points(table.dropna(subset=NAMES).where(F.col("week_start") <= F.lit(weeks(38))), NAMES, 8)
    assert len(cuts[1]) <= 2 and 5 <= len(cuts[0]) <= 7
    made = {}
    for h, end, origin in wanted:
        y = f"target_h{h}"
        told = grown([([r[c] for c in NAMES], r[y]) for r in rows if r["week_start"] <= end and r[y] is not None], cuts, s, t.LOSSES[model])
        made |= {(r["series_id"], h, origin): (told([r[c] for c in NAMES]), r[y]) for r in rows if r["week_start"] == origin}
    assert {(r["series_id"], r["horizon"], r["forecast_origin"]) for r in got} == set(made)
    for r in got:
        want, actual = made[r["series_id"], r["horizon"], r["forecast_origin"]]
        assert r["prediction"] == pytest.approx(want, abs=1e-9) and r["actual"] == actual
    assert len({round(x, 6) for x, _ in made.values()}) > 10


def test_saved_trees_forecast_like_a_fit(spark, table, tmp_path):
    params = {"maxIter": 3, "maxDepth": 2, "maxBins": 8}
    saved = t.fit_trees(table, NAMES, (1, 2), "gbt_squared", str(tmp_path), **params)
    got = {(r["series_id"], r["horizon"]): r["prediction"] for r in t.score_trees(table, NAMES, "gbt_squared", saved).collect()}
    s = t.Settings(**params)
    rows = [r for r in table.collect() if r["c"] is not None]
    last = max(r["week_start"] for r in rows)
    end = FIRST + datetime.timedelta(weeks=87)
    cuts = t.cut_points(table.dropna(subset=NAMES).where(F.col("week_start") <= F.lit(end)), NAMES, 8)
    for h in (1, 2):
        told = grown([([r[c] for c in NAMES], r[f"target_h{h}"]) for r in rows if r[f"target_h{h}"] is not None], cuts, s, "squared")
        for r in rows:
            if r["week_start"] == last:
                assert got[r["series_id"], h] == pytest.approx(told([r[c] for c in NAMES]), abs=1e-9)


# ---- bootstrap


def test_hash_is_the_same_in_arrays(spark):
    index = [0, 1, 5, 2**32 - 1, 2**32, 2**40 + 17, 2**62 + 3]
    rows = spark.createDataFrame([(r, i) for r in (0, 7, 299) for i in index], "rep bigint, i bigint")
    for seed in (42, 43):
        for x in rows.withColumn("u", hashing.draw63(seed, "rep", "i")).collect():
            assert x["u"] == int(hashing.draw63_array(seed, x["rep"], np.array([x["i"]]))[0])


@pytest.mark.parametrize("n", (0, 1, 7, 1000, 1001, 13_512, 123_457))
def test_segments_cover_all_blocks(n):
    parts, at, cells = bs.segments(n), 0, 0
    for p in parts:
        assert p.first == at and p.base == cells and 0 < p.size <= bs.CELL
        at, cells = at + (p.size << p.depth), cells + (1 << p.depth)
    assert at == n


def test_draws_split_like_a_multinomial():
    """Every replicate draws as many blocks as there are; a cell's counts have the mean and the
    variance of a binomial number, and neighbours are as correlated as they should be."""
    n, reps = 1037, 4000
    parts = bs.segments(n, 100)
    assert len(parts) == 2 and parts[0].depth == 4
    counts = np.array([np.concatenate([c for _, c in bs.cell_counts(5, rep, parts)]) for rep in range(reps)])
    sizes = np.concatenate([[p.size] * (1 << p.depth) for p in parts])
    assert (counts.sum(axis=1) == n).all() and counts.shape[1] == len(sizes)
    share = sizes / n
    spread = np.sqrt(n * share * (1 - share))
    assert (np.abs(counts.mean(axis=0) - sizes) < 5 * spread / np.sqrt(reps)).all()
    assert np.allclose(counts.var(axis=0) / spread**2, 1, atol=0.15)
    cov = np.cov(counts.T)
    want = -n * np.outer(share, share)
    off = ~np.eye(len(sizes), dtype=bool)
    assert np.abs(cov - want)[off].max() < 6


@pytest.mark.parametrize("share", ((1, 2), (3, 7), (1, 1000), (999, 1000), (0, 5)))
def test_binomial(share):
    n, p = 500, share[0] / share[1]
    got = np.array([bs.binomial(3, rep, 1, n, share) for rep in range(2000)])
    assert abs(got.mean() - n * p) <= 5 * np.sqrt(n * p * (1 - p) / 2000)
    assert got.var() == pytest.approx(n * p * (1 - p), rel=0.15)


def test_many_random_bits_at_once():
    """More words than are hashed at a time give what single counts give."""
    nodes, counts = np.arange(1, 4), np.array([0, 62 * (1 << 20) + 70, 5])
    ones = bs._ones(1, 2, 0, 0, nodes, counts)
    assert ones[0] == 0 and ones[2] == bs._ones(1, 2, 0, 0, nodes[2:], counts[2:])[0]
    assert abs(ones[1] - counts[1] / 2) < 5 * np.sqrt(counts[1]) / 2


@pytest.mark.parametrize("method", ("multinomial", "poisson"))
def test_replicates_by_hand(spark, method):
    """Medians and sums of every replicate, from weights spelled out block by block."""
    rng = random.Random(9)
    day = lambda k: datetime.date(2022, 1, 3) + datetime.timedelta(weeks=k)
    rows = []
    for s in range(9):
        for k in range(11):
            y = float(rng.randrange(1, 60))
            rows += [(m, f"s{s}", day(k), 1, y, y + rng.choice((0, 0, 1, -7, 2.5, 1e-9, 40))) for m in ("m1", "m2", "m3") if (s, k, m) != (3, 4, "m2")]
    df = spark.createDataFrame(rows, "model_name string, series_id string, forecast_origin date, horizon int, actual double, prediction double")
    reps, seed, cell = 25, 11, 20
    cells = [r.asDict(recursive=True) for r in bs.packed_cells(df, reps, seed, method, cell).collect()]
    assert len(cells) == len({(c["part"], c["local"]) for c in cells}) > 4
    keys = sorted({(r[1], r[2], r[3]) for r in rows})
    drawn = [Counter() for _ in range(reps)]
    for c in cells:
        for rep, own in zip(*bs.weights(c, seed, method)):
            drawn[rep].update({keys[c["first"] + k]: int(w) for k, w in enumerate(own)})
    if method == "multinomial":
        assert all(sum(d.values()) == len(keys) for d in drawn)
    want = {}
    for rep, d in enumerate(drawn):
        for m in ("m1", "m2", "m3"):
            want[rep, m] = np.median([abs(r[5] - r[4]) for r in rows if r[0] == m for _ in range(d[r[1:4]])])
    got = bs._medians(bs.packed_cells(df, reps, seed, method, cell), reps, seed, method).collect()
    assert {(r["rep"], r["model_name"]): r["value"] for r in got} == pytest.approx(want, abs=0)
    sums = bs._summed(bs.packed_cells(df, reps, seed, method, cell), seed, method).groupBy("rep", "model_name").agg(F.sum("abs_error").alias("e")).collect()
    for r in sums:
        assert r["e"] == pytest.approx(sum(abs(x[5] - x[4]) * drawn[r["rep"]][x[1:4]] for x in rows if x[0] == r["model_name"]))


def test_no_predictions(spark):
    names = "model_name string, series_id string, forecast_origin date, horizon int, actual double, prediction double"
    for metric in ("WAPE", "MedianAE"):
        assert bs.bootstrap_ci(spark.createDataFrame([], names), metric, 5).count() == 0
