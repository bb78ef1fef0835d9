"""Pooled boosted trees: the trees of all windows grow together, level by level.

Features are binned once, at quantiles of the weeks that every window trains on, and the rows are
packed into blocks of bytes. A pass over the blocks adds up, for every window, node and feature, the
gradients and rows of each bin; the sums of a window and node meet in one place, which picks the
split. So a level of one tree costs one pass and one exchange of sums, for all windows at once, and
the driver sees one row per window and node. Predictions so far are worked out from the trees in
each pass, so no state of rows times windows is ever kept.

``gbt_squared`` fits residuals. ``gbt_absolute`` fits their signs, and a leaf moves by its mean sign
times the window's mean absolute residual. Both start from the mean. Rows lacking a feature or the
target take no part. Splits whose gains are equal up to rounding go to the first feature and bin.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions.columns import plus_weeks
from weekcast.session import cut_lineage

# Model names and the loss each one minimises.
LOSSES = {"gbt_squared": "squared", "gbt_absolute": "absolute"}
#: Rows of a block, and gains that count as equal.
BLOCK, SAME = 8192, 1e-9
_EPOCH = datetime.date(1970, 1, 1)


@dataclass(frozen=True)
class Settings:
    maxIter: int = 300
    stepSize: float = 0.05
    maxDepth: int = 6
    maxBins: int = 32
    minInstancesPerNode: int = 20


@dataclass(frozen=True)
class Forest:
    """Trees of all windows. Nodes lie in heap order; a row goes right where its bin is above the
    node's; nodes without a split send all rows left."""

    horizon: np.ndarray
    train_end: np.ndarray  # days; rows of later weeks are no training rows
    base: np.ndarray
    feature: np.ndarray  # window, tree, node
    bin: np.ndarray
    value: np.ndarray  # window, tree, leaf

    @property
    def depth(self) -> int:
        return int(self.value.shape[2]).bit_length() - 1

    def leaves(self, w: int, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where rows stand after some levels, counted from the left."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[w, tree][node]
            node = 2 * node + 1 + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > self.bin[w, tree][node]))
        return node - ((1 << levels) - 1)

    def predict(self, w: int, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        made = np.full(len(bins), self.base[w])
        for t in range(self.value.shape[1] if trees is None else trees):
            made += self.value[w, t][self.leaves(w, t, bins, self.depth)]
        return made


def days(d) -> int:
    return (d - _EPOCH).days


def cut_points(table: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Inner bin borders per feature: quantiles, each distinct value once."""
    shares = [k / max_bins for k in range(1, max_bins)]
    row = table.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"c{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(x or [], float)) for x in row]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _matrix(t: pa.Table | pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Rows of numbers; a null is NaN."""
    return np.stack([t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in names], axis=1).astype(np.float64)


def blocks_of(table: DataFrame, features: Sequence[str], horizons: Sequence[int], cuts: Sequence[np.ndarray], groups: int | None = None) -> DataFrame:
    """Rows packed by week: ``group, weeks, bins, targets``. Few blocks get several groups of
    windows, so that all cores have work."""
    spark = table.sparkSession
    names = [f"target_h{h}" for h in horizons]
    day = F.datediff(F.col("week_start"), F.lit("1970-01-01").cast("date")).alias("week")
    rows = table.select(
        day, *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)], *[F.col(c).cast("double").alias(c) for c in names]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def full(t: pa.Table) -> pa.RecordBatch:
            t = t.sort_by("week")
            x = _matrix(t, [f"x{k}" for k in range(len(features))])
            y = _matrix(t, names)
            there = ~np.isnan(x).any(axis=1)
            data = [t.column("week").to_numpy().astype(np.int64)[there], binned(x[there], cuts), y[there]]
            return pa.RecordBatch.from_arrays([pa.array([d.tobytes()]) for d in data], names=["weeks", "bins", "targets"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield full(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield full(pa.Table.from_batches(held))

    made = cut_lineage(rows.mapInArrow(pack, "weeks binary, bins binary, targets binary"))
    if groups is None:
        groups = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, made.count())))
    spread = made.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("groups", F.lit(groups))
    return cut_lineage(spread.repartition(max(groups, spark.sparkContext.defaultParallelism), "group", F.xxhash64("weeks", "bins")))


def _training_rows(row: dict, n_features: int, horizons: Sequence[int], forest: Forest) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Windows of a block's group, with the bins and targets of their training rows there."""
    weeks = np.frombuffer(row["weeks"], np.int64)
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features)
    targets = np.frombuffer(row["targets"], np.float64).reshape(len(weeks), -1)
    known = {h: np.flatnonzero(~np.isnan(targets[:, k])) for k, h in enumerate(horizons)}
    for w in range(row["group"], len(forest.base), row["groups"]):
        h = int(forest.horizon[w])
        some = known[h][: np.searchsorted(weeks[known[h]], forest.train_end[w], side="right")]
        if len(some):
            yield w, bins[some], targets[some, horizons.index(h)]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _start(blocks: DataFrame, n_features: int, horizons: Sequence[int], forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Rows and mean target of each window."""
    sent = blocks.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            found = [(w, float(len(y)), float(y.sum())) for w, _, y in _training_rows(row, n_features, horizons, sent.value)]
            w, n, s = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(n, pa.float64()), pa.array(s, pa.float64())], names=["w", "n", "s"])

    n, total = (np.zeros(len(forest.base)) for _ in range(2))
    for r in blocks.mapInArrow(run, "w int, n double, s double").groupBy("w").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        n[r["w"]], total[r["w"]] = r["n"], r["s"]
    return n, total / np.maximum(n, 1)


def _splits(blocks: DataFrame, n_features: int, horizons: Sequence[int], forest: Forest, tree: int, level: int, loss: str, s: Settings) -> pa.Table:
    """One row per window and node of a level: its best split and its sums."""
    sent = blocks.sparkSession.sparkContext.broadcast(forest)
    cells, size = n_features * s.maxBins, s.maxBins

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, nodes = sent.value, 1 << level
        for row in _each(batches):
            out: list[list] = [[], [], [], [], []]
            for w, bins, y in _training_rows(row, n_features, horizons, forest):
                residual = y - forest.predict(w, bins, tree)
                gradient = np.sign(residual) if loss == "absolute" else residual
                node = forest.leaves(w, tree, bins, level)
                at = (node[:, None] * n_features + np.arange(n_features)) * size + bins
                sums = np.bincount(at.ravel(), np.repeat(gradient, n_features), nodes * cells).reshape(nodes, cells)
                rows = np.bincount(at.ravel(), minlength=nodes * cells).astype(np.float64).reshape(nodes, cells)
                far = np.bincount(node, np.abs(residual), nodes)
                for k in np.flatnonzero(rows.any(axis=1)):
                    for c, v in zip(out, (w, k, far[k], sums[k].tobytes(), rows[k].tobytes())):
                        c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["w", "node", "far", "sums", "rows"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, far, sums, rows, made = None, 0.0, np.zeros(cells), np.zeros(cells), []
        for row in _each(batches):
            if (row["w"], row["node"]) != now:
                if now is not None:
                    made.append((*now, far, *best_split(sums, rows, n_features, s)))
                now, far, sums, rows = (row["w"], row["node"]), 0.0, np.zeros(cells), np.zeros(cells)
            far += row["far"]
            sums = sums + np.frombuffer(row["sums"], np.float64)
            rows = rows + np.frombuffer(row["rows"], np.float64)
        if now is not None:
            made.append((*now, far, *best_split(sums, rows, n_features, s)))
        names = ["w", "node", "far", "feature", "bin", "left", "n_left", "total", "n"]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        columns = list(zip(*made)) if made else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    parts = blocks.mapInArrow(added, "w int, node int, far double, sums binary, rows binary")
    met = parts.repartition("w", "node").sortWithinPartitions("w", "node")
    return met.mapInArrow(chosen, "w int, node int, far double, feature int, bin int, left double, n_left double, total double, n double").toArrow()


def best_split(sums: np.ndarray, rows: np.ndarray, n_features: int, s: Settings) -> tuple[int, int, float, float, float, float]:
    """Feature (-1: no split), bin, and the sums and rows on the left and of the node."""
    sums, rows = sums.reshape(n_features, -1), rows.reshape(n_features, -1)
    total, n = sums[0].sum(), rows[0].sum()
    left, n_left = sums.cumsum(axis=1), rows.cumsum(axis=1)
    fits = (n_left >= s.minInstancesPerNode) & (n - n_left >= s.minInstancesPerNode)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left**2 / n_left + (total - left) ** 2 / (n - n_left) - total**2 / n, -1.0)
    most = gain.max()
    if most <= SAME * max(1.0, total**2 / max(n, 1)):
        return -1, 0, float(total), float(n), float(total), float(n)
    f, b = np.unravel_index(int(np.argmax(gain >= most * (1 - SAME))), gain.shape)
    return int(f), int(b), float(left[f, b]), float(n_left[f, b]), float(total), float(n)


def grow(table: DataFrame, horizon: Sequence[int], train_end: Sequence[int], features: Sequence[str], model_name: str, s: Settings) -> tuple[Forest, list[np.ndarray]]:
    """The forest of windows (horizon, last training day) on ``table``, and the bin borders."""
    horizons = sorted(set(horizon))
    first = _EPOCH + datetime.timedelta(days=int(min(train_end)))
    cuts = cut_points(table.dropna(subset=list(features)).where(F.col("week_start") <= F.lit(first)), features, s.maxBins)
    blocks = blocks_of(table, features, horizons, cuts)
    w, nodes, f = len(horizon), (1 << s.maxDepth) - 1, len(features)
    forest = Forest(
        np.array(horizon),
        np.array(train_end),
        np.zeros(w),
        np.full((w, s.maxIter, nodes), -1, np.int16),
        np.zeros((w, s.maxIter, nodes), np.uint8),
        np.zeros((w, s.maxIter, nodes + 1)),
    )
    forest = replace(forest, base=_start(blocks, f, horizons, forest)[1])
    loss = LOSSES[model_name]
    for tree in range(s.maxIter):
        for level in range(s.maxDepth):
            found = _splits(blocks, f, horizons, forest, tree, level, loss, s)
            w, node, far, feature, at, left, n_left, total, n = (found.column(k).to_numpy() for k in range(found.num_columns))
            heap = (1 << level) - 1 + node
            forest.feature[w, tree, heap], forest.bin[w, tree, heap] = feature, at
            if level == 0:
                scale = np.ones(len(forest.base))
                scale[w] = far / np.maximum(n, 1) if loss == "absolute" else 1.0
        step = s.stepSize * scale[w]
        forest.value[w, tree, 2 * node] = step * left / np.maximum(n_left, 1)
        forest.value[w, tree, 2 * node + 1] = step * np.where(n > n_left, (total - left) / np.maximum(n - n_left, 1), 0.0)
    return forest, cuts


def _forecasts(rows: DataFrame, features: Sequence[str], model_name: str, forest: Forest, cuts: list[np.ndarray], origin: Sequence[int]) -> DataFrame:
    """Forecasts of windows from the rows of their origin's week."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((forest, cuts, np.array(origin, np.int64)))
    kept = ["series_id", "category", "segment_label", "week_start"]
    horizons = sorted({int(h) for h in forest.horizon})
    actual = [F.col(f"target_h{h}") if f"target_h{h}" in rows.columns else F.lit(None) for h in horizons]
    # Rows lacking a feature are left out in the task: a filter over so many columns, each under
    # a new name, keeps the optimiser busy for minutes.
    picked = rows.select(
        *kept, *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)], *[a.cast("double").alias(f"y{h}") for a, h in zip(actual, horizons)]
    )
    no_number = F.lit(None).cast("double")
    out = picked.select(*kept, F.lit(None).cast("int").alias("horizon"), no_number.alias("actual"), no_number.alias("prediction")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        forest, cuts, origin = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            week = np.array(batch.column("week_start").cast(pa.date32()).cast(pa.int32()))
            x = _matrix(batch, [f"x{k}" for k in range(len(features))])
            there, bins = ~np.isnan(x).any(axis=1), binned(x, cuts)
            for w in np.flatnonzero(np.isin(origin, np.unique(week[there]))):
                some = np.flatnonzero((week == origin[w]) & there)
                h = int(forest.horizon[w])
                at = pa.array(some)
                made = [batch.column(c).take(at) for c in kept]
                made += [pa.array(np.full(len(some), h), pa.int32()), batch.column(f"y{h}").take(at), pa.array(forest.predict(w, bins[some]))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow)], schema=arrow)

    return picked.mapInArrow(run, out).select(
        F.lit(model_name).alias("model_name"),
        F.lit("ml").alias("model_family"),
        "series_id",
        "category",
        "segment_label",
        F.col("week_start").alias("forecast_origin"),
        plus_weeks("week_start", F.col("horizon")).alias("target_date"),
        "horizon",
        "actual",
        "prediction",
    )


def trees(
    table: DataFrame,
    windows: DataFrame,
    features: Sequence[str],
    model_name: str = "gbt_squared",
    **params,
) -> DataFrame:
    """Backtest predictions of every window given; ``params`` are those of ``Settings``.

    All windows grow in one series of passes, ``maxIter`` times ``maxDepth`` of them. The table is
    read three times, its packed blocks once per pass: hand in a written one.
    """
    wanted = windows.orderBy("forecast_origin", "horizon").collect()  # weeks × horizons rows
    if not wanted:
        raise ValueError("no windows")
    horizon = [int(w.horizon) for w in wanted]
    forest, cuts = grow(table, horizon, [days(w.train_end) for w in wanted], features, model_name, Settings(**params))
    made = _forecasts(table, features, model_name, forest, cuts, [days(w.forecast_origin) for w in wanted])
    return made.where("actual IS NOT NULL")


_SAVED = "horizon int, features array<string>, cuts array<array<double>>, base double, feature binary, bin binary, value binary, trees int"


def fit_trees(
    table: DataFrame, features: Sequence[str], horizons: Sequence[int], model_name: str, path: str, **params
) -> dict[int, str]:
    """One final model per horizon on all rows with a target, grown together and saved under
    ``path``."""
    horizons = [int(h) for h in horizons]
    known = table.dropna(subset=list(features)).agg(*[F.max(F.when(F.col(f"target_h{h}").isNotNull(), F.col("week_start"))).alias(f"h{h}") for h in horizons]).first()
    if any(x is None for x in known):
        raise ValueError("a horizon has no row with all features and a target")
    forest, cuts = grow(table, horizons, [days(x) for x in known], features, model_name, Settings(**params))
    saved = {}
    for w, h in enumerate(horizons):
        saved[h] = f"{path}/model_name={model_name}/horizon={h}"
        row = (h, list(features), [c.tolist() for c in cuts], float(forest.base[w]), forest.feature[w].tobytes(), forest.bin[w].tobytes(), forest.value[w].tobytes(), forest.value.shape[1])
        table.sparkSession.createDataFrame([row], _SAVED).coalesce(1).write.parquet(saved[h])
    return saved


def load_trees(spark: SparkSession, saved: Mapping[int, str]) -> tuple[list[str], Forest, list[list[np.ndarray]]]:
    if not saved:
        raise ValueError("no saved models")
    rows = [spark.read.schema(_SAVED).parquet(path).first() for _, path in sorted(saved.items())]
    n = rows[0]["trees"]
    of = lambda c, kind: np.stack([np.frombuffer(r[c], kind).reshape(n, -1) for r in rows])
    forest = Forest(np.array([r["horizon"] for r in rows]), np.zeros(len(rows)), np.array([r["base"] for r in rows]), of("feature", np.int16), of("bin", np.uint8), of("value", np.float64))
    return list(rows[0]["features"]), forest, [[np.array(c) for c in r["cuts"]] for r in rows]


def score_trees(table: DataFrame, features: Sequence[str], model_name: str, saved: Mapping[int, str]) -> DataFrame:
    """Forecasts of saved models from the last week; no actuals are needed."""
    names, forest, cuts = load_trees(table.sparkSession, saved)
    if names != list(features):
        raise ValueError(f"the model knows the features {names}")
    last = table.agg(F.max("week_start").alias("week")).first()["week"]
    rows = table.where(F.col("week_start") == F.lit(last))
    origin = [days(last)] * len(forest.base) if last else [0] * len(forest.base)
    return _forecasts(rows, features, model_name, forest, cuts[0], origin)
