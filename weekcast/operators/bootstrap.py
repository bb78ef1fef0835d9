"""Paired block bootstrap of metric differences between models.

A block is one series × origin × horizon; all models of a block are drawn together. Blocks are
numbered in the order of their keys and lie in cells of neighbouring numbers.

The multinomial bootstrap draws as many blocks as there are, with replacement, and moves none of
those draws: how many of them fall into each half of a range of cells is a binomial number, made
from hashed random bits, so one pass down the tree of ranges gives every cell its number of draws
per replicate (``reps x cells`` numbers). Those meet the blocks of the cell once, and the task
that holds them draws on the spot. What leaves a cell is one row of sums per replicate and model,
or, for the exact median, counts of errors by their leading bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.errors import error_terms, metric_from_sums
from weekcast.functions.hashing import draw63, draw63_array, stream63_array
from weekcast.operators.ranking import running
from weekcast.session import cut_lineage

BLOCK = ("series_id", "forecast_origin", "horizon")
UNIT = "series_id x forecast_origin x horizon"
_SUMS = ("n", "abs_error", "error", "sq_error", "abs_actual", "smape_term")
#: Blocks of a cell at most, and random bits taken from one hashed number.
CELL, WORD = 1000, 62
#: Leading bits of an error that are counted first (sign and exponent), and then at a time.
FIRST_BITS, NEXT_BITS = 12, 7


def block_sums(predictions: DataFrame, block: Sequence[str] = BLOCK) -> DataFrame:
    """One row per block with the error terms of each model, and its 0-based number.

    A block holds a handful of rows, one per model. Numbers follow the sorted block
    keys; they come from the range-partitioned ranking, since the number of blocks
    grows with the series.
    """
    terms = predictions.withColumns(error_terms()).withColumns(
        {"n": F.lit(1), "sq_error": F.col("error") * F.col("error")}
    )
    per_block = terms.groupBy(*block).agg(
        F.collect_list(F.struct("model_name", *_SUMS)).alias("models")
    )
    return running(per_block, [F.col(b) for b in block]).select(
        (F.col("position") - 1).alias("block_id"), "total_rows", "models"
    )


def poisson_bounds(bits: int = 63) -> list[int]:
    """A uniform ``bits``-bit number has as weight how many of these it reaches; they go on
    until the mass beyond is less than the number can tell."""
    out, k = [], 0
    tail = Fraction(1)
    while True:
        tail -= Fraction(math.exp(-1)) / math.factorial(k)
        bound = 2**bits - math.ceil(max(tail, 0) * 2**bits)
        if tail <= 0 or bound >= 2**bits - 1:
            return out
        out.append(bound)
        k += 1


@dataclass(frozen=True)
class Segment:
    """Blocks ``first`` and on: ``2**depth`` cells of ``size`` blocks each, numbered from
    ``base``; ``rest`` blocks come after them, too few for another block in each cell."""

    number: int
    first: int
    depth: int
    size: int
    rest: int
    base: int

    @property
    def blocks(self) -> int:
        return (self.size << self.depth) + self.rest


def segments(n: int, cell: int = CELL) -> list[Segment]:
    out: list[Segment] = []
    first = base = 0
    while n > 0:
        depth = next(d for d in range(64) if n >> d <= cell)
        size = n >> depth
        out.append(Segment(len(out), first, depth, size, n - (size << depth), base))
        first, base, n = first + (size << depth), base + (1 << depth), out[-1].rest
    return out


def _ones(seed: int, rep: int, part: int, bit: int, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of ``counts`` random bits are set, per node."""
    words = -(-counts // WORD)
    out = np.zeros(len(counts), np.int64)
    bounds = np.cumsum(words)
    at = 0
    while at < len(counts):  # a bounded number of hashed words at a time
        done = bounds[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(bounds, done + (1 << 20), side="right")))
        for lo in range(0, int(words[at]) if to == at + 1 else 1, 1 << 20):
            own = words[at:to] if to > at + 1 else np.array([min(1 << 20, int(words[at]) - lo)])
            which = np.repeat(np.arange(len(own)), own)
            k = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own) + lo
            drawn = stream63_array(seed, (rep * 64 + bit) * 8 + part, nodes[at:to][which], k)
            bits = np.clip(counts[at:to][which] - WORD * k, 0, WORD).astype(np.uint64)
            out[at:to] += np.bincount(which, np.bitwise_count(drawn & ((np.uint64(1) << bits) - np.uint64(1))), len(own)).astype(np.int64)
        at = to
    return out


def binomial(seed: int, rep: int, part: int, n: int, share: tuple[int, int]) -> int:
    """Of ``n`` draws, those whose random number lies below the fraction ``share``: numbers are
    compared with it bit by bit, all draws at once, until none is undecided."""
    rest, whole = share
    got, bit, node = 0, 0, np.zeros(1, np.int64)
    while n and rest:
        bit += 1
        rest *= 2
        ones = int(_ones(seed, rep, part, min(bit, 63), node + max(bit - 63, 0), np.array([n]))[0])
        if rest >= whole:
            rest -= whole
            got, n = got + n - ones, ones
        else:
            n -= ones
    return got


def cell_counts(seed: int, rep: int, parts: Sequence[Segment]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and their draws in one replicate: halves of halves, down the tree of each segment."""
    draws = parts[0].blocks if parts else 0
    for p in parts:
        later = binomial(seed, rep, p.number, draws, (p.rest, p.blocks))
        counts, nodes = np.array([draws - later], np.int64), np.ones(1, np.int64)
        for _ in range(p.depth):
            right = _ones(seed, rep, p.number, 0, nodes, counts)
            counts = np.stack([counts - right, right], axis=1).ravel()
            nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
        yield p.base + nodes - (1 << p.depth), counts
        draws = later


def weights(row: dict, seed: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Replicates, and how often each draws each block of the cell: one row per replicate."""
    reps, size = np.frombuffer(row["reps"], np.int64), row["size"]
    if method == "poisson":
        drawn = draw63_array(seed, reps[:, None].astype(np.uint64), row["first"] + np.arange(size)[None, :])
        return reps, np.searchsorted(np.array(poisson_bounds(), np.uint64), drawn, side="right")
    counts = np.frombuffer(row["counts"], np.int64)
    which = np.repeat(np.arange(len(reps)), counts)
    j = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    drawn = stream63_array(seed + 1, reps[which] * 8 + row["part"], np.full(len(which), row["local"]), j) % np.uint64(size)
    return reps, np.bincount(which * size + drawn.astype(np.int64), minlength=len(reps) * size).reshape(len(reps), size)


_PACKED = "part int, local bigint, first bigint, size int, reps binary, counts binary, models array<struct<name: string, at: binary, sums: binary>>"


def packed_cells(predictions: DataFrame, n_bootstrap: int, seed: int, method: str, cell: int = CELL) -> DataFrame:
    """One row per cell: its blocks' error terms by model and its draws by replicate. Blocks are
    shuffled once, by cell; beside them only ``reps x cells`` counts."""
    spark = predictions.sparkSession
    blocks = block_sums(predictions)
    first = blocks.select("total_rows").first()
    parts = segments(first["total_rows"] if first else 0, cell)
    number = F.lit(None).cast("bigint")
    for p in reversed(parts):
        own = F.lit(p.base) + F.floor((F.col("block_id") - p.first) / F.lit(max(p.size, 1)))
        end = p.first + (p.size << p.depth)
        number = F.when(F.col("block_id") < end, own.cast("bigint")).otherwise(number)
    rows = blocks.select(number.alias("cell"), "block_id", F.inline("models"))
    reps = spark.range(n_bootstrap, numPartitions=max(1, min(n_bootstrap, spark.sparkContext.defaultParallelism))).toDF("rep")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep in batch.column("rep").to_pylist():
                for cells, counts in cell_counts(seed, rep, parts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells), pa.array(np.full(len(cells), rep)), pa.array(counts)], names=["cell", "rep", "count"]
                    )

    def no_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Independent weights need the replicates' numbers only."""
        for batch in batches:
            for p in parts:
                cells = p.base + np.arange(1 << p.depth)
                for rep in batch.column("rep").to_pylist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells), pa.array(np.full(len(cells), rep)), pa.array(np.zeros(len(cells), np.int64))], names=["cell", "rep", "count"]
                    )

    counts = reps.mapInArrow(no_counts if method == "poisson" else drawn, "cell bigint, rep bigint, count bigint")
    schema = spark.createDataFrame([], _PACKED).schema

    def pack(key, left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        number = key[0].as_py()
        p = next(p for p in reversed(parts) if p.base <= number)
        local = number - p.base
        begin = p.first + local * p.size
        right = right.sort_by("rep")
        models = []
        for name in sorted(set(left.column("model_name").to_pylist())):
            own = left.filter(pa.compute.equal(left.column("model_name"), name))
            at = own.column("block_id").to_numpy() - begin
            sums = np.stack([own.column(c).cast(pa.float64()).to_numpy() for c in _SUMS], axis=1)
            models.append({"name": name, "at": at.astype(np.int64).tobytes(), "sums": sums.tobytes()})
        row = {
            "part": p.number,
            "local": local,
            "first": begin,
            "size": p.size,
            "reps": right.column("rep").to_numpy().astype(np.int64).tobytes(),
            "counts": right.column("count").to_numpy().astype(np.int64).tobytes(),
            "models": models,
        }
        return pa.Table.from_pylist([row], schema=to_arrow_schema(schema))

    return rows.groupBy("cell").cogroup(counts.groupBy("cell")).applyInArrow(pack, schema)


def _models(row: dict) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for m in row["models"]:
        yield m["name"], np.frombuffer(m["at"], np.int64), np.frombuffer(m["sums"], np.float64).reshape(-1, len(_SUMS))


def _per_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _summed(cells: DataFrame, seed: int, method: str) -> DataFrame:
    """``rep, model_name`` and the weighted sums of every cell."""
    out = "rep bigint, model_name string, " + ", ".join(f"{c} double" for c in _SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _per_cell(batches):
            reps, w = weights(row, seed, method)
            for name, at, sums in _models(row):
                made = w[:, at].astype(np.float64) @ np.nan_to_num(sums)
                columns = [pa.array(reps), pa.array([name] * len(reps), pa.string()), *(pa.array(made[:, k].copy()) for k in range(len(_SUMS)))]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "model_name", *_SUMS])

    return cells.mapInArrow(run, out)


def _counted(cells: DataFrame, seed: int, method: str, bits: int, known: dict | None) -> DataFrame:
    """``rep, model_name, side, bin, n``: drawn errors by their next leading bits, of those that
    share the bits known so far (by model: a row per replicate, a column per side)."""
    done = 0 if known is None else known["bits"]
    sent = cells.sparkSession.sparkContext.broadcast(known)
    sides = (0,) if known is None else (0, 1)
    out = "rep bigint, model_name string, side int, bin bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _per_cell(batches):
            reps, w = weights(row, seed, method)
            for name, at, sums in _models(row):
                errors = sums[:, _SUMS.index("abs_error")]
                there = np.isfinite(errors)
                key, own = errors[there].view(np.uint64), w[:, at[there]]
                next_bits = (key << np.uint64(done)) >> np.uint64(64 - bits)
                bins, place = np.unique(next_bits, return_inverse=True)
                for side in sides:
                    if done:
                        prefix = sent.value["prefix"][name][reps, side]
                        here = own * (prefix[:, None] == (key >> np.uint64(64 - done))[None, :])
                    else:
                        here = own
                    sums_of = np.zeros((len(reps), len(bins)), np.int64)
                    np.add.at(sums_of.T, place, here.T)
                    r, b = np.nonzero(sums_of)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reps[r]), pa.array([name] * len(r), pa.string()), pa.array(np.full(len(r), side, np.int32)), pa.array(bins[b].astype(np.int64)), pa.array(sums_of[r, b])],
                        names=["rep", "model_name", "side", "bin", "n"],
                    )

    return cells.mapInArrow(run, out).groupBy("rep", "model_name", "side", "bin").agg(F.sum("n").alias("n"))


def _medians(cells: DataFrame, n_bootstrap: int, seed: int, method: str) -> DataFrame:
    """``rep, model_name, value``: exact medians of all replicates and models at once, selected
    bit by bit. Non-negative numbers sort as their bits do, so the bin that holds the middle
    gives its next leading bits; no error is ever ranked or moved."""
    spark = cells.sparkSession
    cells = cut_lineage(cells)
    group = Window.partitionBy("rep", "model_name", "side")
    before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0))
    first = _counted(cells, seed, method, FIRST_BITS, None).withColumns({"earlier": earlier, "total": F.sum("n").over(group)})
    middle = first.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("target", F.expr("(total - 1 + side) div 2"))
    chosen = middle.where("earlier <= target AND target < earlier + n").select("rep", "model_name", "side", "bin", (F.col("target") - F.col("earlier")).alias("target"), "total").collect()
    names = sorted({r["model_name"] for r in chosen})
    prefix = {m: np.zeros((n_bootstrap, 2), np.uint64) for m in names}
    target = {m: np.full((n_bootstrap, 2), -1, np.int64) for m in names}
    for r in chosen:
        prefix[r["model_name"]][r["rep"], r["side"]], target[r["model_name"]][r["rep"], r["side"]] = r["bin"], r["target"]
    done = FIRST_BITS
    while done < 64:
        bits = min(NEXT_BITS, 64 - done)
        counted = _counted(cells, seed, method, bits, {"bits": done, "prefix": prefix})
        # One wanted place per replicate, model and side.
        places = [(k, m, side, int(target[m][k, side])) for m in names for k in range(n_bootstrap) for side in (0, 1) if target[m][k, side] >= 0]
        wanted = spark.createDataFrame(places, "rep bigint, model_name string, side int, target bigint")
        ranked = counted.withColumn("earlier", earlier).join(wanted, ["rep", "model_name", "side"])
        chosen = ranked.where("earlier <= target AND target < earlier + n").select("rep", "model_name", "side", "bin", (F.col("target") - F.col("earlier")).alias("target")).collect()
        for r in chosen:
            m, k, side = r["model_name"], r["rep"], r["side"]
            prefix[m][k, side] = (prefix[m][k, side] << np.uint64(bits)) | np.uint64(r["bin"])
            target[m][k, side] = r["target"]
        done += bits
    values = []
    for m in names:
        ends = prefix[m].view(np.float64)
        values += [(k, m, float(ends[k, 0] + (ends[k, 1] - ends[k, 0]) * 0.5)) for k in range(n_bootstrap) if target[m][k, 0] >= 0]
    return spark.createDataFrame(values, "rep bigint, model_name string, value double")


def _poisson_draws(blocks: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """``rep``, the models' sums and a weight: the inverse distribution function of Poisson(1)
    at a hashed uniform."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("rep")
    slots = blocks.select(reps, "block_id", "models").withColumn("_u", draw63(seed, "rep", "block_id"))
    passed = [F.when(F.col("_u") >= F.lit(c), 1).otherwise(0) for c in poisson_bounds()]
    # Zero weights stay in; they add nothing to the sums.
    return slots.select("rep", sum(passed[1:], passed[0]).alias("weight"), "models")


def _pairs(per_model: DataFrame, value: str) -> DataFrame:
    """Model pairs a < b within a replicate; a replicate has one row per model."""
    listed = per_model.groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("model_name", value))).alias("m")
    )
    return (
        listed.select("rep", "m", F.posexplode("m").alias("i", "a"))
        .select("rep", "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
        .select(
            F.col("a.model_name").alias("model_a"),
            F.col("b.model_name").alias("model_b"),
            (F.col(f"a.{value}") - F.col(f"b.{value}")).alias("difference"),
        )
    )


def bootstrap_ci(
    predictions: DataFrame,
    metric: str = "WAPE",
    n_bootstrap: int = 300,
    seed: int = 42,
    method: str = "multinomial",
    cell: int = CELL,
) -> DataFrame:
    """Mean, median and 95 % interval of the metric difference of every model pair.

    ``multinomial`` draws as many blocks as there are, with replacement. ``poisson`` gives each
    block an independent Poisson(1) weight instead.
    """
    if method not in ("multinomial", "poisson"):
        raise ValueError(f"unknown method {method!r}")
    if metric == "MedianAE":
        per_model = _medians(packed_cells(predictions, n_bootstrap, seed, method, cell), n_bootstrap, seed, method)
    else:
        if method == "poisson":
            drawn = _poisson_draws(block_sums(predictions), n_bootstrap, seed).select("rep", "weight", F.inline("models"))
            sums = drawn.select("rep", "model_name", *[(F.col(s) * F.col("weight")).alias(s) for s in _SUMS])
        else:
            sums = _summed(packed_cells(predictions, n_bootstrap, seed, method, cell), seed, method)
        per_model = (
            sums.groupBy("rep", "model_name")
            .agg(*[F.sum(s).alias(s) for s in _SUMS])
            .select("rep", "model_name", metric_from_sums(metric).alias("value"))
        )
    return (
        _pairs(per_model, "value")
        .groupBy("model_a", "model_b")
        .agg(
            F.avg("difference").alias("mean_difference"),
            F.percentile("difference", 0.5).alias("median_difference"),
            F.percentile("difference", 0.025).alias("ci95_low"),
            F.percentile("difference", 0.975).alias("ci95_high"),
        )
        .withColumns(
            {
                "metric": F.lit(metric),
                "n_bootstrap": F.lit(n_bootstrap),
                "bootstrap_unit": F.lit(UNIT),
            }
        )
    )
