"""5. SimHash near-duplicates, found with the generalised pigeonhole principle.

Two fingerprints that differ in at most ``radius`` bits differ, in some part of a partition
of the bits, in no more bits than that part's threshold, when the thresholds add up to
``radius - parts + 1`` (a threshold of -1 leaves a part out). Correlated bits are put into
the same part, and the thresholds come from dynamic programming over estimated costs: rows
to probe with, and candidates. The estimates use a bounded sample of ``SAMPLE``
fingerprints; they steer the cost and never the result.

Equal fingerprints are one row before any search. Rows with the same part value meet in a
task, are verified by bit counts, and leave it as a spanning forest, never as all pairs. A
part value that more than ``heavy`` fingerprints share isn't compared pair by pair: two
fingerprints within ``2 r`` bits of each other have a point within ``r`` bits of both, so
its members are linked through all points within half the radius, in linear time.

A null text and one without words have the fingerprint zero, linked like any other. Rows
with a null doc_id get the component of their fingerprint, if a document with an id has it.
Repeated rows give one row each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm import near_sets, shingle_sets
from weekcast.llm.common import forget, fresh, map_texts, write_once
from weekcast.llm.components import components
from weekcast.llm.forest import Forest

SHINGLE, SEED, RADIUS = 4, 42, 4
SAMPLE, HEAVY = 2048, 4096
#: Relative costs, microseconds: a row that is shuffled and sorted, a pair that is verified.
ROW_COST, PAIR_COST = 3.0, 0.02
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ROWS = "part_value bigint, fp bigint, doc bigint, probe boolean"


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(joined, SEED)
    pairs = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    return majority(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255 * 64):
        block = hashes[k : k + 255 * 64]
        padded = np.zeros(-(-len(block) // 255) * 255, np.uint64)
        padded[: len(block)] = block
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int((2 * ones > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long)."""
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))

    def start():
        def work(batch: dict) -> dict:
            made = np.array([fingerprint(t or b"", n) for t in batch["text"]], np.uint64)
            return {"doc_id": batch["doc_id"], "fp": made.view(np.int64)}

        return work

    return map_texts(texts, f"doc_id {dict(texts.dtypes)['doc_id']}, fp bigint", start)


@dataclass(frozen=True)
class Partition:
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Parts of about equal size: each starts with the bit most correlated to the bits left
    and takes the bit most correlated to it until it is full."""
    bits = _bits(sample).astype(float)
    if len(sample) > 1:
        centred = bits - bits.mean(axis=0)
        spread = np.sqrt((centred**2).sum(axis=0))
        near = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-12)
    else:
        near = np.zeros((64, 64))
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: near[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: near[b, group].sum())
            group.append(best)
            left.remove(best)
        out.append(tuple(sorted(group)))
    return tuple(out)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, tuple[int, ...]]:
    """One threshold per part, of those in ``costs``, that add up to ``total`` at least cost."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in part.items():
                now = (cost + more, (*chosen, t))
                if used + t not in step or now < step[used + t]:
                    step[used + t] = now
        best = step
    return best[total]


def make_partition(sample: np.ndarray, n: int, radius: int = RADIUS) -> Partition:
    """The cheapest of 2 to ``radius + 1`` parts, for ``n`` fingerprints."""
    choices = []
    a, b = np.triu_indices(len(sample), 1)
    apart = sample.view(np.uint64)[a] ^ sample.view(np.uint64)[b]
    for parts in range(2, radius + 2):
        groups, costs = group_bits(sample, parts), []
        for group in groups:
            mask = np.uint64(sum(1 << bit for bit in group))
            differ = np.bitwise_count(apart & mask)
            cost = {-1: 0.0}
            for t in range(0, radius - parts + parts):
                reach = sum(comb(len(group), d) for d in range(t + 1))
                share = max(reach / 2 ** len(group), float((differ <= t).mean()) if len(differ) else 0.0)
                cost[t] = n * reach * ROW_COST + n * n / 2 * share * PAIR_COST
                if reach > 2_000:
                    break
            costs.append(cost)
        choices.append((*allocate(costs, radius - parts + 1), groups))
    _, thresholds, groups = min(choices)
    return Partition(groups, thresholds)


def part_rows(fps: np.ndarray, docs: np.ndarray, partition: Partition) -> dict[str, np.ndarray]:
    """The row under which a fingerprint is found in each part, and those it probes with."""
    out: dict[str, list] = {"part_value": [], "fp": [], "doc": [], "probe": []}
    for i, (group, t) in enumerate(zip(partition.parts, partition.thresholds)):
        value = np.zeros(len(fps), np.int64)
        for j, bit in enumerate(group):
            value |= ((fps >> np.int64(bit)) & np.int64(1)) << np.int64(j)
        for d in range(t + 1):
            for flips in combinations(range(len(group)), d):
                flip = sum(1 << j for j in flips)
                out["part_value"].append(value ^ np.int64(flip) | np.int64(i << 58))
                out["fp"].append(fps)
                out["doc"].append(docs)
                out["probe"].append(np.full(len(fps), d > 0))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def verify(value: np.ndarray, fp: np.ndarray, doc: np.ndarray, probe: np.ndarray, radius: int) -> Forest:
    """Of rows with the same part value, every row with every earlier one that isn't a probe."""
    order = np.lexsort((probe, value))
    forest = Forest(doc[order])
    value, fp, found = value[order], fp[order].view(np.uint64), ~probe[order]
    first = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    n_found = np.bincount(run, weights=found, minlength=len(begin)).astype(np.int64) if len(value) else begin
    place = np.arange(len(value))
    pairs = np.minimum(place - begin[run], n_found[run]) if len(value) else place
    total, row = np.cumsum(pairs), 0
    while row < len(value):
        done = total[row - 1] if row else 0
        last = max(row + 1, int(np.searchsorted(total, done + (1 << 21), side="right")))
        n = pairs[row:last]
        right = np.repeat(place[row:last], n)
        left = np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n) + begin[run[right]]
        near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        forest.link(left[near], right[near])
        row = last
    return forest


def _linked(rows: DataFrame, key: str, work: Callable[..., Forest]) -> DataFrame:
    """Rows with the same key meet in a task; what leaves it is a forest."""
    out = rows.sparkSession.createDataFrame([], "a bigint, b bigint").schema
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        for batch in batches:
            for c in names:
                held[c].append(batch.column(c).to_numpy(zero_copy_only=False))
        if held[names[0]]:
            a, b = work(*(np.concatenate(held[c]) for c in names)).links()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition(key).mapInArrow(run, out)


def _expanded(distinct: DataFrame, schema: str, make: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    out = distinct.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                made = make(part.column("fp").to_numpy(), part.column("doc").to_numpy())
                yield pa.RecordBatch.from_pydict(made)

    return distinct.select("fp", "doc").mapInArrow(run, out)


def _midpoints(radius: int) -> np.ndarray:
    reach = range(radius // 2 + radius % 2 + 1)
    return np.array([sum(1 << b for b in flips) for d in reach for flips in combinations(range(64), d)], np.uint64)


def _heavy_links(heavy: DataFrame, radius: int) -> DataFrame:
    """Links among ``heavy`` (fp, doc): rows that share a point within half the radius."""
    flips = _midpoints(radius).view(np.int64)

    def points(fps: np.ndarray, docs: np.ndarray) -> dict:
        return {
            "point": (fps[:, None] ^ flips).ravel(),
            "fp": np.repeat(fps, len(flips)),
            "doc": np.repeat(docs, len(flips)),
        }

    def star(point: np.ndarray, fp: np.ndarray, doc: np.ndarray) -> Forest:
        order = np.argsort(point, kind="stable")
        point, fp, doc = point[order], fp[order].view(np.uint64), doc[order]
        first = np.concatenate([[True], point[1:] != point[:-1]])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        forest = Forest(doc)
        near = np.bitwise_count(fp ^ fp[head]) <= radius
        if radius % 2 and not near.all():  # an odd radius has points that reach one bit too far
            value = point.copy()
            return verify(value, fp.view(np.int64), doc, np.zeros(len(fp), bool), radius)
        forest.link(head[near], np.arange(len(fp))[near])
        return forest

    return _linked(_expanded(heavy, "point bigint, fp bigint, doc bigint", points), "point", star)


def near_links(distinct: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """``distinct`` (fp, doc; one row per fingerprint, no nulls): links (a, b) between docs
    that connect exactly the fingerprints within ``radius`` bits of each other."""
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    partition = make_partition(np.array([r["fp"] for r in sample], np.int64), distinct.count(), radius)
    rows = _expanded(distinct, ROWS, lambda fps, docs: part_rows(fps, docs, partition))
    own = _expanded(distinct, ROWS, lambda fps, docs: part_rows(fps, docs, _own(partition)))
    full = write_once(own.groupBy("part_value").count().where(F.col("count") > heavy).select("part_value"))
    check = lambda value, fp, doc, probe: verify(value, fp, doc, probe.astype(bool), radius)
    if full.isEmpty():
        return _linked(rows, "part_value", check)
    light = _linked(rows.join(full, "part_value", "left_anti").select("part_value", "fp", "doc", "probe"), "part_value", check)
    members = rows.join(full, "part_value", "left_semi").select("fp", "doc").distinct()
    return light.union(_heavy_links(members, radius))


def _own(p: Partition) -> Partition:
    return Partition(p.parts, tuple(min(t, 0) for t in p.thresholds))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable over links."""
    made = write_once(fingerprints(docs, SHINGLE, id_col, text_col))
    distinct = write_once(made.groupBy("fp").agg(F.min("doc_id").alias("doc")).where("doc IS NOT NULL"))
    roots = components(near_links(distinct, radius, heavy))
    classes = write_once(
        distinct.join(roots, distinct["doc"] == roots["node"], "left").select(
            "fp", F.coalesce("root", "doc").alias("component_id")
        )
    )
    return made.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """Of texts that are near copies one row, the smallest by doc_id and then by its columns in
    their order. SimHash candidates (``near_sets``) connect most near copies; a search that misses
    none (``shingle_sets``) then finds every link between texts that are still apart. Both verify
    the similarity of the whole sets. Rows that only share a doc_id stay, and so do rows without
    one."""
    made, roots = near_sets.linked(docs)
    forget(made)
    found = write_once(shingle_sets.near_copies(docs, known=roots).where("doc_id IS NOT NULL"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("least"))
    placed = found.join(least, "component")
    key, group = fresh(docs, "text_key"), fresh(docs, "component")
    losers = write_once(placed.where("doc_id <> least").select("doc_id", F.col("text_key").alias(key)).distinct())
    keyed = docs.withColumn(key, shingle_sets.text_key(docs))
    maybe = shingle_sets.marks(losers, "doc_id", key)
    left = keyed.where(~maybe).union(keyed.where(maybe).join(losers, ["doc_id", key], "left_anti").select(keyed.columns))
    first = placed.where("doc_id = least")
    several = first.groupBy("component").count().where("count > 1")
    ties = write_once(
        first.join(several, "component", "left_semi").select("doc_id", F.col("text_key").alias(key), F.col("component").alias(group)).distinct()
    )
    if ties.isEmpty():
        return left.select(docs.columns)
    tied = left.join(ties, ["doc_id", key]).groupBy(group).agg(F.min(F.struct(*docs.columns)).alias("row"))
    alone = left.join(ties, ["doc_id", key], "left_anti").select(docs.columns)
    return alone.union(tied.select([F.col("row").getField(c).alias(c) for c in docs.columns]))
