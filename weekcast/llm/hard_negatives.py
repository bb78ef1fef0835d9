"""11. Hard negatives by a secondary sort.

Vectors become integers (``floor(scale * x)``) and pairs of them scores (inner products). For an
anchor, its positives are the best rows of its label; each opens a window of scores, from
``low`` of its own score up to it, and takes the best rows of other labels inside.

Anchors meet all rows in blocks. Blocks of rows are dealt to cells in turn, and blocks of anchors,
some ``BAND`` bytes at a time, to all cells. A task holds the anchors of a band, reads its blocks of
rows one by one, multiplies blocks and keeps what can count at all: each anchor's best few positives
and, once those are known, the best few negatives of each window. Both sides are shuffled and
nothing is broadcast, as there are as many copies of the anchors as cells. What is left is packed
into keys (anchor, descending score, positive before negative, id), dealt by anchor and sorted by
``repartitionAndSortWithinPartitions``. A task then reads its keys one by one: a positive opens a
window, a negative goes to every window that is open, and no anchor's rows are ever held together.

Rows with a null key, label or vector, or with a null or non-finite component, take no part. The
key names one row: of rows that share it, the least by label and components counts, so repeated
rows count once. Vectors of different lengths have no score; empty ones have the score 0. Ties go to the
smaller key. An anchor without positives, and a positive without negatives, give no rows; an empty
table gives an empty one. Scores are exact integers; beyond 64 bits they stop at the bound.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import write_once

#: Rows and anchors of a block: a block of scores has 16 MB at most. Bytes of anchors that a task holds,
#: and blocks that JVM and Python both hold.
ROWS, ANCHORS, BAND, HELD = 4096, 512, 32 << 20, 8
BLOCK = "task int, block int, dim int, ids binary, labels binary, vectors binary"
WINDOWS = "array<struct<anchor_id:bigint,score:bigint>>"
FOUND = "number bigint, anchor_id bigint, score bigint, id bigint"
_KEY = struct.Struct(">QQBQ")
_HALF = 1 << 63
_MOST = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


def prepared(table: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, vector`` (whole numbers as doubles), one row per key."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(
        table[id_col].cast("bigint").alias("id"),
        table[label_col].cast("bigint").alias("label"),
        table[vec_col].cast("array<double>").alias("vector"),
    )
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(F.forall("vector", whole))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("id", "row.label", F.transform("row.vector", lambda x: floor_of(x, scale)).alias("vector"))


def floor_of(x: F.Column, scale: float) -> F.Column:
    """``floor`` as a double: Spark's own gives a long, which large components don't fit."""
    y = x * F.lit(float(scale))
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)


def _encoded(vectors: np.ndarray) -> bytes:
    """Whole numbers in two bytes each, where all of them fit, or as doubles."""
    small = np.abs(vectors).max(initial=0) < 1 << 15
    return vectors.astype(np.int16 if small else np.float64).tobytes()


def _decoded(data: bytes, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim))
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * dim else np.float64).reshape(n, dim)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a task packed into blocks of ``size`` vectors of one length."""
    out = rows.sparkSession.createDataFrame([], BLOCK).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, made = to_arrow_schema(out), {}, 0

        def full(dim: int) -> pa.RecordBatch:
            ids, labels, vectors = zip(*held.pop(dim))
            row = {
                "task": TaskContext.get().partitionId(),
                "block": made,
                "dim": dim,
                "ids": np.array(ids, np.int64).tobytes(),
                "labels": np.array(labels, np.int64).tobytes(),
                "vectors": _encoded(np.array(vectors, np.float64)),
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            vectors = batch.column("vector")
            flat, ends = vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            for k, (i, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist())):
                own = held.setdefault(dim := int(ends[k + 1] - ends[k]), [])
                own.append((i, label, flat[ends[k] : ends[k + 1]]))
                if len(own) == size:
                    yield full(dim)
                    made += 1
        for dim in sorted(held):
            yield full(dim)
            made += 1

    return rows.mapInArrow(run, out)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    top = (np.abs(a).max(initial=0) or 1) * (np.abs(b).max(initial=0) or 1) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape) @ (
        np.array([[int(x) for x in row] for row in b.tolist()], object).reshape(b.shape).T
    )
    return np.array([[max(-_MOST, min(_MOST, int(x))) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def _exact(a: np.ndarray, top_a: float, b: np.ndarray, top_b: float) -> np.ndarray:
    """``scores`` in single precision, where all sums of whole numbers are below 2^24, or as they are.
    ``top_a``, ``top_b``: the largest components."""
    if top_a * top_b * a.shape[1] < 2**24:
        return a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T
    return scores(a.astype(np.float64, copy=False), b.astype(np.float64, copy=False))


def _like(limit: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Limits in the type of ``score``; they compare as before."""
    if score.dtype == np.float32:
        return np.clip(limit, -(2**24), 2**24).astype(np.float32)
    return limit


class Best:
    """The ``most`` best (score, id) of each of ``n`` places, ties by smaller id."""

    def __init__(self, n: int, most: int, least: np.ndarray | None = None):
        self.most = most
        self.place, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: What a score must reach to count at a place, and the id that counts below if it is just that.
        self.least = np.full(n, _NONE) if least is None else least.copy()
        self.below = np.full(n, _MOST)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        new = (score > self.least[place]) | (score == self.least[place]) & (ids <= self.below[place])
        if not new.any():
            return
        place, score, ids = (np.concatenate([x, y[new]]) for x, y in ((self.place, place), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, place))
        place = place[order]
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        rank = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
        kept = rank < self.most
        self.place, self.score, self.id = place[kept], score[order][kept], ids[order][kept]
        full = np.flatnonzero(rank[kept] == self.most - 1)
        self.least[self.place[full]], self.below[self.place[full]] = self.score[full], self.id[full]


class _Anchors:
    """A block of anchors, and what is best for them of the rows that it has met."""

    def __init__(self, row: dict, most: int, low: tuple[int, int]):
        self.number = row["number"]
        self.ids, self.labels, self.vectors, self.top = _block(row)
        self.start(row, most, low)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, scores and ids."""
        return self.ids[self.best.place], self.best.score, self.best.id


class _Positives(_Anchors):
    """The best rows of an anchor's label."""

    def start(self, row: dict, most: int, low: tuple[int, int]) -> None:
        self.best = Best(len(self.ids), most)
        self.kinds = [(kind, np.flatnonzero(self.labels == kind)) for kind in np.unique(self.labels)]

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: float) -> None:
        """Rows in the order of their labels."""
        made = []
        for kind, own in self.kinds:
            x, y = np.searchsorted(labels, kind, "left"), np.searchsorted(labels, kind, "right")
            if x < y:
                score = _exact(self.vectors[own], self.top, vectors[x:y], top)
                i, j = np.nonzero(score >= _like(self.best.least[own], score)[:, None])
                other = self.ids[own[i]] != ids[x + j]
                i, j = i[other], j[other]
                made.append((own[i], score[i, j].astype(np.int64), ids[x + j]))
        if made:
            self.best.add(*(np.concatenate(c) for c in zip(*made)))


class _Negatives(_Anchors):
    """The best rows of other labels in each window that an anchor's positives open."""

    def start(self, row: dict, most: int, low: tuple[int, int]) -> None:
        num, den = low
        opened: dict[int, set[int]] = {}
        for w in row["windows"]:
            opened.setdefault(w["anchor_id"], set()).add(w["score"])
        windows = [(i, top) for i, anchor in enumerate(self.ids.tolist()) for top in opened.get(anchor, ())]
        self.place, self.high = np.array(windows, np.int64).reshape(-1, 2).T
        # The smallest whole score inside.
        least = [max(_NONE + 1, min(_MOST, -(-num * top // den))) for _, top in windows]
        self.best = Best(len(windows), most, np.array(least, np.int64))

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: float) -> None:
        score = _exact(self.vectors, self.top, vectors, top)
        reached = np.flatnonzero(score.max(axis=1)[self.place] >= _like(self.best.least, score))
        made = []
        for k in range(0, len(reached), len(score)):
            some = reached[k : k + len(score)]
            place, own = self.place[some], score[self.place[some]]
            i, j = np.nonzero((own >= _like(self.best.least[some], score)[:, None]) & (own <= _like(self.high[some], score)[:, None]))
            other = self.labels[place[i]] != labels[j]
            i, j = i[other], j[other]
            made.append((some[i], own[i, j].astype(np.int64), ids[j]))
        if made:
            self.best.add(*(np.concatenate(c) for c in zip(*made)))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = np.unique(np.stack([self.place[self.best.place], self.best.score, self.best.id]), axis=1)
        return self.ids[one[0]], one[1], one[2]


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    vectors = _decoded(row["vectors"], len(ids), row["dim"])
    return ids, labels, vectors, float(max(vectors.max(initial=0), -float(vectors.min(initial=0))))


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with a ``number`` from 0 on, without gaps, and how many they are. The driver sees a row
    per task that made them."""
    made = dict(blocks.groupBy("task").count().collect())
    before, first = 0, []
    for task in range(max(made, default=0) + 1):
        first.append(F.lit(before).cast("bigint"))
        before += made.get(task, 0)
    number = F.element_at(F.array(*first), F.col("task") + 1) + F.col("block")
    return blocks.withColumn("number", number).drop("task", "block"), before


def _met(sides: DataFrame, blocks: DataFrame, cells: int, bands: int, kind: type, most: int, low: tuple[int, int]) -> DataFrame:
    """What ``kind`` finds for each block of anchors (``sides``) in each cell of ``blocks``."""
    out = sides.sparkSession.createDataFrame([], FOUND).schema
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = sides.withColumn("band", F.col("number") % bands).withColumn("cell", every(cells)).withColumn("anchors", F.lit(True))
    rows = blocks.withColumn("cell", F.col("number") % cells).withColumn("band", every(bands)).withColumn("anchors", F.lit(False))
    both = own.unionByName(rows.withColumn("windows", F.lit(None).cast(WINDOWS)))
    part = (F.col("cell") * bands + F.col("band")).cast("int")
    both = both.select(part.alias("part"), "dim", "anchors", "number", "ids", "labels", "vectors", "windows")
    dealt = both.repartitionById(cells * bands, "part").sortWithinPartitions("dim", F.desc("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, dim, held = to_arrow_schema(out), None, []

        def done() -> Iterator[pa.RecordBatch]:
            for one in held:
                anchors, score, ids = one.found()
                if len(ids):
                    number = np.full(len(ids), one.number)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (number, anchors, score, ids)], schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["dim"] != dim:
                    yield from done()
                    dim, held = row["dim"], []
                if row["anchors"]:
                    held.append(kind(row, most, low))
                elif held:
                    ids, labels, vectors, top = _block(row)
                    order = np.argsort(labels, kind="stable")
                    vectors = vectors[order].astype(np.float64 if vectors.dtype == np.float64 else np.float32)
                    for one in held:
                        one.meet(ids[order], labels[order], vectors, top)
        yield from done()

    return dealt.mapInArrow(run, out)


def _packed(found: DataFrame, kind: int) -> DataFrame:
    """(anchor, descending score, kind, id) as bytes that sort in that order."""
    out = found.sparkSession.createDataFrame([], "key binary").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, s, i = (batch.column(c).to_numpy() for c in ("anchor_id", "score", "id"))
            made = np.zeros(len(a), [("a", ">u8"), ("s", ">u8"), ("k", "u1"), ("i", ">u8")])
            sign = np.uint64(_HALF)
            made["a"], made["i"], made["k"] = a.view(np.uint64) ^ sign, i.view(np.uint64) ^ sign, kind
            made["s"] = ~(s.view(np.uint64) ^ sign)
            data = made.tobytes()
            yield pa.RecordBatch.from_pydict({"key": [data[n : n + 25] for n in range(0, len(data), 25)]}, schema=pa.schema([("key", pa.binary())]))

    return found.select("anchor_id", "score", "id").mapInArrow(run, out)


def _by_anchor(key: bytes) -> int:
    return int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 24


def _stream(keys: Iterable[tuple[bytes, None]], most: int, low: tuple[int, int]) -> Iterator[tuple]:
    """Sorted keys to rows of the result; only the windows that are open are held."""
    num, den = low
    now, windows = None, []
    for key, _ in keys:
        a, s, kind, i = _KEY.unpack(key)
        anchor, score, i = a - _HALF, _HALF - 1 - s, i - _HALF
        if anchor != now:
            now, windows = anchor, []
        if kind == 0:
            windows.append([i, score, 0])
            continue
        windows = [w for w in windows if w[2] < most and num * w[1] <= den * score]
        for w in windows:
            if score <= w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], i, w[1], score


def mine(
    table: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: tuple[int, int] = (80, 100),
    rows: int = ROWS,
    anchors: int = ANCHORS,
    band: int = BAND,
    **columns,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Anchors are the rows
    whose key ``every`` divides; ``low`` is the least share of a positive's score."""
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, n = _numbered(write_once(_blocks(prepared(table, **columns), rows)))
    cells = max(1, min(parts, n))
    stated = write_once(_unpacked(blocks, every), HELD)
    dealt = stated.repartition(max(1, -(-stated.count() // anchors)), "id")
    sides, _ = _numbered(write_once(_blocks(dealt, anchors)))
    size = sides.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
    bands = max(1, -(-size // band))

    ranked = _met(sides.withColumn("windows", F.lit(None).cast(WINDOWS)), blocks, cells, bands, _Positives, positives, low)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = write_once(ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).drop("k"), HELD)
    windows = best.groupBy("number").agg(F.collect_list(F.struct("anchor_id", "score")).alias("windows"))
    opened = sides.hint("merge").join(windows, "number")
    hard = write_once(_met(opened, blocks, cells, bands, _Negatives, negatives, low), HELD)

    keys = _packed(best, 0).union(_packed(hard, 1))
    rdd = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, _by_anchor)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame(rdd.mapPartitions(lambda keys: _stream(keys, negatives, low)), out, verifySchema=False)


def _unpacked(blocks: DataFrame, every: int) -> DataFrame:
    """The anchors among the rows of ``blocks``."""
    out = blocks.sparkSession.createDataFrame([], "id bigint, label bigint, vector array<double>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    vectors = _decoded(row["vectors"], len(ids), row["dim"])[at].astype(np.float64)
                    made = {"id": ids[at], "label": labels[at], "vector": list(vectors)}
                    yield pa.RecordBatch.from_pydict(made, schema=arrow)

    return blocks.mapInArrow(run, out)
