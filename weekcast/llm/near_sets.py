"""Near copies by wide SimHash fingerprints, verified by exact similarity of five-word shingle sets.

A set's fingerprint has 768 bits, each the majority of a bit of its shingles' hashes. Two sets with
a Jaccard similarity of 0.8 differ in 15 % of the bits. A partition puts correlated bits into the
same part, and parts are as wide as the number of sets needs for few chance meetings. Dynamic
programming gives each part its threshold (left out, equal, or one bit apart): those that find such
a pair most likely, for estimated rows and candidates within a budget per set. The estimates use a
bounded sample of fingerprints; everything else runs over all sets.

Rows (part value, sketch) are range-partitioned and sorted, so that even a value that very many sets
share is split over tasks. A row meets the ``BEFORE`` rows before it; those whose 128-bit sketches are
near enough are its candidates, of which the nearest leaves the task, and besides only what keeps
connected sets connected. Rows of values with more rows are handed on. Each set's best candidate is verified first; what that connects needs
no further verification, so a group of g near copies costs some g of them, not g squared. Candidates
between sets that are still apart, those among the rows handed on included, leave the tasks as a
forest, never as pairs: its trees are blocks of sets that go, each with its text once, to one place,
which verifies the block's candidates, the likeliest first, until they are connected or refuted.
Under hot values and in large blocks the members of the most common component are dealt to shares,
and the others meet all of them.

Equal sets are one before any search. Nulls and texts without words have the empty set; rows
without a doc_id are in a component like any other. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import TEXT_ROWS, forget, map_texts, write_once
from weekcast.llm.components import components
from weekcast.llm.forest import Forest
from weekcast.llm.shingle_sets import LEAST, apart, marks, node, shingles, text_key

WIDTH, SKETCH = 768, 16
#: Sketch bits that may differ: the mean of pairs at the least similarity and four deviations.
SAMPLE, RUN, BEFORE, HEAVY, BLOCK = 2048, 64, 256, 4096, 1024
#: Relative costs of a row and of a pair of rows that meet, and the budget of a set in rows.
ROW_COST, PAIR_COST, BUDGET = 3.0, 0.02, 60
_SALTS = np.array([(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(WIDTH // 64)], np.uint64)
ROWS = "part bigint, sketch binary, node bigint, n int"
MET = "a bigint, b bigint, apart int, part bigint, sketch binary, n int"


def least_apart() -> float:
    """The share of bits in which two sets at the least similarity differ."""
    jaccard = LEAST[0] / LEAST[1]
    return acos(2 * jaccard / (1 + jaccard)) / pi


def _cut(bits: int = SKETCH * 8) -> int:
    p = least_apart()
    return int(p * bits + 4 * sqrt(bits * p * (1 - p)))


#: Bits of whole fingerprints that may differ, and of those of sets too small for the mean to hold.
FAR, SMALL, FAR_SMALL = _cut(WIDTH), 64, 190


def fingerprint(found: np.ndarray) -> bytes:
    """``found``: the set as 64-bit hashes."""
    ones = np.zeros(WIDTH, np.int64)
    for k in range(0, len(found), 255):
        x = found[k : k + 255].view(np.uint64)[:, None] ^ _SALTS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).tobytes()


def keyed_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, node, n, fp`` of every row; the fingerprint is null where the task has
    had that set."""
    texts = docs.select(
        docs[id_col].alias("doc_id"), text_key(docs, text_col).alias("text_key"), docs[text_col].cast("binary").alias("text")
    )

    def start():
        had: set[int] = set()

        def first(name: int, found: np.ndarray) -> bytes | None:
            if name in had:
                return None
            if len(had) >= 1 << 20:
                had.clear()
            had.add(name)
            return fingerprint(found)

        def work(batch: dict) -> dict:
            made = [shingles(t or b"") for t in batch["text"]]
            names = [node(s) for s in made]
            return {
                "doc_id": batch["doc_id"],
                "text_key": batch["text_key"],
                "node": names,
                "n": [len(s) for s in made],
                "fp": [first(k, s) for k, s in zip(names, made)],
            }

        return work

    kind = dict(texts.dtypes)["doc_id"]
    return map_texts(texts, f"doc_id {kind}, text_key binary, node bigint, n int, fp binary", start)


def _bits(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), WIDTH // 8), axis=1)


def partition(sample: np.ndarray, n: int, budget: int = BUDGET) -> list[tuple[np.ndarray, int]]:
    """Parts (bit numbers) and their thresholds for ``n`` sets; ``sample``: rows of bits."""
    width = min(40, max(8, (int(n) // RUN).bit_length()))
    parts = WIDTH // width
    if len(sample) > 1:
        centred = sample - sample.mean(axis=0)
        spread = np.sqrt((centred**2).sum(axis=0))
        alike = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-12)
    else:
        alike = np.zeros((WIDTH, WIDTH))
    left, groups = np.ones(WIDTH, bool), []
    for _ in range(parts):
        to = np.where(left, alike[:, left].sum(axis=1), -1.0)
        group = [int(to.argmax())]
        left[group[0]] = False
        near = alike[group[0]].copy()
        while len(group) < width:
            group.append(int(np.where(left, near, -1.0).argmax()))
            left[group[-1]] = False
            near += alike[group[-1]]
        groups.append(np.array(sorted(group)))
    # What a part costs per set at each threshold, and what it adds to -ln(chance of a miss).
    a, b = np.triu_indices(min(len(sample), 512), 1)
    p, options = least_apart(), []
    for group in groups:
        own_bits = sample[:, group]
        differ = (own_bits[a] != own_bits[b]).sum(axis=1) if len(a) else np.zeros(0, int)
        own = {-1: (0.0, 0.0)}
        for t in (0, 1):
            reach = sum(comb(width, d) for d in range(t + 1))
            share = max(reach / 2**width, float((differ <= 2 * t).mean()) if len(differ) else 0.0)
            found = sum(comb(width, d) * p**d * (1 - p) ** (width - d) for d in range(t + 1))
            own[t] = (reach * ROW_COST + min(n, BEFORE * 2**width) / 2 * share * PAIR_COST, -log(1 - found))
        options.append(own)
    return [(g, t) for g, t in zip(groups, allocate(options, budget * ROW_COST)) if t >= 0]


def allocate(options: list[dict[int, tuple[float, float]]], budget: float, steps: int = 600) -> list[int]:
    """A threshold per part (cost, gain): those of the largest gain within the budget. Costs are
    rounded up to ``steps`` parts of it; leaving a part out costs nothing."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in options:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (got, chosen) in best.items():
            for t, (cost, gain) in part.items():
                now = spent + -int(-cost / budget * steps // 1)
                if now <= steps and (now not in step or got + gain > step[now][0]):
                    step[now] = (got + gain, (*chosen, t))
        best = step
    return list(max(best.values())[1])


def part_rows(nodes: DataFrame, parts: list[tuple[np.ndarray, int]]) -> DataFrame:
    """The rows under which each set (node, n, fp) is found."""
    out = nodes.sparkSession.createDataFrame([], ROWS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                piece = batch.slice(k, 2000)
                fps = piece.column("fp").to_pylist()
                bits = _bits(fps).astype(np.int64)
                for i, (group, t) in enumerate(parts):
                    value = bits[:, group] @ (np.int64(1) << np.arange(len(group))) | np.int64(i << 48)
                    at = i * 5 % (WIDTH // 8 // SKETCH) * SKETCH
                    sketch = [fp[at : at + SKETCH] for fp in fps]
                    for flip in [0, *(1 << np.arange(len(group)) if t else ())]:
                        made = [pa.array(value ^ np.int64(flip)), pa.array(sketch, pa.binary()), piece.column("node"), piece.column("n")]
                        yield pa.RecordBatch.from_arrays(made, names=["part", "sketch", "node", "n"])

    return nodes.select("node", "n", "fp").mapInArrow(run, out)


def _words(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), SKETCH // 8)


def _long_enough(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * LEAST[1] >= LEAST[0] * np.maximum(n, m)


def meet(rows: DataFrame, before: int = BEFORE) -> DataFrame:
    """Each row's nearest candidate ``a, b, apart`` among the ``before`` rows before it under one value;
    without ``apart``, links that connect what further candidates connect. Rows that may have more of
    them (``part`` not null) come along."""
    out = rows.sparkSession.createDataFrame([], MET).schema
    cut = _cut()

    def compared(part, words, name, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for d in range(1, min(before, len(part) - 1) + 1):
            i = np.flatnonzero(part[d:] == part[:-d])
            if not len(i):
                break
            far = np.bitwise_count(words[i + d] ^ words[i]).sum(axis=1)
            good = (far <= cut) & (name[i + d] != name[i]) & _long_enough(n[i + d], n[i])
            found.append((i[good] + d, i[good], far[good]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def met(table: pa.Table, cut_off: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, none = to_arrow_schema(out), lambda k, kind: pa.nulls(k, kind)
        part, name, n = (table.column(c).to_numpy() for c in ("part", "node", "n"))
        sketch, n = table.column("sketch").to_pylist(), n.astype(np.int64)
        x, y, far = compared(part, _words(sketch), name, n)
        order = np.lexsort((name[y], far, x))
        x, y, far = x[order], y[order], far[order]
        nearest = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
        forest = Forest(np.arange(len(part)))
        forest.link(x[nearest], y[nearest])
        tops = np.unique(forest.root)
        forest.link(x, y)
        tops = tops[forest.root[tops] != tops]
        for a, b, apart in (
            (name[x[nearest]], name[y[nearest]], pa.array(far[nearest].astype(np.int32))),
            (name[tops], name[forest.root[tops]], none(len(tops), pa.int32())),
        ):
            k = len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), apart, none(k, pa.int64()), none(k, pa.binary()), none(k, pa.int32())], schema=arrow
            )
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(begin, len(part)))
        run = np.repeat(np.arange(len(begin)), size)
        whole = size > before + 1
        whole[0] |= cut_off[0]
        whole[-1] |= cut_off[1]
        at = np.flatnonzero(whole[run])
        k = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[at]), none(k, pa.int64()), none(k, pa.int32()), pa.array(part[at]), pa.array([sketch[i] for i in at], pa.binary()), pa.array(n[at].astype(np.int32))], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole values at a time; what a batch or the task cuts off is handed on as it is."""
        held, begun = [], True
        for batch in batches:
            held.append(batch)
            if (rows := sum(b.num_rows for b in held)) < 1 << 13:
                continue
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            last = int(np.searchsorted(part, part[-1]))
            if last:
                yield from met(table.slice(0, last), (begun, False))
                held, begun = table.slice(last).combine_chunks().to_batches(), False
            elif rows >= 1 << 15:
                yield from met(table, (True, True))
                held, begun = [], True
        if sum(b.num_rows for b in held):
            yield from met(pa.Table.from_batches(held), (begun, True))

    return rows.repartitionByRange("part", "sketch").sortWithinPartitions("part", "sketch").mapInArrow(run, out)


def _dealt(rows: DataFrame, group: str, heavy: int) -> DataFrame:
    """Rows (node, root, ...) of the groups that have several roots, with ``main`` (the most common
    root is a row's own), ``own`` and ``share``: those rows lie in one share, others in all."""
    by_root = rows.groupBy(group, "root").count()
    mixed = by_root.groupBy(group).agg(
        F.sum("count").alias("total"), F.max(F.struct("count", "root")).getField("root").alias("most"), F.count(F.lit(1)).alias("roots")
    )
    mixed = mixed.where("roots > 1").select(group, "most", F.ceil(F.col("total") / heavy).cast("int").alias("shares"))
    placed = rows.join(mixed, group).withColumn("own", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    placed = placed.withColumn("main", F.col("root") == F.col("most"))
    everywhere = F.sequence(F.lit(0), F.col("shares") - 1)
    return placed.withColumn("share", F.explode(F.when(F.col("main"), F.array("own")).otherwise(everywhere))).drop("most", "shares")


def _groups(rows: DataFrame, group: str, out: str, work, most: int) -> DataFrame:
    """Rows of a group and share meet in a task, which holds some ``most`` rows beside them."""
    schema = rows.sparkSession.createDataFrame([], out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held = to_arrow_schema(schema), []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, share = (table.column(c).to_numpy() for c in (group, "share"))
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (share[1:] != share[:-1])]))
            for x, y in zip(begin, np.append(begin[1:], len(key))):
                made = work(table.slice(x, y - x), int(share[x]))
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow)], schema=arrow)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                key, share = (table.column(c).to_numpy() for c in (group, "share"))
                last = np.flatnonzero((key != key[-1]) | (share != share[-1]))
                if len(last):
                    yield from done(table.slice(0, last[-1] + 1))
                    held = table.slice(last[-1] + 1).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from done(pa.Table.from_batches(held))

    return rows.repartition(group, "share").sortWithinPartitions(group, "share").mapInArrow(run, schema)


def _meetings(words: np.ndarray, table: pa.Table, share: int, cut) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of different roots that are near enough, each in one share only."""
    name, n, root, own, main = (table.column(c).to_numpy() for c in ("node", "n", "root", "own", "main"))
    n, main = n.astype(np.int64), main.astype(bool)
    some = np.flatnonzero(~main)
    step = max(1, (1 << 20) // len(name))
    for k in range(0, len(some), step):
        x = some[k : k + step]
        far = np.bitwise_count(words[x][:, None] ^ words[None]).sum(axis=2)
        good = (far <= cut(n[x][:, None], n[None])) & (root[x][:, None] != root[None]) & _long_enough(n[x][:, None], n[None])
        good &= main[None] | ((name[x][:, None] < name[None]) & (own[x] == share)[:, None])
        i, j = np.nonzero(good)
        yield x[i], j, far[i, j]


def across(full: DataFrame, roots: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Candidates between sets of different components under the values of ``full`` (part, sketch,
    node, n), as a forest ``a, b`` of the same connected parts."""
    rooted = full.join(roots, "node", "left").select("part", "sketch", "node", "n", F.coalesce("root", "node").alias("root"))
    cut = _cut()

    def work(table: pa.Table, share: int) -> tuple[np.ndarray, np.ndarray]:
        forest = Forest(table.column("node").to_numpy())
        for i, j, _ in _meetings(_words(table.column("sketch").to_pylist()), table, share, lambda n, m: cut):
            forest.link(i, j)
        return forest.links()

    return _groups(_dealt(rooted, "part", heavy), "part", "a bigint, b bigint", work, 1 << 15)


def verified_blocks(forest: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, made: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect exactly those sets of different components within a tree of
    ``forest`` (a, b) that are candidates by their whole fingerprints and similar enough."""
    trees = components(forest).withColumnRenamed("root", "block")
    ends = trees.union(trees.select(F.col("block").alias("node"), "block").distinct())
    rooted = ends.join(roots, "node", "left").select("node", "block", F.coalesce("root", "node").alias("root"))
    placed = write_once(rooted.join(nodes, "node"))
    members = _dealt(placed, "block", block)
    texts = _texts_of(ends.select("node"), docs, made)
    rows = members.join(texts, "node")

    def far_enough(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(np.minimum(n, m) < SMALL, FAR_SMALL, FAR)

    def work(table: pa.Table, share: int) -> tuple[np.ndarray, np.ndarray]:
        name, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        words = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(len(name), WIDTH // 64)
        texts, sets = table.column("text"), {}
        at = dict(zip(np.unique(root).tolist(), range(len(name))))
        place, up = [at[r] for r in root.tolist()], list(range(len(at)))

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def found(k: int) -> np.ndarray:
            if k not in sets:
                if len(sets) > 4 * block:
                    sets.clear()
                sets[k] = shingles(texts[k].as_py())
            return sets[k]

        num, den = LEAST
        a, b = [], []
        for i, j, far in _meetings(words, table, share, far_enough):
            for k in np.argsort(far, kind="stable").tolist():
                x, y = int(i[k]), int(j[k])
                p, q = top(place[x]), top(place[y])
                if p != q:
                    common = len(np.intersect1d(found(x), found(y), assume_unique=True))
                    if common * (num + den) >= num * (len(found(x)) + len(found(y))):
                        up[max(p, q)] = min(p, q)
                        a.append(int(name[x]))
                        b.append(int(name[y]))
        return np.array(a, np.int64), np.array(b, np.int64)

    rows = rows.select("block", "share", "node", "n", "fp", "root", "own", "main", "text")
    links = write_once(_groups(rows, "block", "a bigint, b bigint", work, 256))
    forget(placed)
    forget(texts)
    return links


def _texts_of(nodes: DataFrame, docs: DataFrame, made: DataFrame) -> DataFrame:
    """``node, text``: one text of each of ``nodes``."""
    named = write_once(made.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")))
    texts = write_once(docs.where(marks(named, "text_key")).join(named, "text_key").groupBy("node").agg(F.first("text").alias("text")))
    forget(named)
    return texts


def similar(pairs: DataFrame, docs: DataFrame, made: DataFrame) -> DataFrame:
    """``a, b, near`` of distinct ``pairs``: whether the whole sets are similar enough."""
    texts = _texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, made)
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    num, den = LEAST

    def start():
        last: dict = {}

        def known(name: int, text: bytes) -> np.ndarray:
            if name not in last:
                if len(last) > 64:
                    last.clear()
                last[name] = shingles(text)
            return last[name]

        def work(batch: dict) -> dict:
            near = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
                x, y = known(a, x), known(b, y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common * (num + den) >= num * (len(x) + len(y)))
            return {"a": batch["a"], "b": batch["b"], "near": near}

        return work

    found = write_once(map_texts(both.select("a", "b", "x", "y"), "a bigint, b bigint, near boolean", start))
    forget(texts)
    return found


def linked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, heavy: int = HEAVY, before: int = BEFORE, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """The keyed sets of every row, and ``node, root`` of the sets that found and verified pairs join."""
    made = write_once(keyed_sets(docs, id_col, text_col), TEXT_ROWS)
    nodes = write_once(made.where("fp IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp")))
    sample = nodes.select("fp").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    bits = _bits([bytes(r["fp"]) for r in sample]) if sample else np.zeros((0, WIDTH), np.uint8)
    parts = partition(bits, nodes.count(), budget)
    met = write_once(meet(part_rows(nodes, parts), before))
    found = write_once(met.where("part IS NULL AND a <> b").groupBy("a", "b").agg(F.min("apart").alias("apart")))
    full = met.where("part IS NOT NULL").select("part", "sketch", F.col("a").alias("node"), "n").distinct()
    whole = docs.select(text_key(docs, text_col).alias("text_key"), docs[text_col].cast("binary").alias("text"))
    best = found.where("apart IS NOT NULL").groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
    links = similar(write_once(best.select("a", "b")), whole, made).where("near").select("a", "b")
    roots = components(links)
    forest = write_once(apart(found, roots).union(across(full, roots, heavy)))
    if not forest.isEmpty():
        roots = components(links.union(verified_blocks(forest, roots, nodes, whole, made, block)))
    for table in (nodes, met, found, forest):
        forget(table)
    return made, roots


def near_copies(docs: DataFrame, *columns: str, **bounds: int) -> DataFrame:
    """``doc_id, text_key, component`` of every row: rows have the same component if a chain of
    pairs that were found and verified joins theirs."""
    made, roots = linked(docs, *columns, **bounds)
    return made.join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("component"))
