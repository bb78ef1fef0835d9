"""10. Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` points on a 64-bit ring; a key belongs to the next point
clockwise. A shard takes keys up to its bound; the others continue clockwise to the next
point whose shard has room. The bounds add up to the number of rows, so shard sizes differ
by one at most (the law ``rows``).

Only counts per arc of the ring go to the driver (shards x nodes x ``SUBS`` numbers, whatever
the input); there the overflow is planned for whole arcs, as runs of ranks. A row's rank is
its place among the rows of its arc, and shard and slot follow from it by binary search. The
texts are not shuffled: their size and CRC are taken first.

Null keys hash like any other value; a null text has no bytes. Repeated rows are placed one
by one; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES, SUBS = 128, 4


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def points(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places on the ring and the shard of each."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), nodes)
    copy = np.tile(np.arange(nodes, dtype=np.uint64), shards)
    place = _mix(shard * np.uint64(1_000_003) + _mix(copy + np.uint64(1)))
    order = np.lexsort((shard, place))
    return place[order], shard[order].astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """Runs of row numbers: from ``first[i]`` on, rows go to ``shard[i]`` from slot ``slot[i]``
    on. ``base`` is the number of rows before each sub-arc."""

    base: np.ndarray
    first: np.ndarray
    shard: np.ndarray
    slot: np.ndarray


def plan(counts: np.ndarray, owner: np.ndarray, shards: int, subs: int = SUBS) -> Plan:
    """``counts``: rows by arc and sub-arc, in order; ``owner``: the shard of each arc."""
    total = int(counts.sum())
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    arcs = counts.reshape(-1, subs).sum(axis=1)
    begin = np.concatenate([[0], np.cumsum(arcs)[:-1]])
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, runs, over = [0] * shards, [], []

    def give(at: int, n: int, shard: int) -> int:
        taken = min(n, room[shard])
        if taken:
            runs.append((at, shard, used[shard]))
            room[shard] -= taken
            used[shard] += taken
        return taken

    for arc, (at, n) in enumerate(zip(begin.tolist(), arcs.tolist())):
        taken = give(at, n, int(owner[arc]))
        if taken < n:
            over.append((arc, at + taken, n - taken))
    for arc, at, n in over:
        while n:
            arc = (arc + 1) % len(arcs)
            taken = give(at, n, int(owner[arc]))
            at, n = at + taken, n - taken
    runs.sort()
    first, shard, slot = (np.array([r[i] for r in runs], np.int64) for i in range(3))
    return Plan(base, first, shard, slot)


def assign(docs: DataFrame, shards: int = 40, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    place, owner = points(shards, nodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        at = np.searchsorted(place, h.to_numpy().view(np.uint64), side="left") % len(place)
        return pd.Series(at.astype(np.int32))

    key = docs[id_col]
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(key).alias("_hash"),
    ).withColumn(
        # Different texts under one key, or under none, lie in different cells of their arc.
        "_sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SUBS)).cast("int")
    ).withColumn("_cell", arc_of("_hash") * SUBS + F.col("_sub"))
    counts = np.zeros(len(place) * SUBS, np.int64)
    for r in rows.groupBy("_cell").count().collect():
        counts[r["_cell"]] = r["count"]
    made = plan(counts, owner, shards)

    @F.pandas_udf("shard int, slot bigint")
    def place_of(cell: pd.Series, rank: pd.Series) -> pd.DataFrame:
        number = made.base[cell.to_numpy()] + rank.to_numpy() - 1
        run = np.searchsorted(made.first, number, side="right") - 1
        return pd.DataFrame(
            {"shard": made.shard[run].astype(np.int32), "slot": made.slot[run] + number - made.first[run]}
        )

    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", "doc_id", "text_crc32", "size"))
    placed = rows.withColumn("_rank", rank).withColumn("_at", place_of("_cell", "_rank"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_at.shard").alias("shard"),
        F.col("_at.slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
