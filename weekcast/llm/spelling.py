"""12. Spelling variants: words one edit apart, and the frequent form each stands for.

Words of the same half are compared in dense tiles: padded matrices of code points, column by
column, give every pair's common prefix and common suffix; two different words are one insertion,
deletion or replacement apart just where both lengths together reach the longer length minus one.
A word of length L meets the words of length L and of length L + 1 that share its first ``L // 2``
code points or its last ``L - L // 2``: one edit leaves one of the two as it is, so no pair is
missed. Groups of up to ``BAND`` words are compared along diagonals, all groups at once; larger
ones in tiles of ``TILE`` rows, and a group beyond that is dealt to several tasks, tile by tile.
A tile gives one row per word (how many near words, and the best one), never its pairs.

Words are runs of letters of whole texts, lower-cased (ASCII). ``noise`` deletes a code point of a
run where the crc32 of ``<doc_id>:<run>`` divides by it (None: leaves runs as they are). A null text
has no words; a null doc_id counts as an empty one. Repeated rows count as often as they are there;
an empty table gives an empty one. Ties between forms go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import forget, keyed_texts, slices, write_once

LETTERS = "A-Za-zÀ-ÿ"
BAND, TILE, COLUMNS = 48, 2048, 256
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words that a task counts before it hands them on.
HELD = 200_000


def words(docs: DataFrame, least: int = 7, noise: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of words of ``least`` code points or more: as counted over all rows."""
    texts = keyed_texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.col("text").cast("binary").alias("text"))
    out = docs.sparkSession.createDataFrame([], "word string, n bigint").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(f"[{LETTERS}]{{{least},}}").findall, Counter()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch):
                for d, text in zip(part.column("d").to_pylist(), part.column("text").to_pylist()):
                    own = Counter(find(text.translate(_LOWER).decode("utf-8", "replace"))) if text else {}
                    if noise:
                        begun = crc32(f"{d}:".encode())
                        for w, n in own.items():
                            h = crc32(w.encode(), begun)
                            if not h % noise:
                                k = h % len(w)
                                w = w[:k] + w[k + 1 :]
                                if len(w) < least:
                                    continue
                            held[w] += n
                    else:
                        held.update(own)
                    if len(held) > HELD:
                        yield made()
        yield made()

    return texts.mapInArrow(run, out).groupBy("word").agg(F.sum("n").alias("n"))


def halves(vocabulary: DataFrame) -> DataFrame:
    """Four rows per word: as one of its own length and as one of the length above the class,
    by its first and by its last code points. ``part`` names the group."""
    size = F.char_length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where("length > 0")
    half = F.expr("length div 2")
    first = F.substring(F.col("word"), F.lit(1), half)
    last = F.substring(F.col("word"), size - (F.col("length") - half) + 1, F.col("length") - half)
    sides = rows.select("word", "n", "length", F.explode(F.array(F.struct(F.lit(0).alias("side"), first.alias("same")), F.struct(F.lit(1).alias("side"), last.alias("same")))).alias("s"))
    return sides.select(F.xxhash64("length", "s.side", "s.same").alias("part"), "length", F.col("s.side").alias("side"), "word", "n")


def dealt(rows: DataFrame, tile: int) -> DataFrame:
    """Groups beyond ``tile`` rows are cut into shares, and each pair of shares is a part of its
    own: ``mine`` and ``other`` tell a row's share from the one it meets."""
    large = write_once(rows.groupBy("part").count().where(F.col("count") > tile).select("part", F.ceil(F.col("count") / tile).cast("int").alias("shares")))
    plain = F.lit(0)
    if large.isEmpty():
        return rows.withColumn("a", plain).withColumn("b", plain).withColumn("share", plain)
    small = rows.join(large, "part", "left_anti").withColumn("a", plain).withColumn("b", plain).withColumn("share", plain)
    hot = rows.join(large, "part").withColumn("share", F.pmod(F.xxhash64("word"), F.col("shares")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    hot = hot.select(*rows.columns, F.least("share", "other").alias("a"), F.greatest("share", "other").alias("b"), "share")
    return small.unionByName(hot)


def _matrix(texts: pa.Array, width: int, right: bool) -> np.ndarray:
    """Code points (all below 256), padded with zeros; ``right``: the last one in column 0."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("latin-1"), np.uint8)
    ends = np.cumsum(size)
    begin, column = ends - size, np.arange(width)
    at = (ends[:, None] - 1 - column) if right else (begin[:, None] + column)
    return np.where(column < size[:, None], flat[np.clip(at, 0, max(len(flat) - 1, 0))] if len(flat) else 0, 0).astype(np.uint8)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows that are broadcast against each other."""
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    same, length = np.ones(shape, bool), np.zeros(shape, np.uint16)
    for c in range(a.shape[-1]):
        same &= (a[..., c] == b[..., c]) & (a[..., c] != 0)
        length += same
        if c % 4 == 3 and not same.any():
            break
    return length


class _Group:
    """Rows of one class of lengths in one order; near pairs are added word by word."""

    def __init__(self, length: int, side: int, texts: pa.Array, n: np.ndarray):
        self.length, self.side, self.n = length, side, n
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        self.own = size == length
        # The shared half needs no comparison: columns begin behind it (or before it, from the end).
        half = length // 2
        self.same = half if side == 0 else length - half
        self.size = (size - self.same).astype(np.int64)
        self.left = _matrix(texts, length + 1, False)
        self.right = _matrix(texts, length + 1, True)
        if side == 0:
            self.forth, self.back = self.left[:, half:], self.right[:, : length + 1 - half]
        else:
            self.forth, self.back = self.left[:, : half + 1], self.right[:, self.same :]
        self.near = np.zeros(len(n), np.int64)
        self.best = np.full(len(n), len(n))
        # Places in the order of frequency, then of code points: the smallest is the best form.
        order = np.lexsort((pc.rank(texts, "ascending").to_numpy(), -n))
        self.place, self.of_place = np.empty(len(n), np.int64), order
        self.place[order] = np.arange(len(n))

    def _keep(self, i: np.ndarray, j: np.ndarray) -> None:
        """Of pairs whose prefix and suffix reach far enough, those that count here."""
        good = self.own[i] | self.own[j]
        good &= (self.left[i] != self.left[j]).any(axis=1)
        half = self.length // 2
        first = (self.left[i, :half] == self.left[j, :half]).all(axis=1)
        if self.side == 0:
            good &= first
        else:  # pairs that share both halves were met by their first ones; and a hash isn't a proof
            rest = self.length - half
            good &= ~first & (self.right[i, :rest] == self.right[j, :rest]).all(axis=1)
        i, j = i[good], j[good]
        for x, y in ((i, j), (j, i)):
            self.near += np.bincount(x, minlength=len(self.near))
            np.minimum.at(self.best, x, self.place[y])

    def band(self, part: np.ndarray, most: int) -> None:
        """Rows with the same part stand side by side: each with the 1st, 2nd, ... row after it."""
        for d in range(1, min(most, len(part))):
            i = np.flatnonzero(part[:-d] == part[d:])
            if not len(i):
                return
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], i[k : k + (1 << 16)] + d
                reach = _common(self.forth[x], self.forth[y]) + _common(self.back[x], self.back[y])
                near = reach >= np.maximum(self.size[x], self.size[y]) - 1
                self._keep(x[near], y[near])

    def tile(self, rows: np.ndarray, others: np.ndarray, alike: bool) -> None:
        """All pairs of two blocks of rows (``alike``: one block, each pair once)."""
        for a in range(0, len(rows), COLUMNS):
            for b in range(a if alike else 0, len(others), COLUMNS):
                x, y = rows[a : a + COLUMNS], others[b : b + COLUMNS]
                reach = _common(self.forth[x][:, None], self.forth[y][None]) + _common(self.back[x][:, None], self.back[y][None])
                near = reach >= np.maximum(self.size[x][:, None], self.size[y][None]) - 1
                i, j = np.nonzero(np.triu(near, 1) if alike and a == b else near)
                self._keep(x[i], y[j])


def _compare(batch: pa.Table, band: int) -> Iterator[pa.RecordBatch]:
    names = ("length", "side", "part", "a", "b", "share")
    length, side, part, a, b, share = (batch.column(c).to_numpy() for c in names)
    order = np.lexsort((share, b, a, part, side, length))
    if len(order) > 1:  # a word that meets no other needs no matrix
        same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in (length, side, part, a, b)])
        order = order[np.append(same, False) | np.append(False, same)]
    else:
        order = order[:0]
    texts = batch.column("word").combine_chunks().take(pa.array(order))
    n = batch.column("n").to_numpy()[order]
    length, side, part, a, b, share = (c[order] for c in (length, side, part, a, b, share))
    cut = (length[1:] != length[:-1]) | (side[1:] != side[:-1])
    for x, y in _runs(cut, len(order)):
        group = _Group(int(length[x]), int(side[x]), texts.slice(x, y - x), n[x:y])
        own = slice(x, y)
        runs = list(_runs((part[own][1:] != part[own][:-1]) | (a[own][1:] != a[own][:-1]) | (b[own][1:] != b[own][:-1]), y - x))
        number = np.repeat(np.arange(len(runs)), [v - u for u, v in runs])
        large = [(u, v) for u, v in runs if v - u > band or a[x + u] != b[x + u]]
        name = number.copy()
        for u, v in large:
            name[u:v] = -np.arange(1, v - u + 1) - u  # no two alike: left out of the band
        group.band(name, band)
        for u, v in large:
            rows = np.arange(u, v)
            if a[x + u] == b[x + u]:
                group.tile(rows, rows, True)
            else:
                lower = share[x + u : x + v] == a[x + u]
                group.tile(rows[lower], rows[~lower], False)
        some = np.flatnonzero(group.near)
        if len(some):
            best = group.of_place[group.best[some]]
            own_texts = texts.slice(x, y - x)
            yield pa.RecordBatch.from_arrays(
                [own_texts.take(pa.array(some)), pa.array(group.near[some]), own_texts.take(pa.array(best)), pa.array(group.n[best], pa.int64())],
                names=["word", "near", "best", "best_n"],
            )


def _runs(cut: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return zip(bounds, bounds[1:]) if n else iter(())


def near_words(vocabulary: DataFrame, tile: int = TILE, band: int = BAND) -> DataFrame:
    """``word, n_near, best, best_n`` of words that have a near one. ``vocabulary``: word, n."""
    spark = vocabulary.sparkSession
    out = spark.createDataFrame([], "word string, near bigint, best string, best_n bigint").schema
    rows = dealt(halves(vocabulary), tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part: a part is compared when the next one begins and enough rows
        are held, so that many small parts go through numpy together."""
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 1 << 16 or sum(b.nbytes for b in held) > 16 << 20:
                table = pa.Table.from_batches(held)
                keys = [table.column(c).to_numpy() for c in ("part", "a", "b")]
                same = np.logical_and.reduce([k == k[-1] for k in keys])
                last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if last:
                    yield from _compare(table.slice(0, last).combine_chunks(), band)
                    rest = table.slice(last).combine_chunks()
                    held, count = rest.to_batches(), rest.num_rows
        if count:
            yield from _compare(pa.Table.from_batches(held).combine_chunks(), band)

    met = rows.repartition("part", "a", "b").sortWithinPartitions("part", "a", "b").mapInArrow(run, out)
    best = F.min_by(F.struct("best", "best_n"), F.struct((-F.col("best_n")).alias("n"), "best"))
    found = met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x"))
    return found.select("word", "n_near", "x.best", "x.best_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` by jumping twice as far each round. ``forms``: word, form; a form is more
    frequent than its word by a factor, so rounds grow with the logarithm of a logarithm."""
    now = write_once(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = write_once(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done = new.where("moved").isEmpty()
        forget(now)
        now = new.select("word", "root")
        if done:
            return now


def variants(
    docs: DataFrame,
    least: int = 7,
    least_n: int = 2,
    factor: int = 10,
    noise: int | None = 31,
    tile: int = TILE,
    band: int = BAND,
    **columns,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with ``least_n`` occurrences: its form
    is the most frequent near word, if that is ``factor`` times as frequent."""
    vocabulary = write_once(words(docs, least, noise, **columns).where(F.col("n") >= least_n))
    near = write_once(near_words(vocabulary, tile, band))
    stands = F.col("best_n") >= factor * F.col("n")
    known = write_once(
        vocabulary.join(near, "word", "left").select(
            "word", F.when(stands, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("best_n")).alias("form_n")
        )
    )
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
