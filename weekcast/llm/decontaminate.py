"""4. Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte for byte: A-Z lower-cased, ASCII characters that are no letter or
digit turned into spaces, so every offset in the normalised text is one of the original.
A run of ``WINDOW`` consecutive words of a benchmark item (all words of a shorter item) is a
window; one automaton over half windows scans each text once, and what surrounds a find is
compared, so a text's words are hit just where it holds whole windows.

The automaton is built in the tasks from the benchmark's texts, of which a task never gets
more than ``PART_BYTES`` and one item at once, equal items counted once: a larger benchmark is
dealt into parts, and the texts are scanned once for each, with the finds so far written
between the scans.

A null text has no words. A null or repeated item_id: the item's windows count as hits, but
a null is not listed among the items, and an id is listed once. Repeated documents give one
row each; an empty table gives an empty one; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import map_texts, write_once

WINDOW = 10
#: Bytes of different benchmark texts in an automaton; it takes some fifty times as much memory.
PART_BYTES = 4 << 20


def _table() -> bytes:
    kept = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    lower = {b: b + 32 for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return bytes(lower.get(b, b if b in kept else 32) for b in range(256))


TABLE = _table()


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def padded(found: Sequence[bytes]) -> str:
    """Words with one space around each; Latin-1, so a character is a byte."""
    return f" {b' '.join(found).decode('latin-1')} "


class Scanner:
    """The automaton over blocks of the items' words, (item id or None, text) pairs.

    Blocks of half a window stand side by side in an item, so every window holds a whole one: a
    tenth of the nodes that all windows would take. Where a block is met, the words around it are
    compared, and if item and text agree on a whole window or more, all of those words are hit. An
    item shorter than a window is one block."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            if found := tuple(words(text)):
                owners.setdefault(found, set()).update([] if item is None else [item])
        self.window, self.size = window, (window + 1) // 2
        self.items = list(owners.items())
        blocks: dict[str, list[tuple[int, int]]] = {}
        for i, (found, _) in enumerate(self.items):
            if len(found) < window:
                blocks.setdefault(padded(found), []).append((i, -1))
            else:
                for at in range(0, len(found) - self.size + 1, self.size):
                    blocks.setdefault(padded(found[at : at + self.size]), []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for pattern, places in blocks.items():
            self.automaton.add_word(pattern, (pattern.count(" ") - 1, len(pattern), places))
        self.empty = not blocks
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words as (first, one past the last), joined and in order; items."""
        if self.empty or not found:
            return [], set()
        text = padded(found)
        runs: list[tuple[int, int]] = []
        hit: set[str] = set()
        done: dict[tuple[int, int], int] = {}
        spaces = None
        for end, (n, size, places) in self.automaton.iter(text):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32).tolist()
            first = bisect_left(spaces, end + 1 - size)
            for i, at in places:
                own, ids = self.items[i]
                if at < 0:
                    runs.append((first, first + n))
                    hit |= ids
                elif done.get((i, first - at), -1) <= first:
                    a, b, shift = first, first + n, at - first
                    while a and a + shift and found[a - 1] == own[a - 1 + shift]:
                        a -= 1
                    while b < len(found) and b + shift < len(own) and found[b] == own[b + shift]:
                        b += 1
                    done[i, first - at] = b
                    if b - a >= self.window:
                        runs.append((a, b))
                        hit |= ids
        return joined(runs), hit


_known: list = [None, 0, None]


def scanner_of(items: list[tuple[str | None, bytes]], window: int) -> Scanner:
    """The scanner of a broadcast list, made once in a Python worker."""
    if _known[0] is not items or _known[1] != window:
        _known[:] = [items, window, Scanner(items, window)]
    return _known[2]


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of runs of words."""
    if not runs:
        return []
    inside = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in runs]


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> list[Callable[[], list[tuple[str | None, bytes]]]]:
    """Each part's (item, text) pairs, when called: about ``part_bytes`` and one item at most."""
    bench = benchmark.select(
        benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("binary").alias("words")
    ).where("words IS NOT NULL").distinct()
    total = bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = total // part_bytes + 1

    def share(part: int) -> list[tuple[str | None, bytes]]:
        rows = bench.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == part).collect()
        return [(r["item"], bytes(r["words"])) for r in rows]

    return [partial(share, k) for k in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, and ``spans``: the
    byte offsets of the hit passages in the original text. No shuffle."""
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    shares = benchmark_parts(benchmark, part_bytes)
    key = dict(texts.dtypes)["doc_id"]
    runs = "runs array<struct<first:bigint,end:bigint>>, items array<string>"
    state = texts.selectExpr("*", "CAST(array() AS array<struct<first:bigint,end:bigint>>) AS runs", "CAST(array() AS array<string>) AS items")
    for part, share in enumerate(shares):
        shared, last = docs.sparkSession.sparkContext.broadcast(share()), part == len(shares) - 1

        def start(shared=shared, last=last):
            scanner = scanner_of(shared.value, window)

            def look(batch: dict) -> tuple[list, list, list]:
                split = [words(t or b"") for t in batch["text"]]
                found = [scanner.scan(w) for w in split]
                before = [[(r["first"], r["end"]) for r in x] for x in batch["runs"]]
                return (
                    split,
                    [joined([*x, *y[0]]) if x else y[0] for x, y in zip(before, found)],
                    [{*x, *y[1]} for x, y in zip(batch["items"], found)],
                )

            def more(batch: dict) -> dict:
                _, hits, items = look(batch)
                pairs = [[{"first": a, "end": b} for a, b in x] for x in hits]
                return batch | {"runs": pairs, "items": [sorted(x) for x in items]}

            def ready(batch: dict) -> dict:
                split, hits, items = look(batch)
                n_hit = [sum(b - a for a, b in x) for x in hits]
                spans = [byte_spans(t or b"", x) for t, x in zip(batch["text"], hits)]
                return {
                    "doc_id": batch["doc_id"],
                    "n_words": [len(w) for w in split],
                    "n_hit": n_hit,
                    "n_items": [len(x) for x in items],
                    "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
                    "contaminated": [n > 0 for n in n_hit],
                    "spans": [[{"first": a, "end": b} for a, b in x] for x in spans],
                }

            return ready if last else more

        if not last:
            state = write_once(map_texts(state, f"doc_id {key}, text binary, {runs}", start))
            shared.destroy()
        else:
            state = map_texts(
                state,
                f"doc_id {key}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string,"
                " contaminated boolean, spans array<struct<first:bigint,end:bigint>>",
                start,
            )
    return state


def _hit(shared, window: int):
    @F.pandas_udf("boolean")
    def hit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = scanner_of(shared.value, window)
        for texts in parts:
            yield pd.Series([bool(scanner.scan(words(t or b""))[0]) for t in texts], dtype=bool)

    return hit


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, columns as they are; each text is scanned where it
    lies."""
    shares = benchmark_parts(benchmark, part_bytes)
    for part, share in enumerate(shares):
        shared = docs.sparkSession.sparkContext.broadcast(share())
        docs = docs.where(~_hit(shared, window)(docs[text_col].cast("binary")))
        if part < len(shares) - 1:
            docs = write_once(docs)
            shared.destroy()
    return docs
