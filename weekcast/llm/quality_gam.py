"""3. Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins at quantiles of the training rows. In each round
the model goes through the features in turn: a shallow tree over one feature's bins is fitted
to what is still unexplained, and a small share of it is added to that feature's lookup
table. The pairs of features that explain most of the rest then get tables of their own, in
the same way. A score is the sum of table entries, looked up for whole batches at once.

The model is fitted on at most ``most_rows`` labelled rows (a documented bound, drawn by a
hash of the key, the same at every input size); every document is scored, on its whole text.
Features come from the text alone.

A null text has the features of an empty one. Labels without a doc_id or a quality are left
out; a repeated label counts once, with its mean rounded up at one half. Without labels of
both kinds the score is the share of ones among them, or 1 if there are none. Repeated
documents give one row each and an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import map_texts, started, write_once
from weekcast.llm.weak_rules import measure

MOST_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, LEAVES, L2 = 150, 0.1, 4, 1.0

FEATURES = (
    "log_words", "word_chars", "symbols", "dup_lines", "repeats", "line_words", "ended_lines",
    "distinct", "letters", "upper", "shouts", "bars", "digits", "stops", "top_word",
)
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def features(text: bytes) -> list[float]:
    words, chars, symbols, dup, repeats, lines, ended, distinct, letters = measure(text)
    n, size = max(words, 1), max(chars, 1)
    most = 0
    if words:
        split = text.split()
        values, counts = np.unique(np.fromiter(map(hash, split), np.int64, words), return_counts=True)
        most = int(counts.max())
    return [
        float(np.log1p(words)),
        chars / n,
        symbols / n,
        dup / max(lines, 1),
        repeats / n,
        words / max(lines, 1),
        ended / max(lines, 1),
        distinct / n,
        letters / size,
        (len(text) - len(text.translate(None, _UPPER))) / size,
        text.count(b"!") / n,
        text.count(b"|") / n,
        (len(text) - len(text.translate(None, _DIGITS))) / size,
        text.count(b".") / n,
        most / n,
    ]


@dataclass
class Gam:
    """``tables[i]``: score by bin of feature ``i``; ``pairs``: (i, j, table by both bins)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, i], side="right")]
        bins = {i: np.searchsorted(self.coarse[i], x[:, i], side="right") for p in self.pairs for i in p[:2]}
        for i, j, table in self.pairs:
            total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + L2)


def tree_over_bins(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A tree of at most ``leaves`` runs of bins, grown by the best split each time; the
    step of every bin. g, h: sums of gradients and of curvatures by bin."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, -1
        more = _gain(cg[at] - cg[a], ch[at] - ch[a]) + _gain(cg[b] - cg[at], ch[b] - ch[at])
        more = more - _gain(cg[b] - cg[a], ch[b] - ch[a])
        k = int(more.argmax())
        return float(more[k]), int(at[k])

    runs = [(0, len(g))]
    while len(runs) < leaves:
        found = [(*best(a, b), i) for i, (a, b) in enumerate(runs)]
        gain, at, i = max(found)
        if gain <= 1e-9:
            break
        a, b = runs[i]
        runs[i : i + 1] = [(a, at), (at, b)]
    step = np.zeros(len(g))
    for a, b in runs:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + L2)
    return step


def tree_over_grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis: its gain, and the step of every cell."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, right, down, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, right - a, down - a, all_ - right - down + a]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = quarters(cg), quarters(ch)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs)) - _gain(cg[-1, -1], ch[-1, -1])
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(g)
    for k, (rows, columns) in enumerate(((slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)), (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None)))):
        step[rows, columns] = gs[k][r, c] / (hs[k][r, c] + L2)
    return float(gain[r, c]), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    n, width = x.shape
    cuts, coarse = [_cuts(x[:, i], BINS) for i in range(width)], [_cuts(x[:, i], PAIR_BINS) for i in range(width)]
    mean = float(y.mean()) if n else 1.0
    if not n or mean in (0.0, 1.0):
        base = float(np.log(np.clip(mean, 1e-9, 1 - 1e-9) / (1 - np.clip(mean, 1e-9, 1 - 1e-9))))
        return Gam(base, cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [])
    base = float(np.log(mean / (1 - mean)))
    bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, b in enumerate(bins):
            g, h = slopes()
            step = RATE * tree_over_bins(np.bincount(b, g, len(tables[i])), np.bincount(b, h, len(tables[i])))
            tables[i] += step
            total += step[b]
    fine = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = fine[i] * shape[1] + fine[j]
        g, h = slopes()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    gains = sorted(((tree_over_grid(*grid(i, j)[:2])[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:pairs] if gain > 0]
    for _ in range(rounds):
        for i, j, table in chosen:
            g, h, cell = grid(i, j)
            step = RATE * tree_over_grid(g, h)[1]
            table += step
            total += step.ravel()[cell]
    return Gam(base, cuts, tables, coarse, chosen)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))

    def start():
        def work(batch: dict) -> dict:
            return {"doc_id": batch["doc_id"], "x": [features(t or b"") for t in batch["text"]]}

        return work

    return map_texts(texts, f"doc_id {dict(texts.dtypes)['doc_id']}, x array<double>", start)


def train(table: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Gam:
    """From a feature table and ``labels`` (doc_id, quality), held-out keys left out."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .where(~held_out(F.col("doc_id")))
    )
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = table.join(drawn, "doc_id").select("doc_id", "x", "y").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def score(table: DataFrame, model: Gam) -> DataFrame:
    """``doc_id, score`` of a feature table."""

    def start():
        def work(batch: dict) -> dict:
            x = np.array(batch["x"], float).reshape(-1, len(FEATURES))
            return {"doc_id": batch["doc_id"], "score": model.score(x)}

        return work

    return map_texts(table, f"doc_id {dict(table.dtypes)['doc_id']}, score double", start)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``. The features are written once: training and
    scoring read them, not the texts."""
    table = write_once(feature_table(docs))
    scored = score(table, train(table, labels, most_rows))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the model scores at ``threshold`` or more, columns as they
    are. The model is fitted on the features of the labelled rows alone; then every text is
    scored where it lies, without a join."""
    wanted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct()
    drawn = wanted.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)
    model = train(feature_table(docs.join(F.broadcast(drawn), "doc_id", "left_semi")), labels)

    @F.arrow_udf("double")
    def score_of(text: pa.Array) -> pa.Array:
        started(lambda: None)
        x = np.array([features(t.as_py() or b"") for t in text], float).reshape(-1, len(FEATURES))
        return pa.array(model.score(x))

    return docs.where(score_of(docs["text"].cast("binary")) >= threshold)
