"""7. Quality rules as weak supervision.

Each rule votes good, bad, or abstains. Expectation-maximisation over the counts of vote
patterns (at most three to the number of rules, whatever the number of documents) estimates
how often each rule is right and how many documents are good; the posterior probability of
good decides, in place of a filter that all rules must pass.

A null text has no words. Every figure comes from the whole text. Repeated documents give
one row each and an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import map_texts, write_once

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that begin no character
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha()) + _INSIDE

FIGURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " n_lines bigint, n_ended_lines bigint, n_distinct_words bigint, n_letters bigint"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29)))
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _SPACES + _INSIDE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(x.rstrip().endswith((b".", b"!", b"?", b'"', b":")) for x in lines),
        len(set(words)),
        len(text.translate(None, _NO_LETTERS)),
    )


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    names = [part.split()[0] for part in FIGURES.split(",")]

    def start():
        def work(batch: dict) -> dict:
            rows = [measure(t or b"") for t in batch["text"]]
            return {"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    return map_texts(texts, f"doc_id {dict(texts.dtypes)['doc_id']}, {FIGURES}", start)


@dataclass(frozen=True)
class Vote:
    """SQL conditions over the figures; where neither holds, the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Vote("length", "n_words >= 50", "n_words < 20"),
    Vote("symbols", "n_words > 0 AND n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    Vote("lines", "n_lines >= 3 AND n_dup_lines = 0", "n_dup_lines > 0.3 * n_lines"),
    Vote("repeats", "n_words >= 20 AND n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    Vote("word_length", "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Vote("variety", "n_words >= 20 AND n_distinct_words >= 0.4 * n_words", "n_words >= 20 AND n_distinct_words < 0.2 * n_words"),
    Vote("letters", "word_chars > 0 AND n_letters >= 0.85 * word_chars", "n_letters < 0.7 * word_chars"),
    Vote("sentences", "n_lines > 0 AND n_ended_lines >= 0.5 * n_lines", "n_lines >= 5 AND n_ended_lines < 0.1 * n_lines"),
)

BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def votes(rules: tuple[Vote, ...] = RULES) -> Column:
    """One array of 1 (good), -1 (bad) and 0 (abstains)."""
    return F.array(*(F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END") for r in rules))


@dataclass(frozen=True)
class Fit:
    prior: float
    accuracy: tuple[float, ...]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Fit:
    """EM with one accuracy per rule. A rule is held to be right more often than not, so
    good and bad can't change places; with no documents the start values stay."""
    prior, acc = 0.8, np.full(patterns.shape[1] if patterns.ndim == 2 else 0, 0.8)
    spoke = patterns != 0
    said = (spoke * counts[:, None]).sum(axis=0) if len(counts) else np.zeros_like(acc)
    for _ in range(rounds if len(counts) else 0):
        good = posterior(patterns, prior, acc)
        right = np.where(patterns > 0, good[:, None], 1 - good[:, None]) * spoke
        new = np.where(said > 0, (right * counts[:, None]).sum(axis=0) / np.maximum(said, 1), acc)
        new, mean = np.clip(new, 0.55, 0.99), float(np.clip((good * counts).sum() / counts.sum(), 0.05, 0.95))
        done = abs(mean - prior) < 1e-9 and np.abs(new - acc).max(initial=0) < 1e-9
        prior, acc = mean, new
        if done:
            break
    return Fit(float(prior), tuple(float(a) for a in acc))


def posterior(patterns: np.ndarray, prior: float, acc: np.ndarray) -> np.ndarray:
    odds = np.log(prior / (1 - prior)) + patterns @ np.log(acc / (1 - acc))
    return 1 / (1 + np.exp(-odds))


def fit_votes(voted: DataFrame, n_rules: int) -> Fit:
    """From a table with a ``votes`` column; the patterns are counted map-side first."""
    rows = sorted((tuple(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())
    patterns = np.array([r[0] for r in rows], float).reshape(-1, n_rules)
    return fit(patterns, np.array([r[1] for r in rows], float))


def judge(docs: DataFrame, rules: tuple[Vote, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of every document with ``base_failed``, ``quality`` (the posterior) and
    ``kept``. The figures are written once: fitting and scoring read them, not the texts."""
    voted = write_once(figures(docs, id_col, text_col)).withColumn("votes", votes(rules))
    model = fit_votes(voted, len(rules))
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for i, a in enumerate(model.accuracy):
        odds = odds + F.col("votes")[i] * F.lit(float(np.log(a / (1 - a))))
    return (
        voted.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
