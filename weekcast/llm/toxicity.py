"""13. Toxicity from the nearest labelled examples.

Terms are words (lower-cased) and their first and last four to six letters. The model's terms are
all those that toxic examples have significantly more often (log-likelihood ratio); their number is
bounded by the examples' words. A text's vector holds ``(1 + ln tf) * idf`` of these terms at length one; document
frequencies come from all documents.

The examples lie in an inverted index in blocks: per term and block the postings and their largest
weight. A search adds up the largest weights of its terms per block, takes blocks in descending
order of that bound, scores their examples exactly, and ends when no bound left reaches the k-th
best similarity: the ``K`` nearest by exact cosine, ties by example number. Neighbours vote with
their similarity; what the votes mean is learnt by isotonic regression on the examples themselves,
each scored without itself. The neighbours are the evidence.

Examples are at most ``MOST_ROWS`` labelled rows outside the held-out fold, drawn by hash; so the
index, which goes to all executors, has a bound. A null or empty text, and one without any of the
terms, has no neighbours and the score of such examples. Of several labels of a doc_id the toxic
one counts, of several texts the least; equal texts are one example. Rows with a null doc_id are
scored and not held out. Repeated rows give one row each; without labelled rows every score is 0;
an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import keyed_texts, map_texts, slices, write_once

MOST_ROWS, LEAST_G2, LEAST_TEXTS = 20_000, 30.0, 5
K, PRIOR_WEIGHT, BLOCK = 15, 0.5, 64
ENDS = (4, 5, 6)
_LETTERS = re.compile(r"[^\W\d_]+")
_ROUNDING = 1e-12


def terms_of(word: str) -> list[str]:
    """A word (``=``), and its beginnings (``^``) and ends (``$``)."""
    found = ["=" + word]
    for k in ENDS:
        if len(word) > k:
            found += ["^" + word[:k], "$" + word[-k:]]
    return found


class Terms(dict):
    """Tokens (between white space) to numbers of the model's terms in them."""

    def __init__(self, names: list[str], most: int = 200_000):
        super().__init__()
        self.names = {t: k for k, t in enumerate(names)}
        self.most = most

    def __missing__(self, token: str) -> tuple[int, ...]:
        names = self.names
        found = tuple(names[t] for word in _LETTERS.findall(token) for t in terms_of(word) if t in names)
        if len(token) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[token] = found
        return found

    def count(self, text: str | None) -> dict[int, int]:
        counts: dict[int, int] = {}
        for found in filter(None, map(self.__getitem__, (text or "").lower().split())):
            for k in found:
                counts[k] = counts.get(k, 0) + 1
        return counts


def held_out(key: F.Column, folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def draw(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, text, toxic``: the examples, one row per text."""
    told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = told.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = keyed_texts(docs).join(F.broadcast(drawn), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    return write_once(one.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("toxic") != 0).alias("toxic")))


def choose_terms(examples: DataFrame) -> list[str]:
    """All significant terms of toxic examples, the strongest first by the log-likelihood ratio of being in a text of either kind."""
    out = examples.sparkSession.createDataFrame([], "term string, bad bigint, good bigint").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()

        def made() -> pa.RecordBatch:
            names = list(bad.keys() | good.keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (bad, good))]
            bad.clear()
            good.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "bad", "good"])

        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    words = {w for token in set(text.lower().split()) for w in _LETTERS.findall(token)}
                    (bad if toxic else good).update({t for w in words for t in terms_of(w)})
                    if len(bad) + len(good) > 500_000:
                        yield made()
        yield made()

    counted = examples.select("text", "toxic").mapInArrow(run, out).groupBy("term").agg(F.sum("bad").alias("a"), F.sum("good").alias("b"))
    n_bad, n_good = (int(x or 0) for x in examples.agg(F.sum(F.col("toxic").cast("int")), F.sum((~F.col("toxic")).cast("int"))).first())
    if not n_bad or not n_good:
        return []
    a, b, n = F.col("a"), F.col("b"), float(n_bad + n_good)
    part = lambda seen, rows, of: F.when(seen > 0, seen * F.log(seen * n / (rows * of))).otherwise(0.0)
    g2 = 2 * (part(a, a + b, n_bad) + part(b, a + b, n_good) + part(n_bad - a, n - a - b, n_bad) + part(n_good - b, n - a - b, n_good))
    strong = counted.where((a >= LEAST_TEXTS) & (a * n_good > b * n_bad)).select("term", g2.alias("g2")).where(F.col("g2") >= LEAST_G2)
    return [r["term"] for r in strong.orderBy(F.desc("g2"), "term").collect()]


def term_counts(texts: DataFrame, names: list[str]) -> DataFrame:
    """Every column of ``texts`` but the text, and ``terms``, ``tf`` of the model's terms in it."""
    sent = texts.sparkSession.sparkContext.broadcast(names)
    kept = [c for c in texts.columns if c != "text"]

    def start():
        known = Terms(sent.value)

        def work(batch: dict) -> dict:
            counts = [known.count(t) for t in batch["text"]]
            return {c: batch[c] for c in kept} | {"terms": [sorted(c) for c in counts], "tf": [[c[k] for k in sorted(c)] for c in counts]}

        return work

    kinds = dict(texts.dtypes)
    return map_texts(texts, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["terms array<int>", "tf array<int>"]), start)


def weights(terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[terms]
    return w / np.sqrt((w * w).sum()) if len(w) else w


@dataclass(frozen=True)
class Index:
    """Postings by term and, within a term, by example; ``cuts`` begins a block of a term."""

    n: int
    ids: np.ndarray
    weights: np.ndarray
    term_of: np.ndarray  # first block entry of each term
    block: np.ndarray  # per entry: the block, its largest weight, its first posting
    largest: np.ndarray
    cuts: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
        """``rows``: terms and weights of example 0, 1, ..."""
        ids = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows]).astype(np.int64)
        terms = np.concatenate([t for t, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        w = np.concatenate([x for _, x in rows]) if rows else np.zeros(0)
        order = np.lexsort((ids, terms))
        ids, terms, w = ids[order], terms[order], w[order]
        key = terms * (len(rows) // BLOCK + 1) + ids // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        largest = np.maximum.reduceat(w, first) if len(first) else w
        return cls(
            len(rows), ids, w, np.searchsorted(terms[first], np.arange(n_terms + 1)), ids[first] // BLOCK, largest, np.append(first, len(ids))
        )

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int = K, leave: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Examples and similarities above 0, the best first, and how many blocks were scored."""
        bound = np.zeros(self.n // BLOCK + 1)
        spans = [(int(self.term_of[t]), int(self.term_of[t + 1])) for t in terms]
        for (x, y), q in zip(spans, w):
            bound[self.block[x:y]] += q * self.largest[x:y]
        order = np.argsort(-bound, kind="stable")
        best, near, least, scored = np.zeros(0, np.int64), np.zeros(0), 0.0, 0
        # Few postings are added up at once, in the same order as block by block.
        whole = None
        if sum(int(self.cuts[y] - self.cuts[x]) for x, y in spans) <= 16 * self.n:
            whole = np.zeros((self.n // BLOCK + 1) * BLOCK)
            for (x, y), q in zip(spans, w):
                p = slice(self.cuts[x], self.cuts[y])
                whole[self.ids[p]] += q * self.weights[p]
        for at in order:
            if bound[at] <= 0 or (len(best) == k and bound[at] < least - _ROUNDING):
                break
            scored += 1
            if whole is not None:
                found = whole[at * BLOCK : (at + 1) * BLOCK]
            else:
                found = np.zeros(BLOCK)
                for (x, y), q in zip(spans, w):
                    e = x + int(np.searchsorted(self.block[x:y], at))
                    if e < y and self.block[e] == at:
                        p = slice(self.cuts[e], self.cuts[e + 1])
                        found[self.ids[p] - at * BLOCK] += q * self.weights[p]
            if len(best) == k and found.max() < least - _ROUNDING:
                continue
            own = np.flatnonzero(found > 0)
            if leave >= 0:
                own = own[own + at * BLOCK != leave]
            best, near = np.concatenate([best, own + at * BLOCK]), np.concatenate([near, found[own]])
            top = np.lexsort((best, -np.round(near, 12)))[:k]
            best, near = best[top], near[top]
            least = near[-1] if len(near) else 0.0
        return best, np.minimum(np.round(near, 12), 1.0), scored


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of ``y`` by ``x``: the points of a curve, pools of equal value merged."""
    values, at = np.unique(np.round(x, 9), return_inverse=True)
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for s, n, v in zip(np.bincount(at, weights=y), np.bincount(at), values):
        pools.append([s, n, v * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass(frozen=True)
class Model:
    names: list[str]
    idf: np.ndarray
    index: Index
    toxic: np.ndarray
    keys: list
    prior: float  # share of toxic ones among the examples without any term
    curve: tuple[np.ndarray, np.ndarray]

    def vote(self, terms: list[int], tf: list[int], leave: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        if not terms or not self.index.n:
            return self.prior, np.zeros(0, np.int64), np.zeros(0)
        t = np.array(terms, np.int64)
        near, similarity, _ = self.index.nearest(t, weights(t, np.array(tf, float), self.idf), K, leave)
        said = (similarity @ self.toxic[near] + PRIOR_WEIGHT * self.prior) / (similarity.sum() + PRIOR_WEIGHT)
        return float(said), near, similarity

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.curve), 0, 1)) if len(self.curve[0]) else 0.0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[Model, DataFrame]:
    """The model, and ``doc_id, terms, tf`` of every row of ``docs``."""
    spark = docs.sparkSession
    examples = draw(docs, labels, most_rows)
    names = choose_terms(examples)
    counts = write_once(term_counts(keyed_texts(docs), names))
    found = counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # one row per term
    df, n = np.zeros(len(names)), counts.count()
    for r in found:
        df[r["t"]] = r["count"]
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = term_counts(examples, names).collect()  # most_rows of them at most
    # Similar examples lie side by side, so few blocks have high bounds; equal ones in an order
    # that has nothing to do with their labels.
    heads = [tuple(sorted(r["terms"], key=lambda t: -idf[t])[:3]) for r in rows]
    rows = [r for _, _, _, r in sorted((h, hash_of(r["doc_id"]), str(r["doc_id"]), r) for h, r in zip(heads, rows))]
    vectors = []
    for r in rows:
        t = np.array(r["terms"], np.int64)
        vectors.append((t, weights(t, np.array(r["tf"], float), idf)))
    toxic = np.array([r["toxic"] for r in rows], float)
    bare = np.array([not r["terms"] for r in rows], bool)
    prior = float(toxic[bare].sum() / max(1, bare.sum())) if len(rows) else 0.0
    model = Model(names, idf, Index.build(vectors, len(names)), toxic, [r["doc_id"] for r in rows], prior, (np.zeros(0), np.zeros(0)))
    return with_curve(spark, model, rows), counts


def hash_of(key) -> int:
    from zlib import crc32

    return crc32(f"example {key}".encode())


def with_curve(spark, model: Model, rows: list) -> Model:
    """The examples' votes, each without itself, and what they were worth."""
    if not rows:
        return model
    sent = spark.sparkContext.broadcast(model)
    own = [(k, list(r["terms"]), list(r["tf"])) for k, r in enumerate(rows)]
    table = spark.createDataFrame(own, "k int, terms array<int>, tf array<int>").repartition(8)

    def start():
        def work(batch: dict) -> dict:
            return {"k": batch["k"], "vote": [sent.value.vote(t, f, k)[0] for k, t, f in zip(batch["k"], batch["terms"], batch["tf"])]}

        return work

    votes = {r["k"]: r["vote"] for r in map_texts(table, "k int, vote double", start).collect()}
    x = np.array([votes[k] for k in range(len(rows))])
    return Model(model.names, model.idf, model.index, model.toxic, model.keys, model.prior, isotonic(x, model.toxic))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, vote, evidence``; evidence: the nearest examples."""
    model, counts = train(docs, labels, most_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(counts.dtypes)["doc_id"]
    key_kind = dict(labels.dtypes)["doc_id"]

    def start():
        m = sent.value

        def work(batch: dict) -> dict:
            said = [m.vote(t, f) for t, f in zip(batch["terms"], batch["tf"])]
            evidence = [
                [{"doc_id": m.keys[i], "similarity": s, "toxic": bool(m.toxic[i])} for i, s in zip(near.tolist(), similarity.tolist())]
                for _, near, similarity in said
            ]
            return {"doc_id": batch["doc_id"], "vote": [v for v, _, _ in said], "score": [m.score(v) for v, _, _ in said], "evidence": evidence}

        return work

    out = f"doc_id {kind}, vote double, score double, evidence array<struct<doc_id: {key_kind}, similarity: double, toxic: boolean>>"
    return map_texts(counts, out, start).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "vote", "evidence"
    )
