"""Operators 11 to 13 against slow plain versions, on whole small tables and on edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weekcast.llm import hard_negatives, spelling, toxicity
from weekcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


# ---- 11


def mined(rows, every=100, low=(80, 100), k=5):
    """rows: (id, label, vector)."""
    whole = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.setdefault(i, []).append((label, list(v)))
    ints = {i: (label, [math.floor(256 * x) for x in v]) for i, own in whole.items() for label, v in [min(own)]}
    out = []
    for a, (label, v) in ints.items():
        if a % every:
            continue
        seen = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in ints.items() if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in seen if x[2] == label)[:k]:
            inside = sorted(x for x in seen if x[2] != label and -low[0] * s <= -low[1] * x[0] <= -low[1] * s)
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside[:k], 1)]
    return sorted(out)


NEGATIVES = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


def collected(df, names=NEGATIVES):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_op11(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table("embeddings")]
    want = mined(rows)
    assert collected(QUERIES["op11_hard_negatives"](spark, SF)) == want and len(want) > 50


def vectors():
    """Ties, repeated rows and keys, hot vectors, several lengths, rows that take no part."""
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.randrange(-3, 9) / 8 for _ in range(4)]) for i in range(300)]
    rows += [(i, i % 3, [1.0, 1.0, 0.5, 0.5]) for i in range(300, 460)]
    rows += rows[100:103] + [(200, 1, [9.0] * 4), (200, 0, [2.0, 1.0, 0.0, 0.0])]
    rows += [(1000 + i, i % 2, [float(i), -1.0]) for i in range(12)] + [(2000, 0, []), (2001, 0, []), (2002, 1, [])]
    rows += [(3000, None, [1.0] * 4), (3100, 1, None), (3200, 1, [1.0, None, 0.0, 0.0]), (3300, 1, [math.nan, 1.0, 1.0, 1.0]), (3400, 1, [math.inf] * 4), (None, 1, [1.0] * 4)]
    return rows


@pytest.mark.parametrize("size", (4096, 16))
def test_negatives_on_edges(spark, size):
    schema = "vec_id bigint, label int, embedding array<double>, anchor_id string, score int, cell int"
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in vectors()], schema).repartition(5)
    got = collected(hard_negatives.mine(df, every=20, rows=size, anchors=size // 4))
    want = mined(vectors(), every=20)
    assert got == want and len(want) > 100
    assert hard_negatives.mine(df.where("false")).count() == 0


def test_anchors_are_not_broadcast(spark, monkeypatch):
    # Copies of the anchors are as many as cells; a plan that broadcasts them holds all in the driver.
    plans, whole = [], hard_negatives.write_once
    monkeypatch.setattr(hard_negatives, "write_once", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, *more))
    df = spark.createDataFrame([r[:3] for r in vectors()], "vec_id bigint, label int, embedding array<double>").repartition(5)
    hard_negatives.mine(df, every=20, rows=16, anchors=4).collect()
    assert len(plans) >= 4 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("band", (200, 1 << 25))
def test_bands_and_large_components(spark, band):
    rng = random.Random(9)
    size = lambda i: 10.0 ** rng.choice((0, 1, 3) if i % 2 else (0, 0, 6))
    rows = [(i, i % 4, [rng.uniform(-1, 2) * k for _ in range(3)]) for i in range(260) for k in [size(i)]]
    rows += [(1000 + i, 0, [1.0, 0.5, 0.5]) for i in range(60)] + [(2000, 2**63 - 1, [1.0] * 3), (2001, 2**63 - 1, [1.5] * 3), (2002, -(2**63), [1.25] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, label bigint, embedding array<double>").repartition(4)
    got = collected(hard_negatives.mine(df, every=20, rows=16, anchors=4, band=band))
    want = mined(rows, every=20)
    assert got == want and len(want) > 100


def test_blocks_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(t, b) for t, n in ((1, 3), (4, 1), (6, 5)) for b in range(n)], "task int, block int")
    numbered, n = hard_negatives._numbered(df)
    assert n == 9 and sorted(r["number"] for r in numbered.collect()) == list(range(9))
    assert hard_negatives._numbered(df.where("false"))[1] == 0


def test_large_scores_are_exact():
    a, cross = np.array([[2.0**40, 3.0], [2.0**20 + 1, 2.0**31 - 1]]), 2**40 * (2**20 + 1) + 3 * (2**31 - 1)
    assert hard_negatives.scores(a, a).tolist() == [[2**63 - 1, cross], [cross, (2**20 + 1) ** 2 + (2**31 - 1) ** 2]]


# ---- 12


def spelled(docs, least=7):
    counts = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = plain.ascii_lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    known = {w: n for w, n in counts.items() if n >= 2 and len(w) >= least}
    letters, out = set("".join(known)), {}
    for w, n in known.items():
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        near = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        near = [x for x in near - {w} if x in known]
        best = min(near, key=lambda x: (-known[x], x), default=None)
        out[w] = [best if near and known[best] >= 10 * n else None, None, n, len(near)]
    for w, x in out.items():
        x[1] = w
        while out[x[1]][0]:
            x[1] = out[x[1]][0]
    return {w: (*x, known[x[0]] if x[0] else None) for w, x in out.items()}


def as_words(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_op12(spark):
    want = spelled([(r["doc_id"], r["text"]) for r in table("documents")])
    assert as_words(QUERIES["op12_spelling"](spark, SF)) == want
    assert sum(x[3] > 0 for x in want.values()) > 100 and any(x[0] for x in want.values())


def variants():
    """Chains of forms, ties, repeated letters, one hot beginning and end, long words, no words."""
    rng = random.Random(8)
    text = ["colours"] * 2000 + ["colourés"] * 30 + ["coloourés"] * 2 + ["colourx"] * 30
    text += ["aaaaaaa"] * 200 + ["aaaaaaaa"] * 18 + ["aaaaaaaaa"] * 2 + ["aaaaaab"] * 2
    text += ["begin" + "".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(900)]
    text += ["".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) + "ending" for _ in range(900)]
    text += ["x" * 5000] * 3 + ["x" * 4999 + "y"] * 2 + ["y" + "x" * 5000] * 2
    rng.shuffle(text)
    docs = [(k, " ".join(text[k::7])) for k in range(7)]
    return docs + [(None, "Variätion VARIÄTION variÄtion"), (None, "Variätion"), (8, None), (9, ""), (10, "12 34"), (11, "sixsix short"), (11, "sixsix short")]


@pytest.mark.parametrize("tile,band", ((2048, 48), (9, 4)))
def test_variants_on_edges(spark, tile, band):
    df = spark.createDataFrame([(*r, "x", 3) for r in variants()], "doc_id bigint, text string, word string, n int").repartition(3)
    want = spelled(variants())
    assert as_words(spelling.variants(df, tile=tile, band=band)) == want
    forms = [x[0] for x in want.values()]
    assert any(f and want[f][0] for f in forms)  # a form that stands for another one
    assert spelling.variants(df.where("false")).count() == 0


# ---- 13


def test_op13(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in table("labels", sf)}
    rows = {r["doc_id"]: r for r in QUERIES["op13_toxicity"](spark, sf).collect()}
    assert set(rows) == {r["doc_id"] for r in table("documents", sf)}
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
        assert all(zlib.crc32(str(e).encode()) % 5 and e in labels for e in r["evidence"])
    told = Counter((t, rows[d]["predicted"]) for d, t in labels.items() if rows[d]["held_out"])
    assert told[1, 1] >= 0.7 * (told[1, 0] + told[1, 1]) and told[0, 0] >= 0.97 * (told[0, 0] + told[0, 1])


def test_nearest_is_exact():
    """Against all cosines: the same examples in the same order, though blocks were left out."""
    rng = np.random.default_rng(3)
    idf, rows = rng.uniform(1, 9, 40), []
    for n in range(900):
        t = np.sort(rng.choice(np.arange(40) // 4 * 4 + n % 4, rng.integers(0, 6), replace=False)) if n % 3 else np.array([n // 90])
        t = np.unique(t)
        rows.append((t, toxicity.weights(t, rng.integers(1, 4, len(t)).astype(float), idf)))
    index, left = toxicity.Index.build(rows, 40), 0
    whole = np.zeros((900, 40))
    for k, (t, w) in enumerate(rows):
        whole[k, t] = w
    for k, (t, w) in enumerate(rows[:300]):
        for leave in (-1, k):
            cosine = np.round(whole @ whole[k], 12)
            cosine[leave if leave >= 0 else slice(0, 0)] = 0
            order = [i for i in np.lexsort((np.arange(900), -cosine))[:15] if cosine[i] > 0]
            near, similarity, scored = index.nearest(t, w, 15, leave)
            assert near.tolist() == order and np.allclose(similarity, np.minimum(cosine[order], 1))
            left += 900 // toxicity.BLOCK + 1 - scored
    assert left > 1000


def test_isotonic():
    rng = np.random.default_rng(4)
    x, y = np.round(rng.random(300), 2), (rng.random(300) < 0.4).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    # min-max formula of isotonic regression
    u = np.unique(x)
    s, n = (np.array([f(y[x == v]) for v in u]) for f in (np.sum, len))
    fit = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(u))) for a in range(k + 1)) for k in range(len(u))]
    assert np.allclose(sorted(set(np.round(fit, 9))), value)


def test_toxicity_on_edges(spark):
    clean, bad = "some quiet words about the weather", "you zonkhead and zonkface of a day"
    rows = [(k, (bad if k % 3 == 0 else clean) + f" number{k}") for k in range(240)]
    rows += [(500, None), (501, ""), (None, bad), (None, bad), (502, "ZONKHEAD,zonkfoot " * 3000), (502, "ZONKHEAD,zonkfoot " * 3000), (503, clean)]
    docs = spark.createDataFrame([(*r, 0.1, "v", True) for r in rows], "doc_id bigint, text string, score double, vote string, toxic boolean").repartition(4)
    told = [(k, int(k % 3 == 0)) for k in range(240)] + [(0, 0), (None, 1), (5, None), (900, 1)]
    labels = spark.createDataFrame(told, "doc_id bigint, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        bad_one = r["doc_id"] in (None, 502) or r["doc_id"] < 240 and r["doc_id"] % 3 == 0
        assert r["predicted"] == int(bad_one), r
        assert bool(r["evidence"]) == bad_one and all(e["toxic"] for e in r["evidence"])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert toxicity.judge(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.judge(docs, labels.where("false")).collect()} == {0.0}
    assert len(toxicity.judge(docs, labels.where("toxic = 0")).collect()) == len(rows)
    few = toxicity.judge(docs, labels, most_rows=30)
    assert few.where("predicted = 1 AND doc_id = 502").count() == 2


def test_corpus_frequencies_cover_all_documents(spark):
    docs = spark.createDataFrame([(k, f"zonkhead here {k}" if k < 60 else f"nothing at all {k}") for k in range(300)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 60).cast("int").alias("toxic"))
    model, counts = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    k = model.names.index("=zonkhead")
    assert model.idf[k] == pytest.approx(math.log(301 / 61) + 1)
    assert counts.where(F.size("terms") > 0).count() == 60


def test_every_significant_term_is_in_the_model(spark):
    bad = [f"zonk{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = [(k, " ".join(bad[j % 200] for j in range(k, k + 40)) if k < 200 else f"quiet words about the weather {k}") for k in range(400)]
    examples = spark.createDataFrame([(k, t, k < 200) for k, t in rows], "doc_id bigint, text string, toxic boolean")
    assert {"=" + w for w in bad} <= set(toxicity.choose_terms(examples))
