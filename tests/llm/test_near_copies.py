"""The near-copy stage against all pairs in plain Python, and rows that share a doc_id."""

import random
from pathlib import Path

import numpy as np
import plain
import pytest

from weekcast.llm import near_sets, shingle_sets, simhash
from weekcast.llm.common import new_folder, read

SF = "/root/testdata/sf0.001"


def edited(n=260):
    """Copies of a few texts with few or many words changed, some without words."""
    random.seed(12)
    base = [[f"w{random.randrange(400)}" for _ in range(size)] for size in (3, 12, 60, 150)]
    out = {}
    for d in range(n):
        words = list(random.choice(base))
        for _ in range(random.randint(0, max(1, len(words) // 20))):
            words[random.randrange(len(words))] = f"v{random.randrange(10**6)}"
        out[d] = " ".join(words[random.choice((0, 0, 1)) :]).replace("w1", "W1")
    return out | {n: None, n + 1: "", n + 2: " \n"}


@pytest.mark.parametrize("heavy", (64, 3))
def test_like_all_pairs(spark, heavy):
    texts = edited()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    found = shingle_sets.near_copies(df, heavy=heavy).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component"], []).append(r["doc_id"])
    want = plain.near_copies(texts)
    assert {d: min(g) for g in groups.values() for d in g} == want and 20 < len(set(want.values())) < len(want) - 20


def test_sample_steers_no_result(spark, monkeypatch):
    texts = edited(90)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(shingle_sets, "frequent", lambda docs: (none, none))
    want = plain.near_copies(texts)
    assert {r["doc_id"] for r in simhash.one_per_group(df).collect()} == set(want.values())


def test_given_tables(spark):
    docs = read(spark, SF, "documents")
    want = plain.near_copies({r["doc_id"]: r["text"] for r in docs.collect()})
    left = {r["doc_id"] for r in simhash.one_per_group(docs).collect()}
    assert left == set(want.values())
    assert want[177] == 1 and 177 not in left  # 0.83, nine bits


def test_rows_that_share_a_key(spark):
    random.seed(3)
    text = lambda: " ".join(f"w{random.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(7, a, "x"), (7, b, "x"), (3, b + " more", "x"), (7, c, "z"), (7, c.upper(), "y"), (7, c, "y"), (None, b, "x"), (None, b, "x")]
    rows += [(9, text(), "x") for _ in range(40)]
    want = sorted(map(str, [rows[0], rows[2], (7, c.upper(), "y"), rows[6], rows[7], *rows[8:]]))
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, text_key string").repartition(parts)
        assert sorted(str(tuple(r)) for r in simhash.one_per_group(df).collect()) == want


def test_search_after_candidates_misses_none(spark, monkeypatch):
    # One part of the wide fingerprint finds few pairs; all others have to be found as well.
    texts = edited(120)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    whole = near_sets.partition
    monkeypatch.setattr(near_sets, "partition", lambda bits, n, budget: whole(bits, n, budget)[:1])
    want = set(plain.near_copies(texts).values())
    components = {r["component"] for r in near_sets.near_copies(df).collect()}
    assert len(components) > len(want)
    assert {r["doc_id"] for r in simhash.one_per_group(df).collect()} == want


def test_bitmaps_never_say_too_much():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-(2**62), 2**62, k)) for k in (0, 1, 2, 63, 64, 65, 300, 520, 3000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(-(2**62), 2**62, 1 + len(s) // 10)])) for s in sets]
    bits = np.array([shingle_sets.parities(s) for s in sets] + [None], object)[:-1]
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    least = shingle_sets.differing(bits, a, b)
    assert (least <= apart).all() and (least[a == b] == 0).all()
    assert shingle_sets.differing(bits, a[:0], b[:0]).tolist() == []
    alike = shingle_sets._alike(bits, np.array([len(s) for s in sets]), a, b)
    assert alike[apart * 9 <= [len(sets[i]) + len(sets[j]) for i, j in zip(a, b)]].all() and not alike.all()


@pytest.mark.parametrize("heavy", (64, 3))
def test_only_likely_pairs_meet_their_texts(spark, monkeypatch, heavy):
    # Forty texts share a passage that makes them candidates, and two pairs are near copies.
    random.seed(21)
    words = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    passage = words(80)
    texts = [words(60) + passage + words(60) for _ in range(40)]
    texts += [["new", *t[1:]] for t in texts[:2]]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    met, whole = [], shingle_sets.node_texts
    monkeypatch.setattr(shingle_sets, "node_texts", lambda nodes, *more: met.append(nodes.distinct().count()) or whole(nodes, *more))
    groups = {}
    for r in shingle_sets.near_copies(df, heavy=heavy).collect():
        groups.setdefault(r["component"], []).append(r["doc_id"])
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[0, 40], [1, 41]] and len(groups) == 40
    assert met and max(met) <= 4


def test_near_copies_leave_few_files(spark):
    # What the searches wrote for themselves goes with them; names, sizes and shingles were kept before.
    df = spark.createDataFrame([(d, " ".join(f"w{d * 1000 + k}" for k in range(400))) for d in range(60)], "doc_id bigint, text string")
    folder = Path(new_folder(spark).removeprefix("file:")).parent
    before = set(folder.glob("*"))
    assert simhash.one_per_group(df).count() == 60
    kinds = [set(spark.read.parquet(str(f)).columns) for f in set(folder.glob("*")) - before]
    assert not any(k & {"rare", "fp", "text", "shingle", "bits"} for k in kinds)
