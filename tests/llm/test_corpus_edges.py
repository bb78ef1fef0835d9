"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names, and
the paths that only large or skewed inputs take (here by small bounds)."""

import hashlib
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weekcast.llm import (
    bpe,
    decontaminate,
    quality_gam,
    ring,
    simhash,
    suffix_dedup,
    token_counts,
    token_store,
    url_filter,
    weak_rules,
)
from weekcast.llm.common import new_folder
from weekcast.llm.components import components

LONG = " ".join(f"word{n * n % 9973} and" for n in range(20_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, host string, `codes` string, a bigint"


@pytest.fixture(scope="module")
def docs(spark):
    """Every edge at once; the extra columns have names that the operators use themselves."""
    texts = [
        (1, "The first text, said once more and again in other words to be long enough."),
        (2, "The first text, said once more and again in other words to be long enough."),
        (2, "The first text, said once more and again in other words to be long enough."),
        (3, None),
        (4, ""),
        (None, "no key here, and yet a text that is fifty bytes long or more"),
        (5, " \n\t "),
        (6, LONG),
        (7, LONG + " changed"),
        (None, None),
        (8, "\u00e9" * 200),
        (9, "x" * 100_000),
    ]
    rows = [(d, t, "en", None, None, 0.5, "k", "h", "c", 1) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    text = "word0 and word1 and word4 and word9 and word16 and word25"
    rows = [(1, text), (None, "the first text said once more and again in other"), (3, None), (4, ""), (1, text)]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id bigint, quality int, toxic int")


def every_operator(docs, bench, labels):
    return {
        "counts": token_counts.edited_counts(token_counts.with_redactions(docs)),
        "urls": url_filter.filter_urls(docs, url_col="text"),
        "quality": quality_gam.judge(docs, labels),
        "accepted": quality_gam.accepted(docs, labels),
        "contamination": decontaminate.contamination(docs, bench),
        "clean": decontaminate.clean(docs, bench),
        "near": simhash.near_duplicates(docs),
        "one": simhash.one_per_group(docs),
        "repeats": suffix_dedup.without_repeats(docs),
        "cut": suffix_dedup.cut_repeats(docs),
        "rules": weak_rules.judge(docs),
        "store": token_store.store_and_read(docs),
        "bpe": bpe.encode_decode(docs),
        "ring": ring.assign(docs),
    }


def test_empty_tables(spark, docs, bench, labels):
    empty = docs.where("false")
    for name, df in every_operator(empty, bench, labels).items():
        assert df.count() == 0, name
    for name, df in every_operator(docs, bench.where("false"), labels.where("false")).items():
        assert name in ("one", "clean", "accepted") or df.count() == docs.count(), name
    for _, stage in corpus_pipeline.STAGES:
        assert stage.__name__


def test_rows_and_columns_stay(docs, bench, labels):
    n = docs.count()
    made = every_operator(docs, bench, labels)
    for name in ("counts", "urls", "quality", "contamination", "near", "repeats", "cut", "rules", "store", "bpe", "ring"):
        assert made[name].count() == n, name
    for name in ("accepted", "clean", "one", "cut"):
        assert made[name].dtypes == docs.dtypes, name
    assert made["urls"].columns[: len(docs.columns)] == docs.columns


def test_one_per_group(docs):
    left = sorted(r["doc_id"] or 0 for r in simhash.one_per_group(docs).collect())
    # 2 goes for 1; 4 and 5 go for 3 (no words); 7 goes for 6; rows without a key stay.
    assert left == [0, 0, 1, 3, 6, 8, 9]


def test_accepted_without_labels(docs, labels):
    assert quality_gam.accepted(docs, labels.where("false")).count() == docs.count()


def test_contamination_in_parts(docs, bench):
    one = decontaminate.contamination(docs, bench)
    many = decontaminate.contamination(docs, bench, part_bytes=40)
    assert len(decontaminate.benchmark_parts(bench, 40)) > 2
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(many)
    assert decontaminate.clean(docs, bench, part_bytes=40).count() == decontaminate.clean(docs, bench).count()
    hit = {r["doc_id"]: r for r in one.where("contaminated").collect()}
    assert set(hit) == {1, 2, 6, 7} and hit[1]["n_items"] == 0 and hit[6]["n_items"] == 1


def test_spans_name_the_original(spark):
    df = spark.createDataFrame([(1, "\u00e9t\u00e9: ONE,two;three!  \u00fc")], "doc_id int, text string")
    items = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    row = decontaminate.contamination(df, items).first()
    data = "\u00e9t\u00e9: ONE,two;three!  \u00fc".encode()
    assert [data[s["first"] : s["end"]] for s in row["spans"]] == [b"ONE,two;three"]


def test_url_rules(spark):
    rules = [
        url_filter.rule("block", "a.com/x/"),
        url_filter.rule("allow", "a.com/x/y"),
        url_filter.rule("block", "b.a.com/"),
        url_filter.rule("allow", "c.org"),
        url_filter.rule("block", "c.org"),
    ]
    rows = ["http://A.com/x/1", "http://q.a.com/x/yes?z", "http://b.a.com/x/y", "http://ba.com/x/", "no scheme/x/", None, "s://c.org", "s://a.com/x", "s://c.org:80/", "a://b://a.com/x/", "http://x\n.a.com/x/\n"]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()]
    assert got == [
        ("a.com/x/", "block"), ("a.com/x/y", "allow"), ("a.com/x/y", "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        ("c.org", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("a.com/x/", "block"),
    ]


def test_heavy_values_link_the_same(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(120):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            fps.add(int(b) ^ sum(1 << int(f) for f in flips))
    fps = {i: v for i, v in enumerate(sorted(fps))}
    rows = [(int(np.array(v, np.uint64).view(np.int64)), i) for i, v in fps.items()]
    distinct = spark.createDataFrame(rows, "fp bigint, doc bigint")
    for radius in (3, 4):
        want = plain.linked(fps, radius)
        for heavy in (4096, 20, 1):
            roots = {r["node"]: r["root"] for r in components(simhash.near_links(distinct, radius, heavy)).collect()}
            assert {i: roots.get(i, i) for i in fps} == want, (radius, heavy)


def test_partition_covers_all_bits():
    rng = np.random.default_rng(1)
    sample = rng.integers(-(2**63), 2**63 - 1, 300)
    for n in (0, 10, 10**6, 10**10):
        p = simhash.make_partition(sample[: min(n, 300)], n)
        assert sorted(b for g in p.parts for b in g) == list(range(64))
        assert sum(p.thresholds) == simhash.RADIUS - len(p.parts) + 1
    assert len(simhash.make_partition(sample, 10**4).parts) > len(simhash.make_partition(sample, 10**10).parts)


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)]
    links += [(500, k) for k in range(501, 600)] + [(7, 7), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((top(a), top(b)))
            parent[hi] = lo
    want = {x: top(x) for x in list(parent) if top(x) != x}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want


def random_pieces(seed, n=40):
    random.seed(seed)
    base = ["".join(random.choice("abcd\u00e9") for _ in range(300)) for _ in range(4)] + ["ab" * 200, "q" * 300]
    out = []
    for i in range(n):
        text = ""
        for _ in range(random.randint(0, 5)):
            s = random.choice(base)
            a = random.randint(0, len(s))
            text += s[a : random.randint(a, len(s))] + random.choice(["", "#", "\u00fc"])
        out.append((3 * i - 5, text))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_like_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 200)  # long texts are cut into parts
    monkeypatch.setattr(suffix_dedup, "HOT", (2, 3, 16)[seed])
    rows = random_pieces(seed)
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    want = plain.substrings_removed([(d, t.encode()) for d, t in rows])
    for d, t in rows:
        r = got[d]
        kept = bytes(r["kept"])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(kept).hexdigest()) == want[d]
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]


def test_hot_string_in_other_surroundings(spark, monkeypatch):
    """A 40-byte string in every document, each time between other bytes; some windows of 50
    around it are the same in two documents."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    random.seed(11)
    line = "the line that stands in every document."
    rows = []
    for d in range(120):
        edge = "".join(random.choice("abcdefgh") for _ in range(70))
        rows.append((d, f"{edge} {line}{d % 17}{'z' * (d % 13)} {edge[::-1]}"))
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.without_repeats(df).collect()}
    want = plain.substrings_removed([(d, t.encode()) for d, t in rows])
    assert got == want and sum(x[1] > 0 for x in want.values()) > 20


def test_cut_texts(spark):
    rows = random_pieces(9)
    df = spark.createDataFrame([(d, t, "en", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, n_chars bigint")
    places = plain.removed_places([(d, t.encode()) for d, t in rows])
    for r in suffix_dedup.cut_repeats(df).collect():
        text = dict(rows)[r["doc_id"]].encode()
        left = bytes(b for b, gone in zip(text, places[r["doc_id"]]) if not gone)
        assert r["text"] == left.decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = ["<|endoftext|>a <|endoftext|>", "it's  we'll\n\n x\u3000y\u00a0z \x1c\x1d\x85", "\u65e5\u672c \U0001f600", "q" * 5000, " a", "a ", "  ", "\n a\t b", "1\u00bd\u0663 \u0301x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in bpe.encode_decode(df).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.load(bpe.tokenizer_path()).decode(np.array([160, 50256], "<u4").tobytes()).endswith("<|endoftext|>")


def test_pair_tree():
    random.seed(2)
    for _ in range(200):
        keys = [random.randrange(50) for _ in range(random.randint(0, 40))]
        tree = bpe.PairTree(list(keys))
        for _ in range(20):
            assert tree.root() == min(keys, default=bpe._NONE)
            if keys:
                at = random.randrange(len(keys))
                keys[at] = random.choice([random.randrange(50), bpe._NONE])
                tree.put(at, keys[at])


def test_edits_like_encoding_anew(spark):
    model = bpe.load(bpe.tokenizer_path())
    random.seed(5)
    some = ["a", "b", "'", "r", "e", "s", " ", "  ", "\n", "1", "!", "\u00e9", "ve", "'ll", "\t"]
    make = lambda n: "".join(random.choice(some) for _ in range(n))
    docs, edits, want = [], [], {}
    for d in range(300):
        text = now = make(random.randint(0, 40))
        docs.append((d, text))
        for seq in range(random.randint(0, 4)):
            a = random.randint(0, len(now))
            b, new = random.randint(a, min(len(now), a + 6)), make(random.randint(0, 5))
            edits.append((d, seq, a, b, new))
            now = now[:a] + new + now[b:]
        want[d] = (len(model.encode(text)) // 4, now, len(model.encode(now)) // 4)
    df = spark.createDataFrame(docs, "doc_id int, text string")
    table = spark.createDataFrame(edits, "doc_id int, seq int, first int, end int, replacement string")
    found = token_counts.edited_counts(token_counts.attach_edits(df, table))
    assert {r["doc_id"]: (r["n_tokens"], r["edited"], r["n_tokens_after"]) for r in found.collect()} == want


def test_edit_encodes_only_the_region(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id int, text string")
    edits = spark.createDataFrame([(1, 0, 1000, 1004, "new words"), (1, 1, -5, 10**9 * 0, "x")], "doc_id int, seq int, first int, end int, replacement string")
    row = token_counts.edited_counts(token_counts.attach_edits(df, edits)).first()
    assert 0 < row["n_encoded_chars"] < 200


def test_store_lookup(spark, docs):
    folder = new_folder(spark)
    token_store.write_store(docs, folder)
    asked = spark.createDataFrame([(1,), (2,), (3,), (6,), (None,), (77,), (1,)], "doc_id bigint")
    found = [(r["doc_id"], list(r["ids"])) for r in token_store.lookup(spark, folder, asked).collect()]
    words = token_store.encoder(token_store.tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = [(d, [*np.frombuffer(words.encode_many([text[d] or ""])[0], "<u2").tolist(), 1]) for d in (1, 2, 2, 3, 6)]
    assert sorted(found) == sorted(want)


def test_store_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 50)
    df = spark.createDataFrame([(k // 2, f"some text {k} " * (k % 5)) for k in range(200)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.store_and_read(df).collect())
    assert len(got) == 200
    assert sorted(x[1] for x in got)[1:] == np.cumsum([x[2] for x in sorted(got, key=lambda x: x[1])]).tolist()[:-1]


def test_store_lookup_across_blocks(spark, monkeypatch):
    """Key 50 fills several blocks and parts; asked keys are cut into lists of three."""
    monkeypatch.setattr(token_store, "BLOCK_IDS", 60)
    monkeypatch.setattr(token_store, "ASKED", 3)
    texts = [(50 if k % 3 == 0 else k if k % 7 else None, f"some text {k} " * (k % 5)) for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    folder = new_folder(spark)
    token_store.write_store(df, folder)
    assert spark.read.parquet(folder).where("low_key <= 50 AND high_key >= 50").count() > 3
    asked = spark.range(-20, 400).select(F.col("id").alias("doc_id")).unionByName(spark.createDataFrame([(None,), (2**62,)], "doc_id bigint"))
    got = sorted((r["doc_id"], list(r["ids"])) for r in token_store.lookup(spark, folder, asked).collect())
    words = token_store.encoder(token_store.tokenizer_path())
    ids = [np.frombuffer(x, "<u2").tolist() + [1] for x in words.encode_many([t for _, t in texts])]
    assert got == sorted((k, x) for (k, _), x in zip(texts, ids) if k is not None)
    none = token_store.lookup(spark, folder, spark.createDataFrame([(-5,), (None,)], "doc_id bigint"))
    assert none.count() == 0 and none.columns == ["doc_id", "ids"]


def test_store_lookup_in_an_empty_store(spark):
    folder = new_folder(spark)
    token_store.write_store(spark.createDataFrame([], "doc_id bigint, text string"), folder)
    assert token_store.lookup(spark, folder, spark.range(3).withColumnRenamed("id", "doc_id")).count() == 0


def test_perfect_hash_rejects_strangers():
    keys = np.arange(0, 200_000, 2)
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    slots = index.slots(keys + 1)
    marks = np.zeros(len(keys), np.uint32)
    marks[index.slots(keys)] = token_store.fingerprints(keys)
    wrong = (slots >= 0) & (marks[slots] == token_store.fingerprints(keys + 1))
    assert wrong.sum() <= 2 and 8 * index.bits.size < 3.5 * len(keys)
    assert (index.ranks == [np.unpackbits(index.bits[: 64 * k]).sum() for k in range(len(index.ranks))]).all()


def test_ring_moves_little(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = {r["doc_id"]: r["shard"] for r in ring.assign(df, 40).collect()}
    after = {r["doc_id"]: r["shard"] for r in ring.assign(df, 41).collect()}
    moved = sum(before[d] != after[d] for d in before) / len(before)
    assert moved < 0.06  # dealing by remainder would move 97 of 100


def test_ring_small_inputs(spark):
    for n in (0, 1, 39, 40, 41):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
        sizes = [r["count"] for r in ring.assign(df).groupBy("shard").count().collect()]
        assert sum(sizes) == n and (not n or max(sizes) - (min(sizes) if n >= 40 else 0) <= 1)


def test_em_finds_the_worse_rule():
    rng = np.random.default_rng(8)
    good = rng.random(20_000) < 0.7
    acc = np.array([0.95, 0.9, 0.85, 0.6])
    right = rng.random((len(good), 4)) < acc
    votes = np.where(right == good[:, None], 1, -1) * (rng.random(right.shape) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_rules.fit(patterns.astype(float), counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03 and np.abs(np.array(model.accuracy) - acc).max() < 0.04


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(6)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert quality_gam.fit(x[:3000], y[:3000], pairs=0).score(x[3000:]).std() < 0.2


def test_hot_text_in_a_third_of_all_rows(spark, bench, labels):
    rows = [(k, "one text that very many documents share, word for word, from start to end" if k % 3 == 0 else f"text {k} of its own {k * 7919}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(df).where("doc_id % 3 = 0").collect()} == {0}
    cut = suffix_dedup.without_repeats(df).where("doc_id % 3 = 0").orderBy("doc_id").collect()
    assert cut[0]["n_removed"] == 0 and all(r["n_removed"] == r["n_bytes"] for r in cut[1:])
    assert max(r["count"] for r in ring.assign(df).groupBy("shard").count().collect()) == 15
