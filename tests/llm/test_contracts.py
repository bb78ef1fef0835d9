"""Every registered query against its contract in plain Python, over the whole small tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import plain
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from compare import connect, difference

from weekcast.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def rows(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = [r.asDict(recursive=True) for r in QUERIES[name](spark, SF).collect()]
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_op1(rows, docs):
    from weekcast.llm import bpe, token_counts

    model = bpe.load(bpe.tokenizer_path())
    count = lambda t: sum(len(model.merge(p.encode())) for p in model.pieces(t))
    got = {r["doc_id"]: (r["n_tokens"], r["n_edits"], r["n_tokens_after"]) for r in rows("op1_token_counts")}
    want = {}
    for d, t in docs.items():
        edits, new = token_counts.redactions(t or ""), t or ""
        for a, b, x in edits:
            new = new[:a] + x + new[b:]
        want[d] = (count(t or ""), len(edits), count(new))
    assert got == want and any(x[1] for x in want.values())


def test_op3(rows, docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in rows("op3_quality_gam")}
    assert set(got) == set(docs)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    told = [(got[d]["predicted"], q) for d, q in labels.items() if got[d]["held_out"]]
    assert told and sum(p == q for p, q in told) >= 0.85 * len(told)


def test_op6(rows, docs):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in rows("op6_suffix_dedup")}
    assert got == plain.substrings_removed([(d, (t or "").encode()) for d, t in docs.items()])


def test_op4(rows, docs):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = plain.decontaminated(docs.items(), items)
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in rows("op4_decontamination")}
    assert got == want and any(x[4] for x in want.values())


def test_op5(rows, docs):
    fps = {d: plain.fingerprint(t) for d, t in docs.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows("op5_simhash")}
    assert {d: x[0] for d, x in got.items()} == {d: f"{x:016x}" for d, x in fps.items()}
    assert {d: x[1] for d, x in got.items()} == plain.linked(fps)


def test_op7(rows, docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in rows("op7_weak_rules")}
    assert got == {d: plain.figures(t) for d, t in docs.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows("op7_weak_rules"))
    assert any(r["kept"] for r in rows("op7_weak_rules"))


def test_op8(rows, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for d in sorted(docs):
        ids = [*library.encode(docs[d] or "", add_special_tokens=False).ids, 1]
        want[d] = (start, len(ids), plain.crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows("op8_token_store")} == want
    found = {r["doc_id"]: (r["n_tokens"], plain.crc(r["ids"])) for r in rows("token_store_lookup")}
    assert found == {d: x[1:] for d, x in want.items() if d % 20 == 0}


def test_op9(rows, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows("op9_bpe")} == want


def test_op10(rows, docs):
    slots = defaultdict(list)
    for r in rows("op10_ring"):
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert len(rows("op10_ring")) == len(docs) and set(slots) == set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
