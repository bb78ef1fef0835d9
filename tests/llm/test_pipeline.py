"""The pipeline's rows against plain Python, stage by stage, over the whole small tables."""

import hashlib

import plain
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from weekcast.llm import quality_gam
from weekcast.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Documents that the quality model keeps: the one stage whose model isn't rebuilt here."""
    docs = read(spark, SF, "documents")
    good = quality_gam.judge(docs, read(spark, SF, "labels")).where("score >= 0.7")
    return {r["doc_id"] for r in good.collect()}


def test_names_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding",
    ]
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_rows(spark, kept):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if r["doc_id"] in kept}
    root = plain.near_copies(docs)
    docs = {d: t.encode() for d, t in docs.items() if root[d] == d}
    spans = plain.removed_places(list(docs.items()))
    docs = {d: bytes(b for b, gone in zip(t, spans[d]) if not gone).decode("utf-8", "ignore") for d, t in docs.items()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    hit = plain.decontaminated(docs.items(), items)
    docs = {d: t for d, t in docs.items() if not hit[d][4]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: (len(library.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
