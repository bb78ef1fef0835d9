"""What a Python worker holds, and from one task to the next."""

import pytest
from pyspark.sql import functions as F

from weekcast.llm import bpe, common

TEXTS = [(k, f"Some text {k}, with words{k % 7} and <|endoftext|> \n more") for k in range(60)] + [(None, None), (60, "")]


def test_models_of_other_operators_are_let_go():
    """A worker that encoded keeps nothing of it when its next task is another operator's."""
    common.started(lambda: bpe.load(bpe.tokenizer_path()))
    assert len(common._models) == 1
    common.started(lambda: bpe.load(bpe.tokenizer_path()))
    assert len(common._models) == 1
    common.started(lambda: None)
    assert not common._models


def test_brief_digests_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FEW", (5, 3))
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    assert sorted(bpe.digests(docs, brief=True).collect(), key=str) == sorted(bpe.digests(docs).collect(), key=str)


def test_batches_of_texts_are_small_while_they_are_written(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    df = spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n bigint")
    before = spark.conf.get(common._BATCH)
    assert common.write_once(df, 100).agg(F.max("n")).first()[0] == 100
    assert common.write_once(df).agg(F.max("n")).first()[0] == 1000
    with pytest.raises(Exception):
        common.write_once(df.select(F.raise_error(F.lit("no")).cast("int").alias("x")), 100)
    assert spark.conf.get(common._BATCH) == before
