"""The corpus pipeline against its stages' plain meaning, and on odd tables."""

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from marketspark.llm import bpe, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids = {x.doc_id for x in before.select("doc_id").collect()}
        kept = {x.doc_id for x in after.select("doc_id").collect()}
        assert kept <= ids
        if name == "simhash":
            fps = {}
            for x in before.collect():
                fps.setdefault(simhash.fingerprint((x.text or "").encode()), []).append(x.doc_id)
            assert all(len(kept & set(same)) <= 1 for same in fps.values())
        if name == "pii":
            assert not [x for x in after.collect() if brute.pii_base(x.text or "")]
        before = spark.createDataFrame(after.collect(), docs.schema)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    own = bpe.Bpe(open(bpe.vocabulary(), "rb").read())
    assert 100 < len(got) < 200 and all(own.decode(x.ids) == x.decoded for x in got)


def test_odd_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "bpe":
                assert docs.columns == table.columns
        assert docs.count() <= table.count()
