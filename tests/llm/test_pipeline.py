"""The corpus pipeline on the smallest tables and on odd rows."""

import os
import sys

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import packing, quality, toxicity

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import components  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")

if not os.path.isdir(SMALL):
    pytest.skip("no test tables", allow_module_level=True)


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]


def test_run_is_its_operators_one_by_one(spark):
    """run() against each operator's own results on what is left, with plain sets in between."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")

    def left(ids):
        return docs.where(F.col("doc_id").isin(sorted(ids)))

    ids = {r["doc_id"] for r in toxicity.score_documents(docs, labels).collect() if r["predicted"] == 0}
    ids = {r["doc_id"] for r in quality.score_documents(left(ids), labels).collect() if r["predicted"] == 1}
    texts = {r["doc_id"]: r["text"] for r in left(ids).collect()}
    root = components(sorted(texts.items()))
    ids = {i for i in texts if root[i][1] == i}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(got["doc_id"]) == ids and 0 < len(ids) < docs.count()
    expected = packing.pack_documents(left(ids), public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(expected[key].itertuples(index=False, name=None))
    assert got["sequence_id"].nunique() == expected["sequence_id"].nunique()


def test_odd_rows_pass_through(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "a b c " * 30_000, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_gone", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() >= 1
        assert stage(spark, odd.where("false"), SMALL).count() == 0
