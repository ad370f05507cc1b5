"""The registered queries: SQL agreement, contracts, and the pipeline against its parts in brute force."""

from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinlink.llm import mixing
from kinlink.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, (dict(sorted(zip(columns, r))) for r in found.fetchall())))
    got = sorted(str(dict(sorted(r.asDict().items()))) for r in QUERIES[name](spark, sf_dir).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_input_row(spark, sf_dir, name):
    source = {"op1_embeddings": "embeddings", "op9_perspectives": None}.get(name, "documents")
    if source:
        assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_language_accuracy_of_every_language(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language"](spark, folder).where("held_out and lang_pred <> 'und'").join(docs, "doc_id").where("lang is not null").collect()
    for lang in {r.lang for r in rows}:
        own = [r.lang_pred == lang for r in rows if r.lang == lang]
        assert np.mean(own) > 0.9, lang
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where("toxic is not null").dropDuplicates(["doc_id"])
    rows = QUERIES["op8_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([(r.score, r.predicted) for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([p for _, p in clean]) < 0.04 and np.mean([p for _, p in toxic]) > 0.5
    assert np.mean([a > b for a, _ in toxic for b, _ in clean]) > 0.95  # the area under the curve


def test_classifiers_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = QUERIES["op4_language"](spark, sf_dir).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in lang]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in QUERIES["op8_toxicity"](spark, sf_dir).collect())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "benchmark", "mixture"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "language":
            assert all(re.search(r"[^\W\d_]", before[i]) for i in after) and len(after) > 0.95 * len(before)
        if name == "near_duplicates":
            texts = [t for t in after.values()]
            assert len(texts) == len(set(texts))
        if name == "repeats":
            assert sum(map(len, after.values())) < sum(map(len, before.values()))
        if name == "benchmark":
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(i in t for t in after.values() for i in items)
        docs = out
    mixed = corpus_pipeline.mixture(spark, docs, sf_dir)
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("epoch_words").alias("n")).collect()}
    assert got == want


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
