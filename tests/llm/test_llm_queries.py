"""Registered queries against their SQL twins, and the pipeline against plain programs."""

import os

import pytest

import corpus_pipeline
from authloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import LOWER, documents, near_groups
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    ok, got, _, diff, _, _ = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok is True and got > 0, diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_spelling_variants"}))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    table = "embeddings" if name.startswith("op2") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(stages) == 5
    good = stages["quality classifier"](spark, docs, SF)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and len(bad - ids) <= 0.02 * len(bad)

    exact = stages["exact dedup"](spark, docs, SF)
    want = {}
    for r in docs.collect():
        t = (r["text"] or "").translate(LOWER)
        want[t] = max(want.get(t, -1), r["doc_id"])
    rows = exact.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want.values()) and exact.columns == docs.columns

    near = stages["MinHash near-dedup"](spark, exact, SF)
    groups = near_groups([(r["doc_id"], r["text"]) for r in rows], 80)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({g for g in groups.values()})

    mixed = stages["mixing sources"](spark, near, SF)
    assert mixed.columns == docs.columns
    assert stages["BPE encoding and decoding"](spark, mixed, SF).count() == mixed.count()


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 50


def test_stages_of_an_empty_table(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
