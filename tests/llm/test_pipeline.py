"""The pipeline, stage by stage, on tables with planted cases, and its registration."""

import pytest
from conftest import words
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from riskloom.llm.oracles import ORACLES
from riskloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def sf_dir(spark, docs_of, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(800):
        w = words(i, 40).split()
        if i % 4 == 0:
            w[7] = ("numbskull", "blockhead")[i // 4 % 2]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    near = words(3001, 100).split()
    near[50] = "other"
    rows += [
        (3000, "such n u m b s k u l l is here " + words(3000, 30)), (3001, words(3001, 100)), (3002, words(3001, 100)),
        (3003, " ".join(near)), (3004, words(9000, 20) + " " + words(3004, 30)), (3005, None), (3006, ""), (3007, ""),
    ]
    docs_of(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, words(9000, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
    assert 3000 not in ids["toxicity"] and {3001, 3002, 3003, 3005} <= ids["toxicity"]
    assert sum(i % 4 == 0 for i in ids["toxicity"] if i < 800) < 5
    assert sum(i % 4 != 0 for i in ids["toxicity"] if i < 800) > 590
    exact = ids["exact dedup"]
    assert 3001 in exact and 3002 not in exact and len(exact & {3005, 3006, 3007}) == 1
    assert 3003 not in ids["n-gram Jaccard join"] and 3001 in ids["n-gram Jaccard join"]
    assert ids["n-gram Jaccard join"] - ids["benchmark decontamination"] == {3004}
    assert ids["mixing"] <= ids["benchmark decontamination"]


def test_an_empty_table(spark, docs_of, sf_dir):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_registered():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
