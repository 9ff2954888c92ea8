"""Registered queries run over whole tables, with their SQL where there is one."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from civicloom.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_document(spark, name):
    table = "embeddings" if name.startswith(("op3_", "op12_", "op13_")) else "documents"
    each = 8 if name.startswith("op12_") else 1
    assert QUERIES[name](spark, FOLDER).count() == each * spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    ok, note = compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name], ORACLE[name])
    assert ok, note


def test_entry_offers_all():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = corpus_pipeline.run(spark, FOLDER)
    kept = {r.doc_id: r for r in got.collect()}
    assert 0 < len(kept) < docs.count()
    assert all(len(r["ids"]) == r.n_tokens for r in kept.values())


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({"row": F.lit("mine"), "whole": F.lit(1), "gone": F.lit(2), "doc": F.lit(3)})
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(odd).unionByName(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r.row == "mine" and r.gone == 2 for r in rows), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0


def test_stages_judge_null_ids(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    other = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(None, item), (None, other), (None, other), (None, other + " end"), (None, None), (3, "own text"), (None, "own text")], "doc_id bigint, text string")
    clean = corpus_pipeline._benchmark(spark, docs, FOLDER)
    assert item not in {r.text for r in clean.collect()} and clean.count() == 6
    near = sorted(((r.doc_id, r.text) for r in corpus_pipeline._near(spark, clean, FOLDER).collect()), key=str)
    assert len(near) == 3 and {(None, None), (3, "own text")} <= set(near)
