"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from civicloom.bindings.registry import ORACLE, QUERIES
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
SQL = ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", ["win_service_id", "jn_overlap_pair", "agg_facets", "win_confidence", "stm_visit_dedupe"])
def test_partition_count_does_not_matter(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        ok, note = compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ok, note
