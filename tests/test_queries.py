"""Registered queries against their SQL, on the smallest tables."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def module(path, name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


ENTRY = module("__spark_entry__.py", "spark_entry")
TOOL = module("tools/check_oracles.py", "check_oracles")


@pytest.mark.parametrize("name", sorted(ENTRY.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    got = ENTRY.queries()[name](spark, sf_dir).toPandas()
    assert TOOL.compare(got, TOOL.duck(sf_dir).execute(ENTRY.oracle_sql()[name]).df()) == ""


def test_entry_runs(spark):
    assert ENTRY.entry(spark).count() == 5


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_result_does_not_depend_on_partitions(spark, sf_dir, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    base = ENTRY.queries()["e02b_classification_by_city"](spark, sf_dir).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert TOOL.compare(ENTRY.queries()["e02b_classification_by_city"](spark, sf_dir).toPandas(), base) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
