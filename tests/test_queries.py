"""Every core query against its oracle on the smallest data, and the contract of the entry module."""

import os

import pytest

import __spark_entry__ as entry
from strandbase.plans import catalogue
from tests.helpers import oracle_rows, query_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_oracle(spark, name):
    assert query_rows(catalogue.QUERIES[name](spark, SF)) == oracle_rows(SF, catalogue.ORACLE[name])


def test_queries_without_oracle_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["caller", "callee"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "strandbase")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "strandbase.llm" not in source.read(), f
