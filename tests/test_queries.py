"""Every registered query of the listing engine against its SQL, and invariants of the entry."""

import re

import pytest

import __spark_entry__
from almanac.plans import ORACLE, QUERIES

from .harness import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    compare(spark, con, SF, QUERIES[name], ORACLE[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "almanac"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
