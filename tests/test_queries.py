"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests import compare

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if n.split("_")[0] in {
    "a5", "w1", "j1", "d2", "w3", "w4", "w9", "d4", "w6", "o2", "d3", "f5", "e1", "a6", "a7", "j3", "a8", "u2", "j6", "a9", "w8", "r1", "r2", "j12"})


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    status, *_, detail = compare.compare(spark, compare.connect(FOLDER), FOLDER, name)
    assert status == "ok", detail


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
