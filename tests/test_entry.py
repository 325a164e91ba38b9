import os

import pytest

import __spark_entry__ as entry

HERE = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(HERE), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
