import os

import pytest
from check_oracles import compare, database

import __spark_entry__ as entry
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "post_index", "translated_post_content", "sentiment_score"]
    assert df.count() == 87


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None
