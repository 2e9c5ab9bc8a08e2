import pytest
from check_oracles import compare, database
from helpers import SF

import __spark_entry__ as entry
from postloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {"pipeline", *QUERIES} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_licence_lines_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
    }
    want = sorted((r.doc_id, name) for r in docs for line, name in lines.items() if line in r.text)
    found = entry.queries()["op10_licenses"](spark, SF).collect()
    assert sorted((r.doc_id, r.license) for r in found) == want
