"""The p-queries with an SQL twin, and the shape of all others."""

import pytest
from oracle import compare

from lantern.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    compare(spark, name, FOLDER)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p1_found", "case_id entity"),
        ("p2_found", "record_id_a record_id_b"),
        ("p3_found", "caller_service callee_service measure"),
        ("p4_found", "case_id method entity place"),
        ("p5_found", "case_id"),
        ("p6_ids", "doc_id ids"),
        ("p7_found", "source"),
        ("p8_found", "doc_id"),
    ],
)
def test_columns(spark, name, columns):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns == columns.split() and df.count() == df.distinct().count()
