"""The pN_ queries on the smallest tables: columns, types and keys."""

import pytest

from quillstone.llm import queries
from tests.conftest import DATA

COLUMNS = {
    "p1_found": [("chunk_key", "bigint"), ("line_no", "int")],
    "p2_found": [("file_id", "bigint"), ("def_line", "int")],
    "p3_found": [("chunk_key", "bigint"), ("lang", "string")],
    "p4_found": [("chunk_key_a", "bigint"), ("chunk_key_b", "bigint")],
    "p5_found": [("file_id", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("line_no", "int"), ("kind", "string")],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    n = df.count()
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name] and n > 0
        if name != "p6_ids":
            assert df.distinct().count() == n


def test_registered():
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
