"""Every query of the problems on the smallest tables, against its SQL where it has one."""

import os

import pytest

from tallgrass.llm import queries
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p1_found": ["point_id", "term_hash"],
    "p2_found": ["file_id"],
    "p3_found": ["file_id"],
    "p4_found": ["point_a", "point_b"],
    "p5_found": ["point_id", "line_no"],
    "p6_found": ["field", "term", "mark"],
    "p7_found": ["point_id"],
    "p9_found": ["item_id", "doc_id"],
    "p10_found": ["doc_id", "line_no", "pii_type"],
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        df.count()
    else:
        compare(df, duck, sql)


def test_all_problems_have_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"p{i}" for i in range(1, 11)}
