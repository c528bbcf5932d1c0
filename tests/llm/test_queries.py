import pytest

from tests.compare import connection, difference
from weftline.llm import queries

COLUMNS = {
    "p1_found": ["entered_name", "actor_id"], "p2_found": ["globaleventid", "field_name", "answer"], "p3_found": ["globaleventid", "line_no"], "p4_found": ["globaleventid"],
    "p6_found": ["globaleventid", "line_no"], "p7_found": ["globaleventid", "lang"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_distinct_rows(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        rows = [tuple(r) for r in df.collect()]
        assert rows and len(set(rows)) == len(rows)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, folder, name):
    only_spark, only_sql = difference(queries.QUERIES[name](spark, folder), queries.ORACLE_SQL[name], connection(folder))
    assert only_spark == [] and only_sql == []
