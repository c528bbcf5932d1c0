import pytest

from tests.compare import connection, difference
from weftline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, folder, name):
    only_spark, only_sql = difference(catalogue.QUERIES[name](spark, folder), catalogue.ORACLE_SQL[name], connection(folder))
    assert only_spark == [] and only_sql == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, folder, name):
    df = catalogue.QUERIES[name](spark, folder)
    assert len(df.collect()) >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry_has_rows_and_core_needs_no_text_package(spark):
    import ast
    import pathlib

    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    root = pathlib.Path(e.__file__).parent / "weftline"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(".llm" in n for n in names), path
