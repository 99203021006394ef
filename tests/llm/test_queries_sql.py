import duckdb
import pytest

from lumenseek.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF).toArrow(), con.execute(queries.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda table: sorted(map(str, zip(*(table.column(c).to_pylist() for c in sorted(table.column_names)), strict=True)))
    assert rows(got) == rows(want)
