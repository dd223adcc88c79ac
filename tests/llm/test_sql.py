import duckdb
import pytest

from souk.llm.queries import ORACLE, QUERIES
from tests.llm import cases


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet')")
    found = QUERIES[name](spark, small)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert cases.ordered(found.select(*columns).collect()) == cases.ordered(want.fetchall())
