"""The text operators' queries against their SQL."""

import duckdb
import pytest

from eventloom.llm import queries

SF = "/root/testdata/sf0.01"


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([plain(r[columns.index(c)]) for c in sorted(columns)] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in sorted(columns)] for r in df.collect()) == want
