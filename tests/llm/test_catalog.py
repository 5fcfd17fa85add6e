"""The subpackage's SQL is text, and gives the rows of its queries."""

import duckdb
import pytest

from tessaprobe.llm import catalog
from tests.core.test_oracle import SF, TABLES, plain


def test_every_entry_is_sql():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert all(isinstance(sql, str) for sql in catalog.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal(name, spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
