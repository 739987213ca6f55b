from pathlib import Path

import duckdb
import pytest

from roadcut import queries as Q

DATA = Path("/root/testdata/sf0.001")
#: All that have SQL.
NAMES = sorted(Q.SQL)


def compared(spark, name, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = Q.QUERIES[name](spark, str(folder))
    cur = con.execute(Q.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    return sorted(map(tuple, got.select(names).collect()), key=key), sorted(cur.fetchall(), key=key)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got, want = compared(spark, name, DATA)
    assert got == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
