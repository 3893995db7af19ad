"""Every registered query with SQL gives DuckDB's rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(rows):
    return sorted((tuple(bytes(v).decode() if isinstance(v, bytes | bytearray) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracles_rows(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    names = sorted(found.columns)
    said = duck.execute(ORACLES[name])
    theirs = [d[0] for d in said.description]
    assert sorted(theirs) == names
    rows = [tuple(r[theirs.index(n)] for n in names) for r in said.fetchall()]
    assert plain(map(tuple, found.select(*names).collect())) == plain(rows)


def test_entry_has_a_row_for_each_trigger(spark):
    found = entry.entry(spark)
    assert found.count() == found.select("trigger_id").distinct().count() > 0
    assert found.filter("messages = 0").count() == 0  # a trigger's own record lies in its window
