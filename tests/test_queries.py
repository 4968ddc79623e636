import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def told(rows, columns):
    place = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in (r[k] for k in place)]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_its_sql(spark, small, name):
    got = entry.queries()[name](spark, small)
    rows = [tuple(r) for r in got.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    db = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert told(rows, got.columns) == told(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
