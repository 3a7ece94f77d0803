"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from recordloom.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def plain(value):
    return round(value, 9) if isinstance(value, float) else int(value) if isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in NAMES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = QUERIES[name](spark, FOLDER)
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
