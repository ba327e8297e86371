"""Every catalogue query against its DuckDB SQL."""

import duckdb
import pytest

from notegrid.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    ours = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert ours == theirs
