import os

import duckdb
import pytest

import __spark_entry__
from segweave import queries as workloads

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        c.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(workloads.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = workloads.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(workloads.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.net_tokens <= r.input_tokens for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
