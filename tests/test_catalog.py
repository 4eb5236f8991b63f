"""Every query against its SQL on the smallest data; queries without SQL must give rows of a stable schema."""

import collections

import duckdb
import pytest

from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY_OK = {"registry_find_by_hash", "registry_point_lookup", "backup_retention"}


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    assert len(set(columns)) == len(columns) and all(kind != "int" for _, kind in found.dtypes)
    rows = collections.Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    oracle = catalog.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    result = duck.execute(oracle)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == collections.Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert rows or name in EMPTY_OK
