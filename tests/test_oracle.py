"""Every registered query of the engine against its SQL, at the smallest scale."""

import duckdb
import pytest

from arborlens.plans import registry_more  # noqa: F401  registers
from arborlens.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLE:
        assert rows
        return
    r = con.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    got = sorted((tuple(plain(x[c]) for c in columns) for x in rows), key=repr)
    assert got == want
