"""The registered queries against their SQL, and their columns."""

import duckdb
import pytest

from arborlens.llm.queries import ORACLE, QUERIES


def test_all_are_there():
    import __spark_entry__ as entry

    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    r = con.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(x[c] for c in names) for x in df.collect()) == sorted(r.fetchall())
