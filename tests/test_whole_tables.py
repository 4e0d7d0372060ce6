"""Registered text queries read every row, whatever its letters and length."""

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from arborlens.plans import registry_more  # noqa: F401  registers
from arborlens.plans.registry import ORACLE, QUERIES

TEXTS = ["ció a_1 Élan x9é 9ab naïve", "plain words, \"quoted\"\nand more lines\n", None, "", "word " * 3000 + "ñandú end", "öß Ünder_1 what do? ñdo do", "Where is the ÉTAT of dog cat"]
SIZES = [0, 10, 100, 1000, 1048575, 5 * 1048576 + 77, 1610612736]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    ids = pa.array(range(len(TEXTS)), pa.int64())
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(TEXTS, pa.string()), "n_chars": pa.array(SIZES, pa.int64())}), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": ids, "text": pa.array(TEXTS[:4] + TEXTS[5:] + TEXTS[:1], pa.string())}), folder / "benchmark.parquet")
    return folder


def rows(spark, small, name):
    return QUERIES[name](spark, str(small)).collect()


def same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = rows(spark, small, name)
    r = con.execute(ORACLE[name])
    columns = [d[0] for d in r.description]
    assert sorted(([x[c] for c in columns] for x in got), key=repr) == sorted(map(list, r.fetchall()), key=repr)
    return got


def test_identifiers(spark, small):
    got = {r.doc_id: r.names for r in same_as_sql(spark, small, "t_identifiers")}
    assert got == {i: None if t is None else sorted(set(re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", t, re.ASCII))) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", ["t_tokens", "t_counts", "t_question", "t_levenshtein", "t_jaccard"])
def test_all_letters(spark, small, name):
    got = same_as_sql(spark, small, name)
    assert len(got) == len(TEXTS) - (name in ("t_levenshtein", "t_jaccard"))


def test_letters_by_brute_force(spark, small):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            last, row[0] = row[0], i + 1
            for j, b in enumerate(y):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (a != b))
        return row[-1]

    items = TEXTS[:4] + TEXTS[5:] + TEXTS[:1]
    assert {r.a: r.d for r in rows(spark, small, "t_levenshtein")} == {i: None if None in (x, y) else distance(x, y) for i, (x, y) in enumerate(zip(items, items[1:], strict=False))}
    asked = {r.item_id: r.question for r in rows(spark, small, "t_question")}
    assert asked[4] == "öß ünder_1 ñ" and asked[5] == "the état of dog cat"
    counts = {r.doc_id: (r.words, r.chars) for r in rows(spark, small, "t_counts")}
    assert all(counts[i] == (len(t.split()), len(t)) for i, t in enumerate(TEXTS) if t is not None)
    assert {r.doc_id: (r.n, r.kinds) for r in rows(spark, small, "t_tokens")}[4] == (3001, 2)


def test_sizes_and_fields(spark, small):
    sizes = {r.doc_id: r.size for r in same_as_sql(spark, small, "t_human_size")}
    assert sizes == dict(enumerate(["0 Bytes", "10 Bytes", "100 Bytes", "1000 Bytes", "1024 KB", "5 MB", "1.5 GB"]))
    fields = {r.doc_id: r.field for r in same_as_sql(spark, small, "t_csv_quote")}
    assert fields == {i: t if t is None or not set(t) & set(',"\n') else '"' + t.replace('"', '""') + '"' for i, t in enumerate(TEXTS)}
