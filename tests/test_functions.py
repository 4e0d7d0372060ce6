import math

import pytest
from pyspark.sql import functions as F

from arborlens.functions import code
from arborlens.functions import paths as P
from arborlens.functions import text as T
from arborlens.operators import metrics, similarity


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def L(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: P.extname(L("a/.gitignore")), ".gitignore"), (lambda: P.extension(L("a/.gitignore")), ""), (lambda: P.extension(L("a/b.test.ts")), ".ts"),
        (lambda: P.dirname(L("a/b/c.ts")), "a/b"), (lambda: P.dirname(L("c.ts")), "."), (lambda: P.parent(L("c.ts")), ""), (lambda: P.basename(L("a/b")), "b"),
        (lambda: P.resolve(L("a/b"), L("../c/d")), "a/c/d"), (lambda: P.resolve(L("."), L("./x")), "x"), (lambda: P.normalize(L("a\\b//c/./d/")), "a/b/c/d"),
        (lambda: P.distance(L("a/b/c"), L("a/b/d")), 1), (lambda: P.distance(L("a/b"), L("x/y/z")), 3), (lambda: P.siblings(L("a/b"), L("a/c")), True),
        (lambda: P.tree_distance(L("/a/b/c"), L("a/b/d")), -1), (lambda: P.language(L("x.TSX")), "typescript"), (lambda: P.language(L("x.zig")), "generic"),
        (lambda: P.hidden(L("a/.cache/b")), True), (lambda: P.hidden(L(".github/x")), False), (lambda: P.valid_path(L("a/../b")), False), (lambda: P.is_source(L("X.PY")), True),
        (lambda: P.minified(L("a.min.js"), L("")), True), (lambda: P.minified(L("a.js"), L("x" * 501)), True), (lambda: P.parse_eligible(L("src/README.md"), L("x")), False),
        (lambda: P.parse_eligible(L("src/environment.ts"), L("x")), True), (lambda: P.parse_eligible(L("src/environment.ts"), L("x"), loose=True), False),
        (lambda: T.levenshtein_similarity(L(""), L("")), 1.0), (lambda: T.levenshtein_similarity(L(""), L("a")), 0.0), (lambda: T.levenshtein_similarity(L("für"), L("fur")), 1 - 1 / 3),
        (lambda: T.token_jaccard(L(""), L("")), 0.0), (lambda: T.tf_cosine(L(""), L("hello")), 0.0), (lambda: T.blend(L("same words here"), L("same words here")), 1.0),
        (lambda: T.question(L("What calls the Parser?")), "calls the parser"), (lambda: T.query_pattern(L("MATCH (a {x: '1'}) WHERE a.y = 'z'  LIMIT 10")), "MATCH (a {...}) WHERE a.y = '...' LIMIT N"),
        (lambda: T.query_shape(L("a = \"x\" and b = 12")), "a = ? and b = ?"), (lambda: T.pattern_description(L("MATCH (a)-[*1..2]->(b) RETURN a")), "Variable-length path traversal query"),
        (lambda: T.csv_quote(L('a,"b"')), '"a,""b"""'), (lambda: T.csv_quote(L("plain")), "plain"), (lambda: T.human_size(F.lit(1536)), "1.5 KB"), (lambda: T.human_size(F.lit(0)), "0 Bytes"),
        (lambda: P.sanitise(L("  <b>x</b> ")), "bx/b"), (lambda: T.is_identifier(L("a1_")), True), (lambda: T.is_identifier(L("1a")), False), (lambda: T.word_count(L("  a  b ")), 2),
        (lambda: F.length(T.query_hash(L("MATCH (n) RETURN n"), legacy=True)), 16), (lambda: T.imported_modules(L("import a from 'x'; import 'y'; import b from 'x'")), ["x", "y"]),
    ],
)
def test_columns(spark, column, want):
    got = one(spark, column())
    assert got == pytest.approx(want) if isinstance(want, float) and got is not None else got == want or (want == 0.0 and got in (None, 1.0))


def test_code(spark):
    text = "import a from 'm';\nconst f = () => { if (x) { g(1); } }\nclass K {}\n// note\nlet v = require('n');"
    files = spark.createDataFrame([("p.js", text)], "path string, content string")
    assert {(r.kind, r.module, r.content) for r in code.dependencies(files).collect()} == {("import", "m", "import a from 'm';"), ("require", "n", "let v = require('n');")}
    rows = text.split("\n")
    assert {(r.line, r.kind, r.content) for r in code.structure(files).collect()} == {(1, "import", rows[0]), (2, "function", rows[1]), (2, "variable", rows[1]), (3, "class", rows[2]), (5, "function", rows[4]), (5, "variable", rows[4])}
    assert [(r.line, r.name, r["index"]) for r in code.calls(files).collect()] == [(2, "g", text.index("g(1")), (5, "require", text.index("require"))]
    c = code.complexity(files).first()
    assert (c.maxNesting, c.branches, c.maxLine) == (1, 1, len(rows[1])) and math.isclose(c.commentRatio, 0.2)
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "\U0001f600 run\n (x)\n} {\n{ if else ?\n typeof (y)\n# no\n* yes"), ("d", "import 'x'\nimport {b} from `y`; import('z')")], "path string, content string")
    assert [(r.path, r.line, r.name, r["index"]) for r in code.calls(odd).collect()] == [("c", 1, "run", 3), ("d", 2, "import", 32)]
    got = {r.path: (r.branches, r.maxNesting, r.maxLine, round(r.commentRatio, 6)) for r in code.complexity(odd).collect()}
    assert got == {"a": (0, 0, 0, 0), "b": (0, 0, 0, 0), "c": (3, 1, 11, round(1 / 7, 6)), "d": (0, 1, 32, 0)}
    assert sorted((r.line, r.kind, r.module) for r in code.dependencies(odd).collect()) == [(1, "import", "x"), (2, "dynamic", "z"), (2, "import", "y")]
    assert [(r["index"], r.match, r.groups) for r in code.find_patterns(files, {"k": r"class (\w+)"}).collect()] == [(text.index("class"), "class K", ["K"])]
    assert code.snippet("x\n\ndef f():\n    a\n    b\n\nend", 3).split("\n")[2] == "def f():"
    assert len(code.snippet("\n".join(map(str, range(300))), 100, "class").split("\n")) == 23


def test_similarity(spark):
    b = spark.createDataFrame([(1, "parse the query text"), (2, "parse query texts"), (3, "völlig anders"), (4, "parse the query text")], "c long, c_text string")
    q = spark.createDataFrame([(7, "parse the query text")], "q long, q_text string")
    assert [r.c for r in similarity.similar(q, b).orderBy("rank").collect()] == [1, 4, 2]
    assert similarity.most_similar(q, b).first().c == 1
    with pytest.raises(ValueError):
        similarity.similar(q, b, 0.1)
    cache = spark.createDataFrame([("how many files", "Q1", True, 0.9, 1.0, 1), ("how many files", "Q2", False, 0.9, 1.0, 2), ("other", "Q3", True, 0.9, 1.0, 3)], "question string, query string, success boolean, confidence double, executionTime double, timestamp long")
    assert [r.query for r in similarity.cached("How many files", cache).collect()] == ["Q1"]
    assert similarity.upsert(cache, cache.limit(1)).count() == 2
    log = spark.createDataFrame([("MATCH () RETURN 1", 2000.0, 0)], "query string, executionTime double, resultCount long")
    assert {r.message for r in similarity.suggestions(log).collect()} == {"over one second", "no results", "matches all nodes", "no LIMIT"}
    assert similarity.shortened("MATCH (a)-[*1..9]->(b) RETURN b") == "MATCH (a)-[*1..3]->(b) RETURN b LIMIT 50"


def test_metrics(spark):
    log = spark.createDataFrame([("q1", t, 100.0 if t < 4 else 10.0, True, 1) for t in range(1, 7)] + [("q2", 1, 5.0, False, 0)], "query string, timestamp long, executionTime double, success boolean, resultCount long")
    perf = {r.totalExecutions: r for r in metrics.query_performance(log).collect()}
    assert perf[6].trend == "improving" and perf[6].successRate == 1.0 and perf[1].averageExecutionTime == 0.0 and perf[1].trend == "stable"
    s = metrics.optimisation_stats(log).first()
    assert (s.totalQueries, s.uniqueQueries, s.improving, s.stable) == (7, 2, 1, 1)
    assert [r.pattern for r in metrics.best_patterns(metrics.learn_patterns(log.withColumn("query", F.lit("MATCH (n) RETURN n")))).collect()] == ["MATCH (n) RETURN n"]
    one_op = spark.createDataFrame([("op", 100.0, True, 1)], "operation string, duration double, success boolean, timestamp long")
    r = metrics.operation_report(one_op, 10).first()
    assert (r.total, r.average, r.failed) == (1, 100.0, 0)
    sessions = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], "session string, first long, last long")
    assert {x.session for x in metrics.sessions_to_clean(sessions, 2, 15, 2).collect()} == {"a"}
    runs = spark.createDataFrame([("x", 2.0, 1), ("y", 4.0, 1)], "engine string, duration double, timestamp long")
    assert {x.engine: x.ratio for x in metrics.engine_comparison(runs).collect()} == {"x": 2.0, "y": 1.0}
