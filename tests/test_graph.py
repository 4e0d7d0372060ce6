import pytest

from arborlens.model import PropertyGraph
from arborlens.operators import match, stats, traverse
from arborlens.plans.legacy import accepts, run_legacy, tidy, validate
from arborlens.plans.planner import run_query
from arborlens.plans.syntax import QueryError, parse


def edge(a, b, kind="CALLS", **more):
    return {"id": f"{kind}-{a}-{b}-{len(more)}", "type": kind, "src": a, "dst": b, **more}


@pytest.fixture(scope="module")
def chain(spark):
    nodes = [{"id": f"node-{i}", "label": "Function", "name": f"function{i}", "filePath": f"/file{i}.ts"} for i in range(10)]
    return PropertyGraph.from_rows(spark, nodes, [edge(f"node-{i}", f"node-{i + 1}", strength=0.5) for i in range(9)])


@pytest.fixture(scope="module")
def diamond(spark):
    nodes = [{"id": x, "label": "Function", "name": x} for x in "abcd"]
    edges = [edge("a", "b"), edge("b", "d"), edge("a", "c"), edge("c", "d"), edge("a", "b", strength=1.0)]
    return PropertyGraph.from_rows(spark, nodes, edges)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_chain(chain):
    near = traverse.neighbours(chain, ["node-0", "no such"], 3, "out")
    assert ids(near.nodes) == [f"node-{i}" for i in range(4)]
    assert near.edges.count() == 3
    assert traverse.shortest_path(chain, "node-0", "node-9", most=9).count() == 9
    assert traverse.shortest_path(chain, "node-0", "node-9").count() == 0
    assert traverse.shortest_path(chain, "node-0", "node-0").count() == 0
    found = run_query(chain, "MATCH (a {id: 'node-0'})-[:CALLS*2..3]->(b) RETURN b.id").data
    assert ids(found, "b.id") == ["node-2", "node-3"]


def test_diamond_paths_and_parallel_edges(diamond):
    paths = traverse.variable_length(diamond, "Function", "CALLS", "Function", 2, 2)
    assert [tuple(r) for r in paths.filter("a = 'a' AND b = 'd'").collect()] == [("a", "d", 2)] * 3
    assert match.one_hop(diamond, "CALLS").count() == 5
    assert match.dedupe_edges(diamond.edges).count() == 4
    assert traverse.variable_length(diamond, None, "CALLS", None, 2, 2, per_pair=1).count() == 1
    assert traverse.shortest_path(diamond, "a", "d").count() == 2


def test_cycle_ends(spark):
    g = PropertyGraph.from_rows(spark, [{"id": x, "label": "Class", "name": x} for x in "abc"], [edge("a", "b"), edge("b", "c"), edge("c", "a")])
    assert traverse.variable_length(g, "Class", "CALLS", "Class", 1, 6).count() == 6
    assert traverse.neighbours(g, ["a"], 10, "out").edges.count() == 3
    assert {r.id: r.depth for r in traverse.containment_depth(g).collect()} == {"a": 0, "b": 0, "c": 0}


def test_dangling_and_validation(spark):
    nodes = [{"id": "func_123", "label": "Function", "name": "f", "startLine": 15, "endLine": 25}, {"id": "class_456", "label": "Class", "name": "c"}]
    g = PropertyGraph.from_rows(spark, nodes, [{"id": "rel_789", "type": "CALLS", "src": "func_123", "dst": "func_456"}, {"id": "rel_101", "type": "CONTAINS", "src": "class_456", "dst": "func_123"}])
    assert [tuple(r) for r in stats.violations(g).collect()] == [("invalid target", "rel_789")]
    bad = PropertyGraph.from_rows(spark, [{"id": "", "label": "Invalid"}, {"id": "x", "label": "Import"}, {"id": "x", "label": "File"}], [edge("x", "x", confidence=1.5)])
    assert {r.rule for r in stats.violations(bad, strict_reference=True).collect()} == {"empty id", "unknown label", "duplicate node id", "value range"}
    assert match.one_hop(g, "CALLS").count() == 0


def test_library_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("UserModel", "Function"), ("run", "Function"), ("UserModel", "Class"), ("my_ruleset", "Decorator")], "n string, l string")
    assert [r[0] for r in df.select(match.from_library(F.col("n"), F.col("l"))).collect()] == [True, False, False, True]


@pytest.mark.parametrize("text", ["MATCH (n", "RETURN", "MATCH (n:Nothing) RETURN n", "MATCH (n:File) RETURN n.nothing", "MATCH (a:File), (b:File) RETURN a", "FETCH x", "MATCH (n:File) RETURN m.name", "MATCH (n)-[:NOPE]->(m) RETURN n", "MATCH (n:File) RETURN f(n.name)", "MATCH (n:File) WHERE n.id = $x RETURN n"])
def test_bad_queries_raise(chain, text):
    with pytest.raises(QueryError):
        run_query(chain, text)


def test_prompt_queries_parse():
    for q in [
        "MATCH (f:Function {name: 'x'})<-[:CALLS]-(c:Function) RETURN c.name, c.filePath",
        "MATCH (f:File)-[:CONTAINS]->(c:Class) RETURN f.name, COUNT(c) AS classes ORDER BY classes DESC",
        "MATCH (a:Function)-[:CALLS*1..3]->(b:Function) WHERE a.name CONTAINS 'main' AND b.name CONTAINS \"db\" RETURN a.name, b.name",
        "MATCH (n) RETURN COUNT(*)", "MATCH ()-[r:CALLS|USES]->() RETURN count(r)",
        "MATCH (f:File) WHERE EXISTS((f)-[:CONTAINS]->(:Function)) AND EXISTS((f)-[:CONTAINS]->(:Class)) RETURN f.name",
    ]:
        assert parse(q)


def test_case_and_falsy(spark):
    g = PropertyGraph.from_rows(spark, [{"id": "1", "label": "File", "name": "Data", "path": ""}, {"id": "2", "label": "File", "name": "", "path": "x", "filePath": "y"}], [])
    q = "MATCH (n:File) WHERE n.name CONTAINS 'dATA' RETURN n.id"
    assert run_query(g, q).data.count() == 1
    assert run_query(g, q, match_case=True).data.count() == 0
    assert run_legacy(g, "MATCH (n:File) RETURN COLLECT(n.name)").data.first()[0] == ["Data"]
    assert match.filter_nodes(g, path_contains="X").count() == 1
    assert match.with_properties(g.nodes, {"name": ""}).count() == 2


def test_legacy_forms(chain):
    assert run_legacy(chain, "MATCH (f:Function {name: 'function3'}) RETURN f").data.count() == 1
    assert run_legacy(chain, "MATCH (f:Function) RETURN f.name", limit=3, offset=8).data.count() == 2
    assert run_legacy(chain, "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a, b").data.columns == ["a", "b"]
    assert not accepts("MATCH (n) RETURN n")
    assert tidy("MATCH  (a)   WHERE a.x='1'") == "MATCH (a) WHERE a.x = '1'"
    assert validate("FOO (")[0] == ["must start with a clause", "unbalanced ()"]


def test_sampling_and_isolated(diamond, spark):
    assert match.sample_graph(diamond, 2).edges.count() == 2
    g = PropertyGraph.from_rows(spark, [{"id": "a", "label": "File"}, {"id": "b", "label": "File"}, {"id": "z", "label": "File"}], [edge("a", "b")])
    assert ids(match.isolated(g)) == ["z"]
    assert ids(match.drop_isolated(g).nodes) == ["a", "b"]
    assert match.subgraph(g, g.nodes.filter("id = 'a'")).edges.count() == 0
