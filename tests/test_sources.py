import json
import zipfile

import pytest

from arborlens.model import PropertyGraph
from arborlens.sources import archives, graphs
from arborlens.streaming import lines
from arborlens.streaming import metrics as streams


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        {"id": "func_123", "label": "Function", "name": "validateInput", "filePath": "src/utils/validation.ts", "startLine": 15, "endLine": 25, "type": "function", "language": "typescript", "qualifiedName": "utils.validation.validateInput"},
        {"id": "class_456", "label": "Class", "name": "UserService", "filePath": "src/services/user.ts", "startLine": 1, "endLine": 50, "type": "class", "language": "typescript", "qualifiedName": "services.user.UserService"},
    ]
    edges = [{"id": "rel_789", "type": "CALLS", "src": "func_123", "dst": "func_456"}, {"id": "rel_101", "type": "CONTAINS", "src": "class_456", "dst": "func_123"}]
    return PropertyGraph.from_rows(spark, nodes, edges)


def test_csv_golden(graph, spark):
    text = graphs.csv_text(graphs.node_csv(graph), graphs.NODE_HEADER)
    assert text.split("\n") == [":ID,name,filePath,startLine,endLine,type,language,qualifiedName,:LABEL", "func_123,validateInput,src/utils/validation.ts,15,25,function,typescript,utils.validation.validateInput,Function", "class_456,UserService,src/services/user.ts,1,50,class,typescript,services.user.UserService,Class"]
    assert graphs.csv_text(graphs.edge_csv(graph), graphs.EDGE_HEADER).split("\n")[1:] == ["func_123,CALLS,func_456,func_123,func_456", "class_456,CONTAINS,func_123,class_456,func_123"]
    empty = PropertyGraph.from_rows(spark, [], [])
    assert graphs.csv_text(graphs.node_csv(empty), graphs.NODE_HEADER) == graphs.NODE_HEADER + "\n"
    odd = PropertyGraph.from_rows(spark, [{"id": "x", "label": "File", "name": 'a "b", c', "startLine": 0}], [])
    assert graphs.csv_text(graphs.node_csv(odd), graphs.NODE_HEADER).split("\n")[1] == 'x,"a ""b"", c",,,,,,,File'


def test_json_and_parquet_round_trip(graph, spark, tmp_path):
    for metadata in (None, {"project": "p"}):
        (tmp_path / "g.json").write_text(graphs.to_json(graph, metadata, pretty=True))
        back = graphs.read_json(spark, str(tmp_path / "g.json"))
        assert back.nodes.orderBy("ord").collect() == graph.nodes.orderBy("ord").collect()
        assert back.edges.count() == 2
    assert json.loads(graphs.to_json(graph))["nodes"][0]["id"] == "func_123"
    graphs.save(graph, str(tmp_path / "p"))
    assert graphs.load(spark, str(tmp_path / "p")).nodes.filter("label = 'Class'").count() == 1
    graphs.write_csv(graph, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c/nodes"), header=True).columns[0] == ":ID"


def test_filtered_and_validated(graph):
    assert graphs.filtered(graph, patterns=["SERVICES/*.ts"]).nodes.count() == 1
    kept = graphs.filtered(graph, labels=["Function", "Class"], types=["CONTAINS"])
    assert kept.edges.count() == 1
    assert graphs.filtered(graph, most=1).edges.count() == 0
    assert [tuple(r) for r in graphs.validate_export(graph).collect()] == [("error", "invalid target", "rel_789")]
    size = graphs.export_size(graph).first()
    assert size.bytes > 500 and size["size"].endswith("Bytes")
    assert graphs.without(graph, graph.nodes.filter("id = 'class_456'")).edges.count() == 1


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("repo/", "")
        z.writestr("repo/src/a.py", "x = 1\n")
        z.writestr("repo/empty.py", "")
        z.writestr("repo/big.txt", "y" * 2000)
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    entries = archives.read_archives(spark, str(tmp_path / "*.zip"))
    assert entries.filter("error IS NOT NULL").count() == 1
    paths, texts = archives.complete(entries, max_file=1000)
    assert [r.path for r in paths.collect()] == ["repo", "repo/big.txt", "repo/empty.py", "repo/src", "repo/src/a.py"]
    assert [tuple(r) for r in texts.collect()] == [("repo/src/a.py", "x = 1\n")]
    assert archives.texts(entries, max_total=2000).count() == 1
    assert archives.pick(entries, spark.createDataFrame([("repo/src/a.py",), ("none",)], "path string")).count() == 1
    assert sorted(r.path for r in archives.strip_top_folder(paths).collect()) == ["big.txt", "empty.py", "src", "src/a.py"]
    assert archives.listing(entries).count() == 4
    names = spark.createDataFrame([("r/latest.ts",), ("r/node_modules/x.js",), ("r/test/a.ts",)], "path string")
    assert sorted(r.path for r in archives.clean_archive_paths(names).collect()) == ["latest.ts", "test/a.ts"]
    assert archives.clean_archive_paths(names, reference_quirk=True).count() == 0


def test_directory(spark, tmp_path):
    (tmp_path / "d" / "s").mkdir(parents=True)
    (tmp_path / "d" / "s" / "a.py").write_text("x")
    assert [(r.path, r.content) for r in archives.read_directory(spark, str(tmp_path / "d")).collect()] == [("s/a.py", "x")]


def test_lines_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "line 1"), (2, "line 2"), (3, "skip"), (4, "bad")], "line long, text string")

    def work(text, n):
        if text == "bad":
            raise ValueError("no")
        return None if text == "skip" else text.upper()

    rows = lines.map_lines(df, work).orderBy("line").collect()
    assert [r.result for r in rows] == ["LINE 1", "LINE 2", None] and rows[2].error == "no: bad"
    items = spark.createDataFrame([(str(k),) for k in range(1, 6)], "value string").coalesce(1)
    assert sorted(r.value for r in lines.map_batches(items, lambda b: [str(len(b))], 2).collect()) == ["1", "2", "2"]
    files = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, content string")
    assert {r.path: r.error is None for r in lines.map_files(files, lambda p, c: str(int(c))).collect()} == {"a": True, "b": False}
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert [r.text for r in lines.read_lines(spark, str(tmp_path / "t.txt")).orderBy("line").collect()] == ["one", "two"]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("MATCH (a {x: '1'}) RETURN a", 10.0), ("MATCH (a {x: '2'}) RETURN a", 30.0)], "query string, executionTime double")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = streams.read_stream(spark, str(tmp_path / "log"), "query string, executionTime double")
    out = lines.drain(streams.learn(stream), "learned", str(tmp_path / "c1"), "update").collect()
    assert [(r.usageCount, r.averageExecutionTime) for r in out] == [(2, 20.0)]
    points = spark.createDataFrame([("cpu", 90.0), ("cpu", 10.0)], "name string, value double")
    assert [r.threshold for r in streams.alerts(points, [("cpu", "gt", 80.0), ("mem", "gt", 1.0)]).collect()] == [80.0]


def test_repository_source(spark, tmp_path):
    from arborlens.sources.remote import RepositorySource

    (tmp_path / "r" / "s").mkdir(parents=True)
    for k in range(5):
        (tmp_path / "r" / "s" / f"{k}.py").write_text(f"x = {k}")
    os_gone = tmp_path / "r" / "gone.py"
    os_gone.symlink_to(tmp_path / "nowhere")
    spark.dataSource.register(RepositorySource)
    df = spark.read.format("repository").option("root", str(tmp_path / "r")).option("batch", "2").load()
    assert df.rdd.getNumPartitions() == 3
    assert [r.path for r in df.filter("error IS NULL").orderBy("path").collect()] == [f"s/{k}.py" for k in range(5)]
    assert df.filter("error IS NOT NULL").count() == 1
