"""The four passes, as one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..model import PropertyGraph
from ..tables import cut
from . import resolve, structure
from .extract import extract


def ingest(files: DataFrame, project: str, paths: DataFrame | None = None, innermost: bool = False) -> PropertyGraph:
    """(path, content) -> graph. ``paths`` may name more paths than have content, folders too."""
    files = files.select(P.normalize(F.col("path")).alias("path"), "content")
    paths = files.select("path") if paths is None else paths
    nodes, contains = structure.build(paths, project)
    eligible = files.filter(~P.hidden(F.col("path")) & P.parse_eligible(F.col("path"), F.col("content")) & P.is_source(F.col("path")) & ~P.minified(F.col("path"), F.col("content")))
    rows = cut(extract(eligible), "extracted")  # the only Python pass, read four times
    facts = files.select("path", F.octet_length("content").cast("long").alias("size"), F.size(F.split("content", "\n")).cast("long").alias("lineCount"))
    counts = rows.filter("kind = 'def'").groupBy("path").agg(F.count(F.lit(1)).alias("definitionCount"))
    nodes = nodes.join(facts.join(counts, "path", "left"), "path", "left")
    defs, defines = resolve.definition_nodes(rows.filter("kind = 'def'"))
    imports = resolve.resolve_imports(rows.filter("kind = 'import'"), files.select("path"))
    calls = resolve.resolve_calls(rows.filter("kind = 'call'").select("path", "ord", "name", "callType", "startLine", "endLine"), imports, defs)
    called = resolve.call_edges(resolve.callers(calls, defs, innermost))
    edges = contains.unionByName(defines, allowMissingColumns=True).unionByName(resolve.import_edges(imports), allowMissingColumns=True).unionByName(called, allowMissingColumns=True)
    return PropertyGraph.of(nodes.unionByName(defs, allowMissingColumns=True), edges)


def diagnostics(files: DataFrame) -> DataFrame:
    """path, language, minified, eligible, definitions, imports, calls, error of each file."""
    c = F.col
    flags = files.select("path", P.language(c("path")).alias("language"), P.minified(c("path"), c("content")).alias("minified"), P.parse_eligible(c("path"), c("content")).alias("eligible"))
    rows = extract(files).groupBy("path").agg(F.count_if(c("kind") == "def").alias("definitions"), F.count_if(c("kind") == "import").alias("imports"), F.count_if(c("kind") == "call").alias("calls"), F.max("error").alias("error"))
    return flags.join(rows, "path", "left").fillna(0, ["definitions", "imports", "calls"])
