"""Filters, searches and one-hop joins on a property graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..tables import first_by


def contains(c: Column, part: str) -> Column:
    """Substring, case ignored."""
    return F.lower(c).contains(part.lower())


def by_label(graph: PropertyGraph, label: str) -> DataFrame:
    return graph.nodes.filter(F.col("label") == label)


def with_properties(nodes: DataFrame, props: dict[str, object]) -> DataFrame:
    """Equality on each property, all of them; empty strings ask for nothing."""
    for name, value in props.items():
        if value != "":
            nodes = nodes.filter(F.col(name) == F.lit(value))
    return nodes


def filter_nodes(graph: PropertyGraph, id_equals: str | None = None, label_in: Sequence[str] = (), name_contains: str = "", path_contains: str = "", props: dict | None = None) -> DataFrame:
    """All given conditions; an empty one asks for nothing. The path is ``path``, where it is empty ``filePath``."""
    out = graph.nodes
    if id_equals:
        out = out.filter(F.col("id") == id_equals)
    if label_in:
        out = out.filter(F.col("label").isin(*label_in))
    if name_contains:
        out = out.filter(contains(F.col("name"), name_contains))
    if path_contains:
        out = out.filter(contains(F.coalesce(F.nullif("path", F.lit("")), "filePath"), path_contains))
    return with_properties(out, props or {})


def filter_edges(graph: PropertyGraph, type_in: Sequence[str] = (), from_in: Sequence[str] = (), to_in: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    out = graph.edges
    for name, values in (("type", type_in), ("src", from_in), ("dst", to_in)):
        if values:
            out = out.filter(F.col(name).isin(*values))
    return out if limit is None else page(out, limit)


def search(graph: PropertyGraph, term: str, label: str | None = None) -> DataFrame:
    """Nodes whose name, filePath and qualifiedName, joined by spaces, contain the term."""
    parts = [F.nullif(c, F.lit("")) for c in ("name", "filePath", "qualifiedName")]
    out = graph.nodes.filter(contains(F.concat_ws(" ", *parts), term))
    return out if label is None else out.filter(F.col("label") == label)


def page(df: DataFrame, limit: int = 100, offset: int = 0, order: Sequence = ("ord", "id")) -> DataFrame:
    """A page in insertion order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def one_hop(graph: PropertyGraph, kind: str, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    """(a, b) as structs for each edge of a type whose ends exist; parallel edges give a row each."""
    def end(name: str, label: str | None) -> DataFrame:
        nodes = graph.nodes if label is None else graph.nodes.filter(F.col("label") == label)
        return nodes.select(F.col("id").alias(f"{name}_id"), F.struct("id", "label", "name", "path").alias(name))

    edges = graph.edges.filter(F.col("type") == kind).select("src", "dst")
    return edges.join(end("a", src_label), F.col("src") == F.col("a_id")).join(end("b", dst_label), F.col("dst") == F.col("b_id")).select("a", "b")


def incident(graph: PropertyGraph, node_id: str) -> DataFrame:
    """Edges into and out of a node, with their direction; a self-loop is both."""
    into = graph.edges.filter(F.col("dst") == node_id).withColumn("direction", F.lit("in"))
    return into.unionByName(graph.edges.filter(F.col("src") == node_id).withColumn("direction", F.lit("out")))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (type, src, dst): the first."""
    return first_by(edges, ["type", "src", "dst"], [F.col("ord"), F.col("id")])


def subgraph(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Nodes of an id list, and the edges between them, each once."""
    nodes = graph.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    ends = nodes.select("id")
    edges = graph.edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph.of(nodes, dedupe_edges(edges))


def drop_isolated(graph: PropertyGraph) -> PropertyGraph:
    """Without nodes that no edge touches."""
    ends = graph.edges.select(F.col("src").alias("id")).unionByName(graph.edges.select(F.col("dst").alias("id"))).distinct()
    nodes = graph.nodes.join(ends, "id", "left_semi")
    return PropertyGraph(nodes, graph.edges)


def isolated(graph: PropertyGraph) -> DataFrame:
    ends = graph.edges.select(F.col("src").alias("id")).unionByName(graph.edges.select(F.col("dst").alias("id"))).distinct()
    return graph.nodes.join(ends, "id", "left_anti")


#: Parts of names of well-known libraries.
LIBRARY_PARTS = ["when_all", "ruleset", "APIRouter", "StateGraph", "AsyncAzureOpenAI", "FastAPI", "HTTPException", "assert_fact", "get_facts", "delete_state", "anyItem", "allItems", "matches"]


def from_library(name: Column, label: Column) -> Column:
    """Decorators and functions that look like a library's."""
    known = F.lit(False)
    for part in LIBRARY_PARTS:
        known = known | name.contains(part)
    camel = name.rlike("^[A-Z][a-zA-Z]*(Model|Client|Router|Exception)$") | (name.rlike("^[A-Z][a-zA-Z]*$") & (F.length(name) > 3))
    return label.isin("Decorator", "Function") & (known | camel)


def sample_graph(graph: PropertyGraph, limit: int) -> PropertyGraph:
    """The first ``limit`` nodes; of each type the first ceil(limit / types) edges, ``limit`` at most."""
    nodes = page(graph.nodes, limit)
    kinds = graph.edges.select("type").distinct().count() or 1
    each = -(-limit // kinds)
    ranked = graph.edges.withColumn("_k", F.row_number().over(Window.partitionBy("type").orderBy("ord", "id")))
    return PropertyGraph(nodes, page(ranked.filter(F.col("_k") <= each).drop("_k"), limit, order=("type", "ord", "id")))


def result_graph(rows: DataFrame, node_columns: Sequence[str]) -> DataFrame:
    """The node structs of a result's columns, each id once."""
    out = None
    for c in node_columns:
        part = rows.select(f"{c}.*")
        out = part if out is None else out.unionByName(part)
    return out.filter("id IS NOT NULL").dropDuplicates(["id"])


def find_files(files: DataFrame, pattern: str, limit: int = 10, in_content: bool = True, ignore_case: bool = False) -> DataFrame:
    """The first files whose path (or content) contains a pattern."""
    fold = F.lower if ignore_case else (lambda c: c)
    want = pattern.lower() if ignore_case else pattern
    hit = fold(F.col("path")).contains(want)
    if in_content:
        hit = hit | fold(F.col("content")).contains(want)
    return files.filter(hit).orderBy("path").limit(limit)


def file_content(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def folder_children(nodes: DataFrame, folder: str, depth: int) -> DataFrame:
    """Files anywhere below a folder, and folders one level below it."""
    below = F.col("path").startswith(folder.rstrip("/") + "/")
    return nodes.filter(below & ((F.col("label") == "File") | ((F.col("label") == "Folder") & (F.col("depth") == depth + 1))))


def file_of(graph: PropertyGraph) -> DataFrame:
    """node id -> file id: over CONTAINS, else over DEFINES."""
    files = graph.nodes.filter("label = 'File'").select(F.col("id").alias("file_id"))
    edges = graph.edges.filter(F.col("type").isin("CONTAINS", "DEFINES")).join(files, F.col("src") == F.col("file_id"), "left_semi")
    return first_by(edges.withColumn("tier", F.when(F.col("type") == "CONTAINS", 0).otherwise(1)), ["dst"], [F.col("tier"), F.col("ord"), F.col("src")]).select(F.col("dst").alias("id"), F.col("src").alias("file_id"))
