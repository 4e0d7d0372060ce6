"""Graphs in and out: JSON, CSV, Parquet, tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_quote, human_size
from ..model import EDGE_DDL, NODE_DDL, PropertyGraph

NODE_HEADER = ":ID,name,filePath,startLine,endLine,type,language,qualifiedName,:LABEL"
EDGE_HEADER = ":START_ID,:TYPE,:END_ID,source,target"


def _field(c: str):
    """A value as a CSV field; nulls, empty strings and noughts are empty."""
    s = F.col(c).cast("string")
    return F.when(s.isNull() | s.isin("0", "false"), "").otherwise(csv_quote(s))


def node_csv(graph: PropertyGraph) -> DataFrame:
    """ord, line: the nodes as CSV lines, without the header."""
    names = ["id", "name", "filePath", "startLine", "endLine", "type", "language", "qualifiedName", "label"]
    return graph.nodes.select("ord", F.concat_ws(",", *[_field(c) for c in names]).alias("line"))


def edge_csv(graph: PropertyGraph) -> DataFrame:
    return graph.edges.select("ord", F.concat_ws(",", *[_field(c) for c in ("src", "type", "dst", "src", "dst")]).alias("line"))


def csv_text(lines: DataFrame, header: str) -> str:
    """A whole CSV as one text, for small graphs."""
    rows = [r[0] for r in lines.orderBy("ord").select("line").collect()]
    return "\n".join([header, *rows]) + ("" if rows else "\n")


def write_csv(graph: PropertyGraph, folder: str) -> None:
    """Parts of nodes and edges as CSV files with headers."""
    n = graph.nodes
    n.select(F.col("id").alias(":ID"), *[F.col(c) for c in ("name", "filePath", "startLine", "endLine", "type", "language", "qualifiedName")], F.col("label").alias(":LABEL")).write.csv(f"{folder}/nodes", header=True, quote='"', escape='"')
    graph.edges.select(F.col("src").alias(":START_ID"), F.col("type").alias(":TYPE"), F.col("dst").alias(":END_ID"), F.col("src").alias("source"), F.col("dst").alias("target")).write.csv(f"{folder}/edges", header=True, quote='"', escape='"')


def to_json(graph: PropertyGraph, metadata: dict | None = None, pretty: bool = False) -> str:
    """A small graph as one JSON text: nodes and relationships, wrapped in metadata if there is any."""
    nodes = [json.loads(r[0]) for r in graph.nodes.orderBy("ord", "id").select(F.to_json(F.struct("*"))).collect()]
    edges = [json.loads(r[0]) for r in graph.edges.orderBy("ord", "id").select(F.to_json(F.struct("*"))).collect()]
    body: dict = {"nodes": nodes, "relationships": edges}
    return json.dumps({"metadata": metadata, "graph": body} if metadata else body, indent=2 if pretty else None)


def write_json(graph: PropertyGraph, folder: str) -> None:
    graph.nodes.write.json(f"{folder}/nodes")
    graph.edges.write.json(f"{folder}/edges")


def read_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from JSON, bare or wrapped in metadata."""
    graph = f"struct<nodes: array<struct<{_fields(NODE_DDL)}>>, relationships: array<struct<{_fields(EDGE_DDL)}>>>"
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"struct<graph: {graph}, nodes: array<struct<{_fields(NODE_DDL)}>>, relationships: array<struct<{_fields(EDGE_DDL)}>>>").alias("j"))
    nodes = parsed.select(F.posexplode(F.coalesce("j.graph.nodes", "j.nodes")).alias("k", "n")).select("n.*", "k").withColumn("ord", F.coalesce("ord", F.col("k").cast("long"))).drop("k")
    edges = parsed.select(F.posexplode(F.coalesce("j.graph.relationships", "j.relationships")).alias("k", "e")).select("e.*", "k").withColumn("ord", F.coalesce("ord", F.col("k").cast("long"))).drop("k")
    return PropertyGraph.of(nodes, edges)


def _fields(ddl: str) -> str:
    return ", ".join(x.replace(" ", ": ", 1) for x in ddl.split(", "))


def save(graph: PropertyGraph, folder: str) -> None:
    """Parquet, nodes by label and edges by type, so that a label or type scan reads its own files."""
    graph.nodes.write.partitionBy("label").parquet(f"{folder}/nodes")
    graph.edges.write.partitionBy("type").parquet(f"{folder}/edges")


def load(spark: SparkSession, folder: str) -> PropertyGraph:
    return PropertyGraph.of(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def create_tables(graph: PropertyGraph, prefix: str) -> list[str]:
    """Managed tables of nodes and edges."""
    graph.nodes.write.partitionBy("label").saveAsTable(f"{prefix}_nodes")
    graph.edges.write.partitionBy("type").saveAsTable(f"{prefix}_edges")
    return [f"{prefix}_nodes", f"{prefix}_edges"]


def table_info(spark: SparkSession, prefix: str) -> list[tuple[str, int]]:
    return [(t.name, spark.table(t.name).count()) for t in spark.catalog.listTables() if t.name.startswith(f"{prefix}_")]


def drop_tables(spark: SparkSession, prefix: str) -> None:
    for t in spark.catalog.listTables():
        if t.name in (f"{prefix}_nodes", f"{prefix}_edges"):
            spark.sql(f"DROP TABLE {t.name}")


def without(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """A graph without some nodes and the edges that touch them."""
    gone = ids.select("id").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return PropertyGraph.of(graph.nodes.join(gone, "id", "left_anti"), edges)


def export_size(graph: PropertyGraph) -> DataFrame:
    """bytes and their human form of the compact JSON of a graph."""
    own = lambda df: df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1), F.lit(0)).alias("b"))
    total = own(graph.nodes).unionByName(own(graph.edges)).agg((F.sum("b") + len('{"nodes":[],"relationships":[]}')).alias("bytes"))
    return total.withColumn("size", human_size(F.col("bytes")))


def filtered(graph: PropertyGraph, labels: list[str] | None = None, patterns: list[str] | None = None, most: int | None = None, types: list[str] | None = None) -> PropertyGraph:
    """Nodes by label, by path patterns (``*`` is any text), the first ``most``; edges between them by type."""
    nodes = graph.nodes
    if labels:
        nodes = nodes.filter(F.col("label").isin(*labels))
    if patterns:
        path = F.coalesce(F.nullif("filePath", F.lit("")), "path", F.lit(""))
        test = F.lit(False)
        for p in patterns:
            test = test | path.rlike("(?i)" + p.replace("*", ".*"))
        nodes = nodes.filter(test)
    if most is not None:
        nodes = nodes.orderBy("ord", "id").limit(most)
    ids = nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph.of(nodes, edges.filter(F.col("type").isin(*types)) if types else edges)


def validate_export(graph: PropertyGraph, most_bytes: int = 50 << 20) -> DataFrame:
    """level, message, id: duplicate ids and dangling ends are errors, emptiness and size warnings."""
    from ..operators.stats import violations

    errors = violations(graph).filter(F.col("rule").isin("duplicate node id", "duplicate edge id", "invalid source", "invalid target")).select(F.lit("error").alias("level"), F.col("rule").alias("message"), "id")
    empty = graph.nodes.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("warning").alias("level"), F.lit("no nodes").alias("message"), F.lit(None).cast("string").alias("id"))
    large = export_size(graph).filter(F.col("bytes") > most_bytes).select(F.lit("warning").alias("level"), F.concat(F.lit("large: "), F.col("size")).alias("message"), F.lit(None).cast("string").alias("id"))
    return errors.unionByName(empty).unionByName(large)
