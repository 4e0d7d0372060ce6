"""Histograms, schema text, integrity and file analysis of a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LABELS, STRICT_LABELS, STRICT_TYPES, TYPES, PropertyGraph

DEFINED = ["Function", "Class", "Method", "Variable", "Interface", "Type"]


def label_histogram(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def type_histogram(graph: PropertyGraph) -> DataFrame:
    return graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """Counts, and the labels and types in use (sorted)."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("nodeCount"), F.array_sort(F.collect_set("label")).alias("labels"))
    return n.crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("edgeCount"), F.array_sort(F.collect_set("type")).alias("types")))  # one row each


def summary(graph: PropertyGraph, examples: int = 5) -> DataFrame:
    """One text: totals, counts by label and type, the first few nodes."""
    pairs = lambda df, k: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "n"))), lambda s: F.concat_ws(":", s[k], s["n"])), ", ").alias(k))
    first = graph.nodes.orderBy("ord", "id").limit(examples).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]), ", ").alias("examples"))
    totals = graph_stats(graph).select("nodeCount", "edgeCount")
    one = totals.crossJoin(pairs(label_histogram(graph), "label")).crossJoin(pairs(type_histogram(graph), "type")).crossJoin(first)  # one row each
    return one.select(F.format_string("nodes=%d edges=%d\nlabels: %s\ntypes: %s\nexamples: %s", "nodeCount", "edgeCount", "label", "type", "examples").alias("summary"))


def describe_schema(graph: PropertyGraph) -> DataFrame:
    """kind, name, n, properties: for each label its count and the properties that are set, for each type its count."""
    skip = {"id", "label", "ord", "extras"}
    named = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in graph.nodes.columns if c not in skip]))
    nodes = graph.nodes.select("label", named.alias("p")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.array_contains("p", c)).alias(f"has_{c}") for c in graph.nodes.columns if c not in skip])
    listed = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in graph.nodes.columns if c not in skip])))
    edges = graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n", F.array_join(listed, ", ").alias("properties")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n", F.lit("").alias("properties")))


def integrity(graph: PropertyGraph) -> DataFrame:
    """rule, id: dangling ends, files outside folders, source files without definitions, definitions without a file."""
    n, e = graph.nodes, graph.edges
    ids = n.select("id")
    files = n.filter("label = 'File'")
    held = e.filter("type = 'CONTAINS'").select(F.col("dst").alias("id"))
    defining = e.filter("type = 'DEFINES'").select(F.col("src").alias("id"))
    defined = e.filter(F.col("type").isin("DEFINES", "CONTAINS")).select(F.col("dst").alias("id"))
    rule = lambda df, name, c="id": df.select(F.lit(name).alias("rule"), F.col(c).alias("id"))
    edge_key = F.concat_ws("|", "type", "src", "dst").alias("id")
    return (
        rule(e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(edge_key), "dangling source")
        .unionByName(rule(e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edge_key), "dangling target"))
        .unionByName(rule(files.join(held, "id", "left_anti"), "file without parent"))
        .unionByName(rule(files.join(defining, "id", "left_anti"), "file without definitions"))
        .unionByName(rule(n.filter(F.col("label").isin(*DEFINED)).join(defined, "id", "left_anti"), "definition without file"))
    )


def violations(graph: PropertyGraph, strict_reference: bool = False) -> DataFrame:
    """rule, id of what a valid graph doesn't have; ``strict_reference`` narrows the vocabularies."""
    n, e = graph.nodes, graph.edges
    labels, types = (STRICT_LABELS, STRICT_TYPES) if strict_reference else (LABELS, TYPES)
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("id"))
    twice = lambda df: df.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    ids = n.select("id")
    out = rule(twice(n), "duplicate node id").unionByName(rule(twice(e), "duplicate edge id"))
    out = out.unionByName(rule(n.filter("id IS NULL OR id = ''"), "empty id"))
    out = out.unionByName(rule(n.filter(~F.col("label").isin(*labels) | F.col("label").isNull()), "unknown label"))
    out = out.unionByName(rule(e.filter(~F.col("type").isin(*types) | F.col("type").isNull()), "unknown type"))
    out = out.unionByName(rule(n.filter("startLine < 0 OR endLine < startLine"), "line range"))
    out = out.unionByName(rule(e.filter("strength NOT BETWEEN 0 AND 1 OR confidence NOT BETWEEN 0 AND 1"), "value range"))
    out = out.unionByName(rule(e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "invalid source"))
    return out.unionByName(rule(e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), "invalid target"))


#: Fixed values: (test on path, name and definitions; reason), the first that holds counts.
def suspicion(path: Column, name: Column, defined: Column) -> Column:
    rules = [
        (name.contains("readme"), "Documentation file (README)"),
        (name.contains("license"), "License file"),
        (name.contains("changelog"), "Changelog file"),
        (name.contains("dockerfile"), "Docker configuration"),
        (name.contains("docker-compose"), "Docker Compose file"),
        (name.contains(".gitignore"), "Git ignore file"),
        (name.contains(".gitattributes"), "Git attributes file"),
        (name.endswith(".md"), "Markdown documentation"),
        (name.endswith(".txt"), "Text file"),
        (name.endswith(".log"), "Log file"),
        (name.endswith(".lock"), "Lock file"),
        (name.contains("package-lock"), "Package lock file"),
        (name.contains("yarn.lock"), "Yarn lock file"),
        (path.contains("/test/") | path.contains("/tests/"), "Test directory file"),
        (path.contains("/__tests__/"), "Jest test file"),
        (name.contains(".test.") | name.contains(".spec."), "Test/spec file"),
        (name.contains("mock"), "Mock file"),
        (name.contains("fixture"), "Test fixture"),
        (~defined & name.endswith(".js"), "JavaScript file with no definitions"),
        (~defined & name.endswith(".ts"), "TypeScript file with no definitions"),
        (~defined & name.endswith(".py"), "Python file with no definitions"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for test, reason in rules[1:]:
        out = out.when(test, reason)
    return out


def analyse_files(graph: PropertyGraph) -> DataFrame:
    """id, path, extension, hasDefinitions, reason (null: nothing suspicious) of each file."""
    targets = graph.nodes.filter(F.col("label").isin(*DEFINED)).select(F.col("id").alias("dst"))
    defining = graph.edges.filter("type = 'DEFINES'").join(targets, "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("d", F.lit(True))
    path = F.coalesce(F.nullif("filePath", F.lit("")), "path")
    files = graph.nodes.filter("label = 'File'").select("id", path.alias("path")).join(defining, "id", "left").withColumn("hasDefinitions", F.coalesce("d", F.lit(False)))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    extension = F.element_at(F.split(name, r"\."), -1)
    return files.select("id", "path", F.concat(F.lit("."), extension).alias("extension"), "hasDefinitions", suspicion(F.col("path"), name, F.col("hasDefinitions")).alias("reason"))


def recommendations(files: DataFrame) -> DataFrame:
    """total, suspicious, documentation, tests, undefined, tooMany (over a fifth suspicious)."""
    r = F.col("reason")
    return files.agg(
        F.count(F.lit(1)).alias("total"), F.count("reason").alias("suspicious"),
        F.count_if(r.contains("Documentation") | r.contains("Markdown") | r.contains("README") | r.contains("License")).alias("documentation"),
        F.count_if(r.contains("Test") | r.contains("Mock") | r.contains("fixture")).alias("tests"),
        F.count_if(~F.col("hasDefinitions") & r.contains("no definitions")).alias("undefined"),
    ).withColumn("tooMany", F.col("suspicious") > F.col("total") * 0.2)


def registry_stats(defs: DataFrame) -> DataFrame:
    return defs.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("filePath").alias("files"), F.count_distinct("name").alias("names"))


def definitions_by_file(defs: DataFrame) -> DataFrame:
    return defs.groupBy("filePath", "type").agg(F.count(F.lit(1)).alias("n"))


def call_stats(calls: DataFrame) -> DataFrame:
    """Counts of calls (callType, resolutionStage; a null stage failed) by kind and stage."""
    return calls.groupBy("callType", F.coalesce("resolutionStage", F.lit("failed")).alias("resolutionStage")).agg(F.count(F.lit(1)).alias("n"))
