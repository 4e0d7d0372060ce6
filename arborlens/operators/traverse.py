"""Bounded paths, neighbourhoods, shortest paths, degrees, depth.

Levels are built by joins of a frontier with the edges. Where levels depend on what was visited before, each
is cut into a table, so plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..tables import cut, first_by
from .match import dedupe_edges


def typed(edges: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    return edges.filter(F.col("type").isin(*types)) if types else edges


def simple_paths(edges: DataFrame, starts: DataFrame, low: int, high: int, types: Sequence[str] = (), forward: bool = True) -> DataFrame:
    """(start, end, hops) for each path of low..high edges that meets no node twice; parallel edges are paths
    of their own. ``starts`` (id) seeds the paths; only what they reach is expanded."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = typed(edges, types).select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("seen"))
    out = level.select("start", "end", F.lit(0).alias("hops")) if low == 0 else None
    for hops in range(1, high + 1):
        level = level.join(step, F.col("end") == F.col("_from")).filter(~F.array_contains("seen", F.col("_to")))
        level = level.select("start", F.col("_to").alias("end"), F.concat("seen", F.array("_to")).alias("seen"))
        if hops >= low:
            part = level.select("start", "end", F.lit(hops).alias("hops"))
            out = part if out is None else out.unionByName(part)
    return out


def variable_length(graph: PropertyGraph, src_label: str | None, kind: str, dst_label: str | None, low: int, high: int, ends: int | None = None, per_pair: int | None = None) -> DataFrame:
    """(a, b, pathLength). ``ends`` cuts sources and targets to the first so many of their label, ``per_pair`` the
    paths of a pair to the shortest so many."""
    def side(label: str | None) -> DataFrame:
        nodes = graph.nodes if label is None else graph.nodes.filter(F.col("label") == label)
        return (nodes if ends is None else nodes.orderBy("ord", "id").limit(ends)).select("id")

    paths = simple_paths(graph.edges, side(src_label), low, high, [kind]).join(side(dst_label).withColumnRenamed("id", "end"), "end", "left_semi").filter("start <> end")
    if per_pair is not None:
        paths = paths.withColumn("_k", F.row_number().over(Window.partitionBy("start", "end").orderBy("hops"))).filter(F.col("_k") <= per_pair)
    return paths.select(F.col("start").alias("a"), F.col("end").alias("b"), F.col("hops").alias("pathLength"))


def distances(edges: DataFrame, starts: DataFrame, types: Sequence[str] = (), forward: bool = True, most: int | None = None, both: bool = False) -> DataFrame:
    """(start, node, depth): fewest edges from each start, itself at 0; stops when no level adds a node."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = typed(edges, types).select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    if both:
        step = step.unionByName(step.select(F.col("_to").alias("_from"), F.col("_from").alias("_to")))
    step = step.distinct()
    seen = frontier = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "level")
    depth = 0
    while most is None or depth < most:
        depth += 1
        reached = frontier.join(step, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbours(graph: PropertyGraph, seeds: Sequence[str], depth: int = 1, direction: str = "both", types: Sequence[str] = (), limit: int | None = 500) -> PropertyGraph:
    """The nodes within ``depth`` edges of the seeds, and every edge met on the way, each once. Unknown seeds
    are dropped; at most ``limit`` nodes, nearest first, then in insertion order; None for all."""
    nodes = graph.nodes.filter(F.col("id").isin(*seeds)).select("id")
    near = distances(graph.edges, nodes, types, direction != "in", depth, direction == "both")
    level = near.groupBy("node").agg(F.min("depth").alias("_level"))
    kept = graph.nodes.join(level, F.col("id") == F.col("node")).drop("node")
    if limit is not None:
        kept = kept.orderBy("_level", "ord", "id").limit(limit)
    inner = level.filter(F.col("_level") < depth).select(F.col("node").alias("n"))
    edges = typed(graph.edges, types)
    out = edges.join(inner, F.col("src") == F.col("n"), "left_semi")
    into = edges.join(inner, F.col("dst") == F.col("n"), "left_semi")
    met = out if direction == "out" else into if direction == "in" else out.unionByName(into)
    ids = kept.select("id")
    met = met.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(kept.drop("_level"), dedupe_edges(met))


def shortest_path(graph: PropertyGraph, src: str, dst: str, most: int = 6, types: Sequence[str] = ()) -> DataFrame:
    """(step, src, dst, type) of one shortest path, the first by edge order; none from a node to itself or beyond
    ``most`` edges. Levels are kept once each, with the edge that first reached a node."""
    edges = typed(graph.edges, types)
    spark = edges.sparkSession
    level = cut(graph.nodes.filter(F.col("id") == src).select(F.col("id").alias("node")), "level")
    seen, levels, found = level, [], src == dst
    for k in range(1, most + 1):
        if found:
            break
        reached = edges.join(level, F.col("src") == F.col("node")).join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = cut(first_by(reached.select("src", "dst", "type", "ord", "id"), ["dst"], [F.col("ord"), F.col("id")]).withColumn("step", F.lit(k)), "level")
        levels.append(first)
        level = first.select(F.col("dst").alias("node"))
        seen = seen.unionByName(level)
        if first.isEmpty():
            break
        found = not first.filter(F.col("dst") == dst).isEmpty()
    empty = spark.createDataFrame([], "step int, src string, dst string, type string")
    if not found or src == dst:
        return empty
    out, at = empty, dst
    for first in reversed(levels):
        row = first.filter(F.col("dst") == at)
        out = out.unionByName(row.select("step", "src", "dst", "type"))
        at = row.select("src").first()[0]  # one id a level
    return out.orderBy("step")


def degrees(graph: PropertyGraph) -> DataFrame:
    """id, inDegree, outDegree, totalDegree, childrenCount, isRoot; edges with a missing end don't count."""
    ids = graph.nodes.select("id")
    real = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = real.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), (F.col("type") == "CONTAINS").cast("int").alias("c")).unionByName(real.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("c")))
    sums = ends.groupBy("id").agg(*[F.sum(c).alias(c) for c in "ioc"])
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return graph.nodes.select("id", "label").join(sums, "id", "left").select("id", "label", n("i").alias("inDegree"), n("o").alias("outDegree"), (n("i") + n("o")).alias("totalDegree"), n("c").alias("childrenCount"), ((n("i") == 0) & (n("o") > 0)).alias("isRoot"))


def containment_depth(graph: PropertyGraph, most: int = 64) -> DataFrame:
    """id, depth: the longest CONTAINS chain from a root; nodes that only a cycle reaches are at 0."""
    step = graph.edges.filter("type = 'CONTAINS'").select(F.col("src").alias("_from"), F.col("dst").alias("_to")).filter("_from <> _to").distinct()
    level = cut(graph.nodes.select("id").join(step.select(F.col("_to").alias("id")), "id", "left_anti"), "level")
    found = level.withColumn("depth", F.lit(0))
    for k in range(1, most + 1):
        level = cut(step.join(level, F.col("_from") == F.col("id")).select(F.col("_to").alias("id")).distinct(), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("depth", F.lit(k)))
    deepest = found.groupBy("id").agg(F.max("depth").alias("depth"))
    return graph.nodes.select("id").join(deepest, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def importance(base: Column, depth: Column, degree: Column, children: Column, root: Column) -> Column:
    """A node's drawn size: its base times capped factors, between 4 and 35."""
    one = F.lit(1.0)
    size = base * F.greatest(F.lit(0.7), F.lit(1.5) - depth * 0.15)
    size = size * F.when(degree > 0, 1 + F.least(F.lit(0.8), degree * 0.1)).otherwise(one)
    size = size * F.when(children > 0, 1 + F.least(F.lit(0.6), children * 0.08)).otherwise(one)
    size = size * F.when(root, 1.4).otherwise(one) * F.when(degree > 10, 1.3).otherwise(one)
    return F.floor(F.least(F.lit(35.0), F.greatest(F.lit(4.0), size)) + 0.5).cast("long")


def real_links(graph: PropertyGraph) -> DataFrame:
    """Edges whose ends exist and differ."""
    ids = graph.nodes.select("id")
    return graph.edges.filter("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
