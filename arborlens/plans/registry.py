"""All registered queries over the supplied tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import match, metrics, similarity, stats, traverse
from .legacy import run_legacy
from .planner import run_query
from .testgraph import GRAPH_SQL, graph, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, on_graph: bool = False):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (GRAPH_SQL if on_graph else "") + sql
        return f

    return add


def cypher(name: str, text: str, sql: str | None = None, **options) -> None:
    """Register a query text over the test graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_query(graph(spark, sf_dir), text, **options).data

    run.__name__ = name
    query(sql, on_graph=True)(run)


# ---- query texts -------------------------------------------------------------------------------------------
cypher("flagship_callers", "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN b.name AS name, COUNT(a) AS callers ORDER BY callers DESC, b.name LIMIT 20", "SELECT b.name AS name, count(*) AS callers FROM edges e JOIN nodes b ON e.dst = b.id WHERE e.type = 'CALLS' GROUP BY b.name ORDER BY callers DESC, name LIMIT 20")
cypher("b1_label_scan", "MATCH (f:Function) RETURN f.id AS id, f.name AS name ORDER BY f.ord LIMIT 100", "SELECT id, name FROM nodes WHERE label = 'Function' ORDER BY ord LIMIT 100")
cypher("b2_one_hop", "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a.id AS a, b.id AS b ORDER BY a.id, b.id LIMIT 50", "SELECT src AS a, dst AS b FROM edges WHERE type = 'CALLS' ORDER BY 1, 2 LIMIT 50")
cypher(
    "b3_variable_length", "MATCH (a:Function {id: 'P1'})-[:CALLS*1..2]->(b:Function) WHERE a.id <> b.id RETURN b.id AS b, COUNT(*) AS paths",
    """, h1 AS (SELECT dst FROM edges WHERE type = 'CALLS' AND src = 'P1'), h2 AS (SELECT e.dst FROM h1 JOIN edges e ON e.src = h1.dst AND e.type = 'CALLS' WHERE e.dst <> 'P1' AND e.dst <> h1.dst)
SELECT dst AS b, count(*) AS paths FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY dst""",
)
cypher("b4_grouped_count", "MATCH (f:File)-[:DEFINES]->(g:Function) RETURN f.name AS name, COUNT(g) AS n ORDER BY n DESC, f.name LIMIT 10", "SELECT f.name, count(*) AS n FROM edges e JOIN nodes f ON e.src = f.id WHERE e.type = 'DEFINES' GROUP BY f.name ORDER BY n DESC, f.name LIMIT 10")
cypher("b5_or_contains", "MATCH (f:Function) WHERE f.name CONTAINS 'Red' OR f.name CONTAINS 'gear' RETURN f.id AS id, f.name AS name", "SELECT id, name FROM nodes WHERE label = 'Function' AND (name ILIKE '%red%' OR name ILIKE '%gear%')")
cypher("b6_two_hop_join", "MATCH (f:File)-[:DEFINES]->(g:Function)-[:CALLS]->(t:Function) RETURN f.id AS f, COUNT(DISTINCT t) AS targets", "SELECT d.src AS f, count(DISTINCT c.dst) AS targets FROM edges d JOIN edges c ON c.src = d.dst AND c.type = 'CALLS' WHERE d.type = 'DEFINES' GROUP BY d.src")
cypher("b7_pattern_filter", "MATCH (n:Folder)-[:CONTAINS]->(f:File)-[:IMPORTS]->(m:Module) WHERE n.id = 'N3' RETURN f.id AS f, m.id AS m", "SELECT c.dst AS f, i.dst AS m FROM edges c JOIN edges i ON i.src = c.dst AND i.type = 'IMPORTS' WHERE c.type = 'CONTAINS' AND c.src = 'N3' AND c.dst LIKE 'C%'")
cypher("b8_in_subquery", "MATCH (g:Function) WHERE g.id IN (MATCH (f:File)-[:DEFINES]->(x:Function) WHERE f.name CONTAINS '00007' RETURN x.id) RETURN g.id AS id, g.name AS name", "SELECT id, name FROM nodes WHERE label = 'Function' AND id IN (SELECT e.dst FROM edges e JOIN nodes f ON f.id = e.src WHERE e.type = 'DEFINES' AND f.name LIKE '%00007%')")
cypher("d_edge_variable", "MATCH ()-[r]->() RETURN r.type AS type, COUNT(r) AS n", "SELECT type, count(*) AS n FROM edges GROUP BY type")
cypher("d_unlabelled", "MATCH (n) RETURN n.label AS label, COUNT(*) AS n", "SELECT label, count(*) AS n FROM nodes GROUP BY label")
cypher("d_backward", "MATCH (b:Function)<-[:DEFINES]-(f:File) WHERE f.id = 'C7' RETURN b.id AS b", "SELECT dst AS b FROM edges WHERE type = 'DEFINES' AND src = 'C7'")
cypher("d_exists", "MATCH (f:File) WHERE EXISTS((f)-[:IMPORTS]->(:Module)) AND NOT EXISTS((f)-[:DEFINES]->(:Function {id: 'P1'})) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM nodes f WHERE label = 'File' AND EXISTS (SELECT 1 FROM edges WHERE type = 'IMPORTS' AND src = f.id) AND NOT EXISTS (SELECT 1 FROM edges WHERE type = 'DEFINES' AND src = f.id AND dst = 'P1')")
cypher("d_exists_in_or", "MATCH (f:File) WHERE EXISTS((f)-[:DEFINES]->(:Function {id: 'P1'})) OR f.name CONTAINS '99' RETURN f.id AS id", "SELECT id FROM nodes f WHERE label = 'File' AND (EXISTS (SELECT 1 FROM edges WHERE type = 'DEFINES' AND src = f.id AND dst = 'P1') OR name LIKE '%99%')")
cypher(
    "d_optional_match", "MATCH (f:Function) OPTIONAL MATCH (f)-[:CALLS]->(c) WITH f, COUNT(c) AS outgoing OPTIONAL MATCH (x)-[:CALLS]->(f) RETURN f.id AS id, outgoing, COUNT(x) AS incoming, outgoing + COUNT(x) AS total",
    "SELECT f.id, (SELECT count(*) FROM edges WHERE type = 'CALLS' AND src = f.id) AS outgoing, (SELECT count(*) FROM edges WHERE type = 'CALLS' AND dst = f.id) AS incoming, (SELECT count(*) FROM edges WHERE type = 'CALLS' AND (src = f.id OR dst = f.id)) AS total FROM nodes f WHERE label = 'Function'",
)
cypher("d_having", "MATCH (a:Function)-[:CALLS]->(t:Function) WITH t, COUNT(a) AS n WHERE n > 25 RETURN t.id AS id, n", "SELECT dst AS id, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY dst HAVING count(*) > 25")
cypher("d_collect_aggregates", "MATCH (b:Class)-[:CONTAINS]->(f:Function) RETURN b.name AS name, COLLECT(f.name) AS names, AVG(f.size) AS mean, SUM(f.size) AS total, MIN(f.size) AS lo, MAX(f.size) AS hi", "SELECT b.name, list_sort(list(f.name)) AS names, avg(f.size) AS mean, CAST(sum(f.size) AS BIGINT) AS total, min(f.size) AS lo, max(f.size) AS hi FROM edges e JOIN nodes b ON b.id = e.src AND b.label = 'Class' JOIN nodes f ON f.id = e.dst WHERE e.type = 'CONTAINS' GROUP BY b.name")
cypher("d_parameters", "MATCH (f:Function)-[:CALLS]->(t:Function) WHERE f.id = $id AND t.size > 10 RETURN t.id AS id, t.size AS size", "SELECT t.id, t.size FROM edges e JOIN nodes t ON t.id = e.dst WHERE e.type = 'CALLS' AND e.src = 'P3' AND t.size > 10", params={"id": "P3"})
cypher(
    "d_shortest_path", "MATCH (s:Project {id: 'R1'}), (s)-[:CONTAINS*1..2]->(t:File) RETURN t.id AS id, LENGTH(shortestPath((s)-[:CONTAINS*]->(t))) AS hops",
    "SELECT c.dst AS id, 2 AS hops FROM edges n JOIN edges c ON c.src = n.dst AND c.type = 'CONTAINS' WHERE n.type = 'CONTAINS' AND n.src = 'R1' AND c.dst LIKE 'C%'",
)
cypher("d_skip_limit", 'MATCH (f:File) WHERE f.name STARTS WITH "Customer" RETURN f.id AS id ORDER BY f.ord DESC SKIP 5 LIMIT 7', "SELECT id FROM nodes WHERE label = 'File' ORDER BY ord DESC OFFSET 5 LIMIT 7")
cypher("d_inequality", "MATCH (a:Function)-[:CALLS]->(b:Function) WHERE a.name <> b.name AND a.size > b.size RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'CALLS' AND a.name <> b.name AND a.size > b.size")
cypher("d_whole_node", "MATCH (n:Folder) RETURN n", None)


# ---- the narrow dialect ------------------------------------------------------------------------------------
@query("SELECT name FROM nodes WHERE label = 'File' AND name ILIKE '%0001%' ORDER BY ord LIMIT 100", on_graph=True)
def legacy_where(spark, sf_dir):
    return run_legacy(graph(spark, sf_dir), "MATCH (f:File) WHERE f.name CONTAINS '0001' AND f.name = 'nothing' RETURN f.name").data


@query("SELECT count(*) AS \"COUNT(f)\" FROM nodes WHERE label = 'Function'", on_graph=True)
def legacy_count(spark, sf_dir):
    return run_legacy(graph(spark, sf_dir), "MATCH (f:Function) RETURN COUNT(f)").data


@query("SELECT list(name ORDER BY ord) AS \"COLLECT(f.name)\" FROM nodes WHERE label = 'Folder'", on_graph=True)
def legacy_collect(spark, sf_dir):
    return run_legacy(graph(spark, sf_dir), "MATCH (f:Folder) RETURN COLLECT(f.name)").data


@query("SELECT count(*) AS \"AVG(f.size)\" FROM nodes WHERE label = 'Function'", on_graph=True)
def legacy_avg_counts(spark, sf_dir):
    return run_legacy(graph(spark, sf_dir), "MATCH (f:Function) RETURN AVG(f.size)").data


@query("SELECT id FROM nodes WHERE false", on_graph=True)
def legacy_unparsable(spark, sf_dir):
    return run_legacy(graph(spark, sf_dir), "MATCH (n) RETURN n").data


@query("SELECT src AS a, dst AS b, CAST(1 AS INTEGER) AS pathLength FROM edges WHERE type = 'CONTAINS' AND src LIKE 'R%' ORDER BY 1, 2 LIMIT 100", on_graph=True)
def legacy_path(spark, sf_dir):
    return run_legacy(graph(spark, sf_dir), "MATCH (a:Project)-[:CONTAINS*1..2]->(b:Folder) RETURN a, b").data


# ---- filters and joins -------------------------------------------------------------------------------------
@query("SELECT id, name FROM nodes WHERE label IN ('File', 'Module') AND name ILIKE '%00012%' AND path ILIKE '%nation_1%'", on_graph=True)
def f_filter_nodes(spark, sf_dir):
    return match.filter_nodes(graph(spark, sf_dir), label_in=["File", "Module"], name_contains="00012", path_contains="Nation_1").select("id", "name")


@query("SELECT type, src, dst FROM edges WHERE type IN ('CALLS', 'DEFINES') AND src IN ('P1', 'C1')", on_graph=True)
def f_filter_edges(spark, sf_dir):
    return match.filter_edges(graph(spark, sf_dir), ["CALLS", "DEFINES"], ["P1", "C1"]).select("type", "src", "dst")


@query("SELECT id FROM nodes WHERE name ILIKE '%widget%'", on_graph=True)
def f_search(spark, sf_dir):
    return match.search(graph(spark, sf_dir), "WIDGET").select("id")


@query("SELECT type, src, dst, 'in' AS direction FROM edges WHERE dst = 'P5' UNION ALL SELECT type, src, dst, 'out' FROM edges WHERE src = 'P5'", on_graph=True)
def j_incident(spark, sf_dir):
    return match.incident(graph(spark, sf_dir), "P5").select("type", "src", "dst", "direction")


@query("SELECT label, count(*) AS n FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = n.id OR dst = n.id) GROUP BY label", on_graph=True)
def f_isolated(spark, sf_dir):
    return match.isolated(graph(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.dst AS id, min(e.src) AS file_id FROM edges e WHERE e.type = 'DEFINES' GROUP BY e.dst", on_graph=True)
def j_file_of(spark, sf_dir):
    return match.file_of(graph(spark, sf_dir))


@query("SELECT l.toxic AS toxic, d.lang AS lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def j_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source || '/' || doc_id AS path FROM documents WHERE contains(text, 'token') ORDER BY source || '/' || doc_id LIMIT 10")
def f_file_search(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return match.find_files(files, "token").select("doc_id", "path")


# ---- traversal ---------------------------------------------------------------------------------------------
@query("""SELECT id, label, CAST((SELECT count(*) FROM edges WHERE dst = n.id) AS BIGINT) AS "inDegree", CAST((SELECT count(*) FROM edges WHERE src = n.id) AS BIGINT) AS "outDegree",
CAST((SELECT count(*) FROM edges WHERE dst = n.id) + (SELECT count(*) FROM edges WHERE src = n.id) AS BIGINT) AS "totalDegree", CAST((SELECT count(*) FROM edges WHERE src = n.id AND type = 'CONTAINS') AS BIGINT) AS "childrenCount",
(SELECT count(*) FROM edges WHERE dst = n.id) = 0 AND (SELECT count(*) FROM edges WHERE src = n.id) > 0 AS "isRoot" FROM nodes n""", on_graph=True)
def p_degrees(spark, sf_dir):
    return traverse.degrees(graph(spark, sf_dir))


@query("""SELECT id, CAST(CASE label WHEN 'Folder' THEN 1 WHEN 'File' THEN 2 WHEN 'Module' THEN 2 WHEN 'Function' THEN 1 ELSE 0 END AS BIGINT) AS depth FROM nodes""", on_graph=True)
def p_containment_depth(spark, sf_dir):
    return traverse.containment_depth(graph(spark, sf_dir))


@query("""SELECT id FROM (SELECT 'P1' AS id UNION SELECT dst FROM edges WHERE type = 'CALLS' AND src = 'P1' UNION
SELECT b.dst FROM edges a JOIN edges b ON b.src = a.dst AND b.type = 'CALLS' WHERE a.type = 'CALLS' AND a.src = 'P1')""", on_graph=True)
def p_neighbours(spark, sf_dir):
    return traverse.neighbours(graph(spark, sf_dir), ["P1", "unknown"], 2, "out", ["CALLS"], limit=None).nodes.select("id")


@query("""SELECT type, src, dst FROM edges WHERE type = 'CALLS' AND (src = 'P2' OR dst = 'P2')""", on_graph=True)
def p_neighbour_edges(spark, sf_dir):
    return traverse.neighbours(graph(spark, sf_dir), ["P2"], 1, "both", ["CALLS"], limit=None).edges.select("type", "src", "dst")


@query(""", walk AS (SELECT 'R0' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node AND e.type IN ('CONTAINS', 'DEFINES') WHERE w.depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""", on_graph=True)
def p_distances(spark, sf_dir):
    g = graph(spark, sf_dir)
    return traverse.distances(g.edges, g.nodes.filter("id = 'R0'").select("id"), ["CONTAINS", "DEFINES"]).select("node", "depth")


@query("SELECT CAST(1 AS INTEGER) AS step, 'R0' AS src, 'N0' AS dst FROM nation WHERE false")
def p_no_path(spark, sf_dir):
    return traverse.shortest_path(graph(spark, sf_dir), "R0", "R1").select("step", "src", "dst")


@query("""SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, CAST(1 AS INTEGER) AS step FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 4)
UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 2 FROM customer WHERE c_custkey = 4""")
def p_shortest_path(spark, sf_dir):
    g = graph(spark, sf_dir)
    start = g.edges.filter("type = 'CONTAINS'").alias("a").join(g.edges.filter("type = 'CONTAINS' AND dst = 'C4'").select(F.col("src").alias("n")), F.col("a.dst") == F.col("n")).select("a.src").first()[0]
    return traverse.shortest_path(g, start, "C4", types=["CONTAINS"]).select("step", "src", "dst")


@query("SELECT type, count(*) AS n FROM edges WHERE src <> dst GROUP BY type", on_graph=True)
def p_real_links(spark, sf_dir):
    return traverse.real_links(graph(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, CAST(floor(least(35, greatest(4, 10 * greatest(0.7, 1.5 - d * 0.15) * CASE WHEN g > 0 THEN 1 + least(0.8, g * 0.1) ELSE 1 END * CASE WHEN c > 0 THEN 1 + least(0.6, c * 0.08) ELSE 1 END * CASE WHEN g > 10 THEN 1.3 ELSE 1 END * CASE WHEN r THEN 1.4 ELSE 1 END)) + 0.5) AS BIGINT) AS size FROM (
SELECT n.id, CAST(CASE label WHEN 'Folder' THEN 1 WHEN 'File' THEN 2 WHEN 'Module' THEN 2 WHEN 'Function' THEN 1 ELSE 0 END AS DOUBLE) AS d, CAST((SELECT count(*) FROM edges WHERE src = n.id OR dst = n.id) AS DOUBLE) AS g, CAST((SELECT count(*) FROM edges WHERE src = n.id AND type = 'CONTAINS') AS DOUBLE) AS c,
(SELECT count(*) FROM edges WHERE dst = n.id) = 0 AND (SELECT count(*) FROM edges WHERE src = n.id) > 0 AS r FROM nodes n)""", on_graph=True)
def p_importance(spark, sf_dir):
    g = graph(spark, sf_dir)
    both = traverse.degrees(g).join(traverse.containment_depth(g), "id")
    return both.select("id", traverse.importance(F.lit(10.0), F.col("depth"), F.col("totalDegree"), F.col("childrenCount"), F.col("isRoot")).alias("size"))


# ---- aggregations ------------------------------------------------------------------------------------------
@query("SELECT label, count(*) AS n FROM nodes GROUP BY label", on_graph=True)
def a_label_histogram(spark, sf_dir):
    return stats.label_histogram(graph(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM nodes) AS \"nodeCount\", (SELECT list_sort(list(DISTINCT label)) FROM nodes) AS labels, (SELECT count(*) FROM edges) AS \"edgeCount\", (SELECT list_sort(list(DISTINCT type)) FROM edges) AS types", on_graph=True)
def a_graph_stats(spark, sf_dir):
    return stats.graph_stats(graph(spark, sf_dir))


@query("""SELECT 'node' AS kind, label AS name, count(*) AS n, CASE WHEN label = 'Function' THEN 'name, size' WHEN label = 'Class' THEN 'name' ELSE 'name, path' END AS properties FROM nodes GROUP BY label
UNION ALL SELECT 'edge', type, count(*), '' FROM edges GROUP BY type""", on_graph=True)
def a_describe_schema(spark, sf_dir):
    return stats.describe_schema(graph(spark, sf_dir))


@query("""SELECT 'file without definitions' AS rule, id FROM nodes n WHERE label = 'File' AND NOT EXISTS (SELECT 1 FROM edges WHERE type = 'DEFINES' AND src = n.id)
UNION ALL SELECT 'definition without file', id FROM nodes n WHERE label IN ('Class', 'Function') AND NOT EXISTS (SELECT 1 FROM edges WHERE type IN ('DEFINES', 'CONTAINS') AND dst = n.id)""", on_graph=True)
def a_integrity(spark, sf_dir):
    return stats.integrity(graph(spark, sf_dir))


@query("SELECT id, path, '.' || lower(list_extract(string_split(path, '/'), -1)) AS extension, EXISTS (SELECT 1 FROM edges WHERE type = 'DEFINES' AND src = n.id) AS \"hasDefinitions\", CAST(NULL AS VARCHAR) AS reason FROM nodes n WHERE label = 'File'", on_graph=True)
def a_analyse_files(spark, sf_dir):
    return stats.analyse_files(graph(spark, sf_dir))


@query()
def a_summary_text(spark, sf_dir):
    return stats.summary(graph(spark, sf_dir))


@query("SELECT rule, id FROM (SELECT '' AS rule, '' AS id) WHERE false")
def n_violations(spark, sf_dir):
    return stats.violations(graph(spark, sf_dir))


# ---- metrics: events as series -----------------------------------------------------------------------------
def points(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "ts", "value", "event_id")


@query("SELECT event_type AS name, count(value) AS \"count\", round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, last(value ORDER BY ts, event_id) AS last FROM events GROUP BY event_type")
def a_metric_summary(spark, sf_dir):
    return metrics.summary(points(spark, sf_dir), "event_id").withColumn("avg", F.round("avg", 6))


@query("SELECT event_type AS name, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def a_metric_sum(spark, sf_dir):
    return metrics.aggregate(points(spark, sf_dir), "sum").withColumn("value", F.round("value", 4))


@query("SELECT CAST(0 AS DOUBLE) AS value")
def a_metric_empty(spark, sf_dir):
    return metrics.aggregate_one(points(spark, sf_dir), "no such series", "avg")


@query("SELECT event_id, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50")
def w_keep_last(spark, sf_dir):
    return metrics.keep_last(points(spark, sf_dir), "name", 50, ["ts", "event_id"]).select("event_id", "name")


@query("""SELECT name, CASE WHEN n < 4 THEN 'stable' WHEN (older - recent) / older > 0.1 THEN 'improving' WHEN (older - recent) / older < -0.1 THEN 'degrading' ELSE 'stable' END AS trend FROM (
SELECT event_type AS name, count(*) AS n, avg(value) FILTER (WHERE k <= 3) AS recent, avg(value) FILTER (WHERE k > 3) AS older FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6 GROUP BY event_type)""")
def w_trend(spark, sf_dir):
    return metrics.trend(points(spark, sf_dir), "name", "value", ["ts", "event_id"])


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-7, 1) AS \"runningMean\" FROM events")
def w_running_mean(spark, sf_dir):
    return metrics.running_mean(points(spark, sf_dir), "name", "value", ["ts", "event_id"]).select("event_id", F.round(F.col("runningMean") + 1e-7, 1).alias("runningMean"))


@query("SELECT event_type AS operation, count(*) AS total, count(*) FILTER (WHERE value >= 10) AS succeeded, count(*) FILTER (WHERE NOT value >= 10) AS failed, round(avg(value), 6) AS average, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def a_operation_report(spark, sf_dir):
    ops = points(spark, sf_dir).select(F.col("name").alias("operation"), F.col("value").alias("duration"), (F.col("value") >= 10).alias("success"), F.col("ts").alias("timestamp"))
    return metrics.operation_report(ops).withColumn("average", F.round("average", 6))


@query("SELECT count(value) AS \"count\", round(sum(value), 3) AS sum, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max FROM events")
def a_basic_statistics(spark, sf_dir):
    return metrics.basic_statistics(table(spark, sf_dir, "events"), "value").withColumns({"sum": F.round("sum", 3), "mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def a_frequency(spark, sf_dir):
    return metrics.frequency(table(spark, sf_dir, "documents"), "lang")


@query("SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND value > 50")
def r_breaches(spark, sf_dir):
    p = points(spark, sf_dir)
    return metrics.breaches(p, p.agg(F.min("name")).first()[0], "gt", 50.0).select("event_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r_tumbling(spark, sf_dir):
    from ..streaming.metrics import tumbling

    return tumbling(points(spark, sf_dir), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r_tumbling_stream(spark, sf_dir):
    """The same from a stream over the table's file, drained."""
    import uuid

    from ..streaming.lines import drain
    from ..streaming.metrics import read_stream, tumbling
    from ..tables import cut

    cut(spark.range(1), "mark")  # the shared folder is there
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    events = table(spark, sf_dir, "events")
    stream = read_stream(spark, sf_dir, events.schema.simpleString()[7:-1].replace(":", " "), "events.parquet").select(F.col("event_type").alias("name"), "ts", "value")
    stream = stream.groupBy(F.window("ts", "1 hour").alias("w"), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "name", "n", "total")
    name = f"t{uuid.uuid4().hex}"
    return drain(stream, name, f"{folder}/{name}", "complete").withColumn("total", F.round("total", 4))


# ---- sessions: conversations -------------------------------------------------------------------------------
def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content"))


@query("SELECT conv_id AS session, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS queries, CAST(min(turn) AS BIGINT) AS first, CAST(max(turn) AS BIGINT) AS last FROM conversations GROUP BY conv_id")
def a_session_stats(spark, sf_dir):
    m = messages(spark, sf_dir).select("session", F.col("turn").cast("long").alias("timestamp"), F.when(F.col("role") == "user", F.col("content")).alias("query"), F.lit(None).cast("double").alias("executionTime"))
    return metrics.session_stats(m).drop("averageResponse")


@query("SELECT conv_id AS session, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 20")
def n_search_messages(spark, sf_dir):
    return metrics.search_messages(messages(spark, sf_dir), "THE").select("session", "turn")


@query("SELECT session, turn FROM (SELECT conv_id AS session, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE contains(lower(text), 'a')) WHERE k <= 2")
def n_search_each_session(spark, sf_dir):
    return metrics.search_messages(messages(spark, sf_dir), "a", each=2).select("session", "turn")


# ---- text --------------------------------------------------------------------------------------------------
STOPS = ", ".join(f"'{w}'" for w in T.STOP)
TOKENS = rf"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-zA-Z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains([{STOPS}], w))"


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n, CAST(len(list_distinct({TOKENS})) AS INTEGER) AS kinds FROM documents")
def t_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("kinds"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(length(text) AS INTEGER) AS chars FROM documents")
def t_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.line_count(F.col("text")).alias("lines"), F.length("text").alias("chars"))


@query(rf"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[?!.]', '', 'g'), '\b({'|'.join(T.ASKING)})\b', '', 'g'), '\s+', ' ', 'g')) AS question FROM benchmark")
def t_question(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.question(F.col("text")).alias("question"))


@query(r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\b[a-zA-Z_][a-zA-Z0-9_]*\b'))) AS names FROM documents")
def t_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.identifiers(F.col("text"))).alias("names"))


@query("SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS links FROM pages")
def t_page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("links"))


@query("""SELECT doc_id, p AS path, list_extract(string_split(p, '/'), -1) AS name, regexp_extract(p, '(\\.[^.]*)$', 1) AS ext, regexp_replace(p, '/?[^/]*$', '') AS parent FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.ts' AS p FROM documents)""")
def t_paths(spark, sf_dir):
    p = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".ts"))
    d = table(spark, sf_dir, "documents").select("doc_id", p.alias("path"))
    c = F.col("path")
    return d.select("doc_id", "path", P.basename(c).alias("name"), P.extname(c).alias("ext"), P.parent(c).alias("parent"))


# DuckDB's levenshtein counts bytes, so the table of distances is filled by diagonals k here, in code points: v[i + 1] is the distance of
# the first i letters of x from the first k - i of y, u the diagonal before.
@query("""WITH RECURSIVE c AS (SELECT item_id, text, list_transform(range(1, length(text) + 1), lambda i: unicode(substring(text, i, 1))) AS codes FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, a.codes AS x, b.codes AS y, greatest(length(a.text), length(b.text)) AS longest FROM c a JOIN c b ON a.item_id + 1 = b.item_id),
w AS (SELECT a, b, 0 AS k, list_transform(range(0, len(x) + 1), lambda i: 1000000) AS u, list_transform(range(0, len(x) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1000000 END) AS v FROM p
UNION ALL SELECT w.a, w.b, w.k + 1, w.v, list_transform(range(0, len(x) + 1), lambda i: CASE WHEN i > w.k + 1 OR w.k + 1 - i > len(y) THEN 1000000
ELSE least(w.v[i + 1] + 1, coalesce(w.v[i], 1000000) + 1, coalesce(w.u[i] + CASE WHEN x[i] = y[w.k + 1 - i] THEN 0 ELSE 1 END, 1000000)) END)
FROM w JOIN p ON w.a = p.a AND w.b = p.b WHERE w.k < len(x) + len(y))
SELECT p.a, p.b, CAST(v[len(x) + 1] AS INTEGER) AS d, CASE WHEN longest = 0 THEN 1 ELSE round(1 - v[len(x) + 1] / CAST(longest AS DOUBLE), 6) END AS s FROM p LEFT JOIN w ON w.a = p.a AND w.b = p.b AND w.k = len(x) + len(y)""")
def t_levenshtein(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("y")), F.expr("a + 1 = b"))
    return pairs.select("a", "b", F.levenshtein("x", "y").alias("d"), F.round(T.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("s"))


@query(f"""WITH t AS (SELECT item_id, list_distinct({TOKENS}) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE), 6) AS j FROM t a JOIN t b ON a.item_id + 1 = b.item_id""")
def t_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("y")), F.expr("a + 1 = b"))
    return pairs.select("a", "b", F.round(T.token_jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@query()
def n_similar_benchmark(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return similarity.similar(b.filter("item_id % 10 = 0").select(F.col("item_id").alias("q"), F.col("text").alias("q_text")), b.select(F.col("item_id").alias("c"), F.col("text").alias("c_text")))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""")
def t_vector_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), F.expr("a + 1 = b"))
    return pairs.select("a", "b", F.round(similarity.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))
