"""Further registered queries: sources and sinks, structure, paths, code, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code
from ..functions import paths as P
from ..functions import text as T
from ..ingestion import structure
from ..operators import match, metrics, similarity, stats
from ..sources import graphs
from ..streaming import metrics as streams
from .registry import graph, query, table

s = F.lit


def _text(c):
    return F.col(c).cast("string")


# ---- sources and sinks -------------------------------------------------------------------------------------
@query("SELECT id || ',' || name || ',,,,,,,' || label AS line FROM nodes WHERE NOT contains(name, ',')", on_graph=True)
def s_csv_nodes(spark, sf_dir):
    return graphs.node_csv(graph(spark, sf_dir)).select("line")


@query("SELECT src || ',' || type || ',' || dst || ',' || src || ',' || dst AS line FROM edges", on_graph=True)
def s_csv_edges(spark, sf_dir):
    return graphs.edge_csv(graph(spark, sf_dir)).select("line")


@query("SELECT type, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY type || '|' || src || '|' || dst) AS k FROM edges) WHERE k <= 25", on_graph=True)
def s_sample_edges(spark, sf_dir):
    return match.sample_graph(graph(spark, sf_dir), 100).edges.select("type", "src", "dst")


@query("SELECT id, label, name FROM nodes ORDER BY ord, id LIMIT 100", on_graph=True)
def s_sample_nodes(spark, sf_dir):
    return match.sample_graph(graph(spark, sf_dir), 100).nodes.select("id", "label", "name")


@query("SELECT e.type, e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'CONTAINS' AND a.label IN ('Folder', 'File') AND b.label IN ('Folder', 'File') AND regexp_matches(a.path, '(?i)asia.*') AND regexp_matches(b.path, '(?i)asia.*')", on_graph=True)
def s_filtered_export(spark, sf_dir):
    return graphs.filtered(graph(spark, sf_dir), ["Folder", "File"], ["asia*"], types=["CONTAINS"]).edges.select("type", "src", "dst")


@query("SELECT type, count(*) AS n FROM edges WHERE src NOT LIKE 'C%' AND dst NOT LIKE 'C%' GROUP BY type", on_graph=True)
def s_delete_nodes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return graphs.without(g, g.nodes.filter("label = 'File'")).edges.groupBy("type").agg(F.count(s(1)).alias("n"))


@query("SELECT level, message FROM (SELECT 'error' AS level, '' AS message) WHERE false")
def s_validate_export(spark, sf_dir):
    return graphs.validate_export(graph(spark, sf_dir), most_bytes=1 << 50).select("level", "message")


@query("SELECT id FROM nodes WHERE label = 'File' AND starts_with(path, 'ASIA/')", on_graph=True)
def j_folder_children(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes.filter("label = 'File'").withColumn("depth", F.size(F.split("path", "/")))
    return match.folder_children(nodes, "ASIA", 1).select("id")


@query("SELECT id FROM nodes WHERE label IN ('Folder', 'File', 'Project', 'Module', 'Class', 'Function') ORDER BY ord, id LIMIT 30 OFFSET 10", on_graph=True)
def l_page(spark, sf_dir):
    return match.page(graph(spark, sf_dir).nodes, 30, 10).select("id")


@query("SELECT id FROM nodes WHERE id IN ('P1', 'P2', 'C1') UNION ALL SELECT type || src || dst FROM edges WHERE src IN ('P1', 'P2', 'C1') AND dst IN ('P1', 'P2', 'C1')", on_graph=True)
def p_subgraph(spark, sf_dir):
    g = graph(spark, sf_dir)
    sub = match.subgraph(g, g.nodes.filter(F.col("id").isin("P1", "P2", "C1")))
    return sub.nodes.select("id").unionByName(sub.edges.select(F.concat("type", "src", "dst").alias("id")))


# ---- structure and paths -----------------------------------------------------------------------------------
def _paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(_text("doc_id"), s(".ts"))).alias("path"))


@query("""SELECT 'Project' AS label, 1 AS n, 0 AS depth UNION ALL SELECT 'Folder', count(DISTINCT source), 1 FROM documents UNION ALL SELECT 'Folder', count(DISTINCT source || lang), 2 FROM documents
UNION ALL SELECT 'File', count(*), 3 FROM documents""")
def i_structure_nodes(spark, sf_dir):
    return structure.build(_paths(spark, sf_dir), "p")[0].groupBy("label", "depth").agg(F.count(s(1)).cast("int").alias("n"))


@query("SELECT count(*) + count(DISTINCT source || lang) + count(DISTINCT source) AS n, count(DISTINCT source || lang) + count(DISTINCT source) + 1 AS parents FROM documents")
def i_structure_edges(spark, sf_dir):
    return structure.build(_paths(spark, sf_dir), "p")[1].agg(F.count(s(1)).alias("n"), F.count_distinct("src").alias("parents"))


@query("SELECT DISTINCT source AS path FROM documents UNION SELECT source || '/' || lang FROM documents")
def u_implied_folders(spark, sf_dir):
    return structure.all_paths(_paths(spark, sf_dir)).filter("is_folder").select("path")


ODD = ["src/node_modules/x.js", ".github/w.yml", "a/.env/k", "a/x.egg-info/y", "lib/site-packages/z.py", "src/app/main.py", "docs/README.md", "src/environment.ts"]
ODD_SQL = "list_extract([" + ", ".join(f"'{p}'" for p in ODD) + f"], CAST(doc_id % {len(ODD)} + 1 AS BIGINT))"


def _odd():
    return F.element_at(F.array(*[s(p) for p in ODD]), (F.col("doc_id") % len(ODD) + 1).cast("int"))


@query(f"SELECT doc_id, {ODD_SQL} AS path, doc_id % 8 IN (0, 2, 3, 4) AS hidden FROM documents")
def f_hidden(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _odd().alias("path")).withColumn("hidden", P.hidden(F.col("path")))


@query("SELECT doc_id, trim(text) <> '' AND doc_id % 8 IN (1, 3, 4, 5, 7) AS strict, trim(text) <> '' AND doc_id % 8 IN (3, 4, 5, 6) AS loose FROM documents")
def f_parse_eligible(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", _odd().alias("path"))
    return d.select("doc_id", P.parse_eligible(F.col("path"), F.col("text")).alias("strict"), P.parse_eligible(F.col("path"), F.col("text"), loose=True).alias("loose"))


@query("SELECT doc_id, doc_id % 8 IN (0, 4, 5, 7) AS source, doc_id % 8 = 9 AS config, CASE doc_id % 8 WHEN 0 THEN 'javascript' WHEN 4 THEN 'python' WHEN 5 THEN 'python' WHEN 7 THEN 'typescript' ELSE 'generic' END AS language FROM documents")
def f_file_kinds(spark, sf_dir):
    c = _odd()
    return table(spark, sf_dir, "documents").select("doc_id", P.is_source(c).alias("source"), P.is_config(c).alias("config"), P.language(c).alias("language"))


@query("""SELECT a.doc_id, CASE WHEN a.source <> b.source THEN 3 WHEN a.lang <> b.lang THEN 2 ELSE 1 END AS distance, a.source = b.source AND a.lang = b.lang AS siblings FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20""")
def t_path_distance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", _text("doc_id")).alias("p"))
    both = d.join(d.select((F.col("doc_id") - 20).alias("doc_id"), F.col("p").alias("q")), "doc_id")
    return both.select("doc_id", P.distance(F.col("p"), F.col("q")).alias("distance"), P.siblings(F.col("p"), F.col("q")).alias("siblings"))


@query("SELECT doc_id, source || '/x/' || doc_id AS up, source || '/' || lang || '/y' AS here FROM documents")
def t_resolve(spark, sf_dir):
    folder = F.concat_ws("/", "source", "lang")
    return table(spark, sf_dir, "documents").select("doc_id", P.resolve(folder, F.concat(s("../x/"), _text("doc_id"))).alias("up"), P.resolve(folder, s("./y")).alias("here"))


# ---- text and code -----------------------------------------------------------------------------------------
def _queries(spark, sf_dir):
    q = F.concat(s("MATCH (c {id: '"), _text("c_custkey"), s("'})  WHERE c.name = '"), F.col("c_name"), s("' RETURN c LIMIT "), _text("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", q.alias("query"))


@query("SELECT c_custkey, 'MATCH (c {...}) WHERE c.name = ''...'' RETURN c LIMIT N' AS pattern, 'MATCH (c {id: ?}) WHERE c.name = ? RETURN c LIMIT ?' AS shape, 'Basic node/relationship matching query' AS description FROM customer")
def t_query_patterns(spark, sf_dir):
    q = F.col("query")
    return _queries(spark, sf_dir).select("c_custkey", T.query_pattern(q).alias("pattern"), T.query_shape(q).alias("shape"), T.pattern_description(T.query_pattern(q)).alias("description"))


@query("""SELECT c_custkey, kind, severity, message FROM customer, (VALUES ('performance', 'high', 'over one second', 1), ('accuracy', 'medium', 'no results', 2)) v(kind, severity, message, k)
WHERE (k = 1 AND c_acctbal > 1000) OR (k = 2 AND c_nationkey = 0)""")
def n_suggestions(spark, sf_dir):
    log = _queries(spark, sf_dir).select(F.concat(F.col("query"), s("#"), _text("c_custkey")).alias("query"), F.col("c_acctbal").alias("executionTime"), F.col("c_nationkey").alias("resultCount"))
    out = similarity.suggestions(log)
    return out.select(F.element_at(F.split("query", "#"), -1).cast("long").alias("c_custkey"), "kind", "severity", "message")


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN '0 Bytes' WHEN n_chars < 1024 THEN n_chars || ' Bytes' ELSE regexp_replace(format('{:.2f}', round(n_chars / unit, 2)), '\\.?0+$', '') || name END AS size
FROM (SELECT doc_id, n_chars, CASE WHEN n_chars >= 1073741824 THEN 1073741824.0 WHEN n_chars >= 1048576 THEN 1048576.0 ELSE 1024.0 END AS unit, CASE WHEN n_chars >= 1073741824 THEN ' GB' WHEN n_chars >= 1048576 THEN ' MB' ELSE ' KB' END AS name FROM documents)""")
def t_human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(F.col("n_chars")).alias("size"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def t_csv_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_quote(F.col("text")).alias("field"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def t_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def _sources(spark, sf_dir):
    content = F.concat(s("import x from 'm"), _text("c_custkey"), s("';\nconst a = require('r"), _text("c_nationkey"), s("');\nfunction go(p) {\n  if (p) { run(call(p)); }\n}\nclass K {}\n// end"))
    return table(spark, sf_dir, "customer").select(_text("c_custkey").alias("path"), content.alias("content"))


def _files(spark, sf_dir):
    """Every document, and a small script with each customer's keys in it, as files."""
    docs = table(spark, sf_dir, "documents").select(F.concat(s("d"), _text("doc_id")).alias("path"), F.col("text").alias("content"))
    script = F.concat(s("﻿ import {a} from `m"), _text("c_custkey"), s("`;\nimport 'side';\nconst a = require('r"), _text("c_nationkey"), s("');\n\tfunction go (p) { // {\n  if (p) { run\n(call(p)) || x ? y : z; }\n}}\nfrom x import y\nclass K {}\n * text\nexport let b=await import ( \"d\" )"))
    return docs.unionByName(table(spark, sf_dir, "customer").select(_text("c_custkey").alias("path"), script.alias("content")))


_WS = r"[\t-\r \p{Z}\x{FEFF}]"
_FILES = rf"""WITH f AS (SELECT 'd' || doc_id AS path, text AS content FROM documents UNION ALL SELECT CAST(c_custkey AS VARCHAR), array_to_string([
  chr(65279) || ' import {{a}} from `m' || c_custkey || '`;', 'import ''side'';', 'const a = require(' || chr(39) || 'r' || c_nationkey || chr(39) || ');', chr(9) || 'function go (p) {{ // {{', '  if (p) {{ run',
  '(call(p)) || x ? y : z; }}', '}}}}', 'from x import y', 'class K {{}}', ' * text', 'export let b=await import ( "d" )'], chr(10)) FROM customer),
l AS (SELECT path, unnest(range(len(string_split(content, chr(10))))) + 1 AS line, unnest(string_split(content, chr(10))) AS raw FROM f WHERE content IS NOT NULL),
t AS (SELECT path, line, raw, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS content FROM l)"""


@query(_FILES + rf""", k AS (SELECT path, line, content, unnest([
 {{'kind': 'import', 'module': regexp_extract(content, 'import{_WS}+(?:(?:\{{[^}}]*\}}|\*{_WS}+as{_WS}+\w+|\w+){_WS}+from{_WS}+)?[''"`]([^''"`]+)[''"`]', 1)}},
 {{'kind': 'require', 'module': regexp_extract(content, 'require{_WS}*\({_WS}*[''"`]([^''"`]+)[''"`]{_WS}*\)', 1)}},
 {{'kind': 'dynamic', 'module': regexp_extract(content, 'import{_WS}*\({_WS}*[''"`]([^''"`]+)[''"`]{_WS}*\)', 1)}}]) AS m FROM t)
SELECT path, line, m.kind AS kind, m.module AS module, content FROM k WHERE m.module <> ''""")
def t_dependencies(spark, sf_dir):
    return code.dependencies(_files(spark, sf_dir))


@query(_FILES + rf""" SELECT path, line, 'import' AS kind, content FROM t WHERE starts_with(content, 'import ') OR starts_with(content, 'from ')
UNION ALL SELECT path, line, 'export', content FROM t WHERE starts_with(content, 'export ')
UNION ALL SELECT path, line, 'function', content FROM t WHERE regexp_matches(content, '^(function|const|let|var){_WS}+\w+{_WS}*[=(]')
UNION ALL SELECT path, line, 'class', content FROM t WHERE regexp_matches(content, '^class{_WS}+\w+')
UNION ALL SELECT path, line, 'variable', content FROM t WHERE regexp_matches(content, '^(const|let|var){_WS}+\w+{_WS}*=')""")
def t_structure(spark, sf_dir):
    return code.structure(_files(spark, sf_dir))


@query(_FILES + rf""", c AS (SELECT path, unnest(regexp_extract_all(content, '(\w+){_WS}*\(', 1)) AS name FROM f)
SELECT path, name, count(*) AS n FROM c WHERE name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'typeof', 'instanceof') GROUP BY ALL""")
def t_calls(spark, sf_dir):
    return code.calls(_files(spark, sf_dir)).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, line, name FROM customer, (VALUES (3, 'require'), (4, 'go'), (5, 'run'), (6, 'call'), (11, 'import')) v(line, name)")
def t_call_lines(spark, sf_dir):
    return code.calls(_files(spark, sf_dir)).filter(~F.col("path").startswith("d")).select("path", "line", "name")


@query(_FILES + rf""", b AS (SELECT path, string_split(coalesce(content, ''), chr(10)) AS rows FROM f),
o AS (SELECT *, list_reduce(list_prepend(0, list_transform(rows, lambda x: CAST(contains(x, '{{') AS INT) + 2 * CAST(contains(x, '}}') AS INT))),
 lambda a, x: greatest(a // 100000, a % 100000 + x % 2) * 100000 + CASE WHEN x >= 2 THEN greatest(0, a % 100000 + x % 2 - 1) ELSE a % 100000 + x % 2 END) AS deep,
 list_transform(rows, lambda x: length(x) + length(regexp_replace(x, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))) AS lengths FROM b)
SELECT path, CAST(list_sum(list_transform(['if', 'else', 'for', 'while', 'case', 'catch', '&&', '||', '?'], lambda k: len(list_filter(rows, lambda x: contains(x, k))))) AS INT) AS branches, CAST(deep // 100000 AS INT) AS "maxNesting",
 round(len(list_filter(rows, lambda x: regexp_matches(x, '^{_WS}*(//|/\*|\*)'))) / CAST(len(rows) AS DOUBLE), 6) AS "commentRatio",
 CAST(list_max(lengths) AS INT) AS "maxLine", round(list_sum(lengths) / CAST(len(rows) AS DOUBLE), 6) AS "meanLine" FROM o""")
def t_complexity(spark, sf_dir):
    return code.complexity(_files(spark, sf_dir)).select("path", "branches", "maxNesting", F.round("commentRatio", 6).alias("commentRatio"), "maxLine", F.round("meanLine", 6).alias("meanLine"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, 'function go(p) {' AS match, CAST(length('import x from ''m' || c_custkey || ''';') + length('const a = require(''r' || c_nationkey || ''');') + 2 AS BIGINT) AS index FROM customer")
def t_find_patterns(spark, sf_dir):
    return code.find_patterns(_sources(spark, sf_dir), {"f": r"function (\w+)\(p\) \{"}).select("path", "match", "index")


# ---- logs and series ---------------------------------------------------------------------------------------
@query("SELECT count(*) AS total, count(DISTINCT p_brand) AS files, count(DISTINCT p_name) AS names FROM part")
def a_registry_stats(spark, sf_dir):
    return stats.registry_stats(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("filePath")))


@query("SELECT p_brand AS \"filePath\", p_type AS type, count(*) AS n FROM part GROUP BY ALL")
def a_definitions_by_file(spark, sf_dir):
    return stats.definitions_by_file(table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("filePath")))


@query("SELECT l_returnflag AS \"callType\", CASE WHEN l_linestatus = 'O' THEN 'failed' ELSE l_linestatus END AS \"resolutionStage\", count(*) AS n FROM lineitem GROUP BY ALL")
def a_call_stats(spark, sf_dir):
    return stats.call_stats(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("callType"), F.nullif("l_linestatus", s("O")).alias("resolutionStage")))


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("value").alias("executionTime"), (F.col("value") >= 10).alias("success"), (F.col("ts").cast("timestamp").cast("double") * 1000 + F.col("event_id") / 1e6).alias("timestamp"), (F.col("event_id") % 3).alias("resultCount"))


@query("""SELECT count(*) AS "totalExecutions", round(avg(value) FILTER (WHERE value >= 10), 6) AS "averageExecutionTime", round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0 END), 6) AS "successRate"
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50 GROUP BY event_type""")
def a_query_performance(spark, sf_dir):
    out = metrics.query_performance(_log(spark, sf_dir))
    return out.select("totalExecutions", F.round("averageExecutionTime", 6).alias("averageExecutionTime"), F.round("successRate", 6).alias("successRate"))


@query("""SELECT event_type AS pattern, count(*) AS "usageCount", round(avg(value), 6) AS "averageExecutionTime", round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0 END), 6) AS "successRate" FROM events GROUP BY event_type""")
def r_learn_patterns(spark, sf_dir):
    return metrics.learn_patterns(_log(spark, sf_dir)).select("pattern", "usageCount", F.round("averageExecutionTime", 6).alias("averageExecutionTime"), F.round("successRate", 6).alias("successRate"))


@query("""SELECT event_type AS pattern, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0 END) * (1000 / greatest(avg(value), 1)), 4) AS score FROM events GROUP BY event_type HAVING count(*) >= 3 ORDER BY score DESC LIMIT 3""")
def l_best_patterns(spark, sf_dir):
    return metrics.best_patterns(metrics.learn_patterns(_log(spark, sf_dir)), 3).select("pattern", F.round("score", 4).alias("score"))


@query("""SELECT count(*) AS "totalQueries", count(*) FILTER (WHERE value >= 10) AS "successfulQueries", round(avg(value) FILTER (WHERE value >= 10), 6) AS "averageExecutionTime" FROM events""")
def a_cache_stats(spark, sf_dir):
    return metrics.cache_stats(_log(spark, sf_dir).withColumn("confidence", s(1.0))).select("totalQueries", "successfulQueries", F.round("averageExecutionTime", 6).alias("averageExecutionTime"))


@query("""SELECT engine, round(a, 6) AS average, round(max(a) OVER () / a, 6) AS ratio FROM (SELECT event_type AS engine, avg(value) AS a FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10 GROUP BY event_type)""")
def a_engine_comparison(spark, sf_dir):
    runs = _log(spark, sf_dir).select(F.col("query").alias("engine"), F.col("executionTime").alias("duration"), "timestamp")
    return metrics.engine_comparison(runs).select("engine", F.round("average", 6).alias("average"), F.round("ratio", 6).alias("ratio"))


@query("SELECT event_id, 'gt' AS condition, CAST(90 AS DOUBLE) AS threshold FROM events WHERE event_type = 'click' AND value > 90 UNION ALL SELECT event_id, 'lte', 1.0 FROM events WHERE event_type = 'view' AND value <= 1")
def r_alerts(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), "value")
    return streams.alerts(p, [("click", "gt", 90.0), ("view", "lte", 1.0)]).select("event_id", "condition", "threshold")


@query("""SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 1 DAY""")
def f_time_range(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), "ts", "value")
    first = p.agg(F.min("ts"), F.min("name")).first()
    import datetime

    return metrics.in_range(p, first[0], first[0] + datetime.timedelta(days=1), first[1]).select("event_id")


@query("SELECT DISTINCT source, lang FROM documents")
def u_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
