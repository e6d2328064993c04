"""Queries: joins, aggregates, windows, traversals, algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import algorithms as G
from ..operators import context as C
from ..operators import lookup as L
from ..operators import traverse as V
from ..schema import Graph
from ..sources import tables as T
from .registry import query

CALLS = "('calls','references','imports')"


def graph(spark, sf, *kinds):
    """The graph with edges of the given kinds only, so that no other table is read."""
    g = T.graph(spark, sf)
    return g.with_edges(T.edges(spark, sf, kinds)) if kinds else g


def reach(name, start, step, most, kinds, where=""):
    """A recursive table (id, depth) of what can be reached; step is out or in."""
    a, b = ("source", "target") if step == "out" else ("target", "source")
    k = f" AND e.kind IN ({','.join(repr(x) for x in kinds)})" if kinds else ""
    return f"{name}(id, depth) AS (SELECT '{start}', 0 UNION SELECT e.{b}, r.depth+1 FROM {name} r JOIN edges e ON e.{a}=r.id{k}{where} WHERE r.depth<{most})"


# -- joins and aggregates -----------------------------------------------------


@query("j1_edges_with_nodes", "SELECT e.source, e.target, s.kind AS source_kind, t.kind AS target_kind, t.name AS target_name FROM edges e JOIN nodes s ON s.id=e.source JOIN nodes t ON t.id=e.target WHERE e.kind='references'")
def _(spark, sf):
    g = graph(spark, sf, "references")
    s, t = g.nodes.select(F.col("id").alias("source"), F.col("kind").alias("source_kind")), g.nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), F.col("name").alias("target_name"))
    return g.edges.select("source", "target").join(s, "source").join(t, "target")


@query("j3_same_file_edges", "SELECT a.file_path, count(*) AS n FROM edges e JOIN nodes a ON a.id=e.source JOIN nodes b ON b.id=e.target AND a.file_path=b.file_path GROUP BY 1")
def _(spark, sf):
    return A.edge_files(graph(spark, sf), without=()).filter("source_file = target_file").groupBy(F.col("source_file").alias("file_path")).agg(F.count(F.lit(1)).alias("n"))


@query("j5_g13_file_pairs", "SELECT * FROM pairs")
def _(spark, sf):
    return A.file_pairs(graph(spark, sf))


@query("g13_file_dependencies", "SELECT target_file AS path FROM pairs WHERE source_file='parts/brand#11/small'")
def _(spark, sf):
    return A.file_dependencies(graph(spark, sf), "parts/brand#11/small")


@query("g13_file_dependents", "SELECT source_file AS path FROM pairs WHERE target_file='asia/nation_12/suppliers'")
def _(spark, sf):
    return A.file_dependents(graph(spark, sf), "asia/nation_12/suppliers")


@query("j6_incoming_across", "SELECT e.source, e.target, e.kind, b.name AS target_name, a.file_path AS source_file FROM edges e JOIN nodes a ON a.id=e.source JOIN nodes b ON b.id=e.target WHERE b.file_path IN ('asia/nation_12/suppliers','asia/nation_2/suppliers') AND a.file_path<>b.file_path")
def _(spark, sf):
    return A.incoming_across(graph(spark, sf), ["asia/nation_12/suppliers", "asia/nation_2/suppliers"]).select("source", "target", "kind", "target_name", "source_file")


def _imports(spark, sf):
    p = T.read(spark, sf, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("file_path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("name"))
    n = p.distinct().select(F.concat_ws(":", F.lit("import"), "file_path", "name").alias("id"), F.lit("import").alias("kind"), "name", "file_path", F.lit("html").alias("language"))
    from ..schema import EDGES, NODES, conform

    return Graph(conform(n, NODES), conform(spark.createDataFrame([], "source string"), EDGES))


_LINKS = "links AS (SELECT DISTINCT 'page'||page_id AS path, unnest(regexp_extract_all(html,'href=\"([^\"]*)\"',1)) AS name FROM pages)"


@query("j7_i12_co_importers", f"{_LINKS} SELECT DISTINCT path FROM links WHERE path NOT IN ('page0','page1','page2') AND name IN (SELECT name FROM links WHERE path IN ('page0','page1','page2'))")
def _(spark, sf):
    return A.co_importers(_imports(spark, sf), ["page0", "page1", "page2"])


@query("j8_g16_induced_edges", "keep AS (SELECT id FROM nodes WHERE kind='method') SELECT source, target, kind FROM edges WHERE kind='extends' AND source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep)")
def _(spark, sf):
    g = graph(spark, sf)
    return L.induced(g, L.of_kind(g, "method"), ("extends",)).select("source", "target", "kind")


@query("j9_g15_dead_code", "SELECT id, name, kind FROM nodes WHERE kind IN ('function','method','class') AND NOT is_exported AND id NOT IN (SELECT target FROM edges WHERE kind<>'contains')")
def _(spark, sf):
    return A.dead_code(graph(spark, sf)).select("id", "name", "kind")


@query("a1_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM files) AS files")
def _(spark, sf):
    return A.stats(graph(spark, sf)).select(F.col("node_count").alias("nodes"), F.col("edge_count").alias("edges"), F.col("file_count").alias("files"))


@query("a2_nodes_by_kind", "SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def _(spark, sf):
    return A.stats(graph(spark, sf)).select(F.explode("nodes_by_kind").alias("kind", "n"))


@query("a2_edges_by_kind", "SELECT kind, count(*) AS n FROM edges GROUP BY 1")
def _(spark, sf):
    return A.count_by(graph(spark, sf).edges, "kind")


@query("a2_files_by_language", "SELECT language, count(*) AS n FROM files GROUP BY 1")
def _(spark, sf):
    return A.count_by(graph(spark, sf).files, "language")


@query("a3_last_indexed", "SELECT max(doc_id*1000) AS last_indexed_at FROM documents", graph=False)
def _(spark, sf):
    return A.last_indexed(T.read(spark, sf, "documents").select((F.col("doc_id") * 1000).alias("indexed_at")))


@query("a4_distinct_names", "SELECT DISTINCT name FROM nodes")
def _(spark, sf):
    return A.distinct_names(graph(spark, sf))


@query("a4_languages", "SELECT DISTINCT language FROM files")
def _(spark, sf):
    return A.languages(graph(spark, sf).files)


@query("a5_w6_dominant_file", "top AS (SELECT a.file_path, count(*) AS edge_count FROM edges e JOIN nodes a ON a.id=e.source JOIN nodes b ON b.id=e.target AND a.file_path=b.file_path GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), kept AS (SELECT *, lead(edge_count) OVER (ORDER BY edge_count DESC, file_path) AS next_edge_count FROM top WHERE NOT regexp_matches(file_path,'(^|/)(tests?|__tests?__|spec)/')) SELECT * FROM (SELECT * FROM kept ORDER BY edge_count DESC, file_path LIMIT 1) WHERE edge_count>=20")
def _(spark, sf):
    return A.dominant_file(graph(spark, sf))


_ROUTES = "routes AS (SELECT page_id, regexp_extract(url,'^[a-z]+://[^/]*/([^/?#]*)',1) AS file_path, regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS route FROM pages)"


def _routes(spark, sf):
    from ..schema import EDGES, NODES, conform

    p = T.read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1).alias("file_path"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("route"))
    r = p.select(F.concat(F.lit("route:"), F.col("page_id").cast("string")).alias("id"), F.lit("route").alias("kind"), F.col("route").alias("name"), "file_path")
    h = p.select(F.concat(F.lit("function:"), F.col("page_id").cast("string")).alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("handle_"), F.col("page_id").cast("string")).alias("name"), "file_path", F.col("page_id").cast("int").alias("start_line"))
    e = p.select(F.concat(F.lit("route:"), F.col("page_id").cast("string")).alias("source"), F.concat(F.lit("function:"), F.col("page_id").cast("string")).alias("target"), F.lit("references").alias("kind"))
    return Graph(conform(r, NODES).unionByName(conform(h, NODES)), conform(e, EDGES))


@query("a6_w7_top_route_file", f"{_ROUTES}, top AS (SELECT file_path, count(*) AS routes FROM routes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), t AS (SELECT *, CAST(sum(routes) OVER () AS BIGINT) AS total FROM top) SELECT * FROM (SELECT * FROM t ORDER BY routes DESC, file_path LIMIT 1) WHERE total>=3 AND routes>=3 AND routes>=0.3*total")
def _(spark, sf):
    return A.top_route_file(_routes(spark, sf))


@query("j4_routing_manifest", f"{_ROUTES} SELECT route, 'handle_'||page_id AS handler, 'function' AS handler_kind, file_path, CAST(page_id AS INT) AS line FROM routes ORDER BY route, handler, file_path, line LIMIT 200")
def _(spark, sf):
    return A.routing_manifest(_routes(spark, sf))


@query("a7_node_metrics", "SELECT n.id, (SELECT count(*) FROM edges WHERE target=n.id) AS incoming, (SELECT count(*) FROM edges WHERE source=n.id) AS outgoing, (SELECT count(*) FROM edges WHERE source=n.id AND kind='calls') AS calls, (SELECT count(*) FROM edges WHERE target=n.id AND kind='calls') AS callers, (SELECT count(*) FROM edges WHERE source=n.id AND kind='contains') AS children FROM nodes n")
def _(spark, sf):
    return A.node_metrics(graph(spark, sf))


@query("a8_modules", "SELECT CASE WHEN contains(path,'/') THEN regexp_replace(path,'/[^/]*$','') ELSE '.' END AS directory, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM files GROUP BY 1")
def _(spark, sf):
    return A.modules(graph(spark, sf).files).select("directory", F.size("paths").cast("long").alias("n"), F.array_join("paths", ",").alias("paths"))


@query("a9_files_by_language", "SELECT language, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM files GROUP BY 1")
def _(spark, sf):
    return A.by_language(graph(spark, sf).files).select("language", "n", F.array_join("paths", ",").alias("paths"))


@query("a10_symbols_per_file", "SELECT file_path, count(DISTINCT name) AS symbols FROM nodes WHERE kind='method' GROUP BY 1")
def _(spark, sf):
    return A.distinct_symbols_per_file(graph(spark, sf).nodes.filter("kind = 'method'").select("file_path", F.col("name").alias("symbol")))


_TERMS = ("lin", "ol", "order_1", "asia")


@query("a11_term_hits", "hits AS (SELECT id, t AS term, length(name) AS score FROM nodes, (VALUES ('lin'),('ol'),('order_1'),('asia')) v(t) WHERE contains(lower(name), t)) SELECT id, count(DISTINCT term) AS terms, max(score) AS score FROM hits GROUP BY 1")
def _(spark, sf):
    n = graph(spark, sf).nodes
    hits = n.select("id", "name", F.explode(F.array(*map(F.lit, _TERMS))).alias("term")).filter(F.contains(F.lower("name"), F.col("term")))
    return A.term_hits(hits.select("id", "term", F.length("name").cast("long").alias("score")))


@query("a12_failed_tails", "SELECT tail AS name_tail, count(*) AS n FROM (SELECT regexp_extract(reference_name,'([^.:]*)$',1) AS tail FROM refs) WHERE tail<>'' GROUP BY 1 HAVING count(*)<=40")
def _(spark, sf):
    return A.failed_tails(T.refs(spark, sf).withColumn("status", F.lit("failed")), 40)


@query("a14_callers_by_file", "SELECT n.file_path, count(*) AS n, string_agg(n.name, ',' ORDER BY n.start_line, n.name, n.kind, n.id) AS names FROM edges e JOIN nodes n ON n.id=e.source WHERE e.target='method:1' AND e.kind='calls' GROUP BY 1")
def _(spark, sf):
    g = graph(spark, sf, "calls")
    return A.grouped_by_file(V.callers(g, "method:1")).select("file_path", "n", F.array_join(F.transform("symbols", lambda s: s["name"]), ",").alias("names"))


@query("a15_blast_radius", f"c AS (SELECT DISTINCT e.target AS id, e.source, n.file_path, regexp_matches(n.file_path,'/(tests|test|__tests__|spec|specs|testlib|testing)/') AS test FROM edges e JOIN nodes n ON n.id=e.source WHERE e.kind IN {CALLS} AND e.source<>e.target) SELECT id, count(*) AS callers, count(DISTINCT CASE WHEN NOT test THEN file_path END) AS files, count(DISTINCT CASE WHEN test THEN file_path END) AS test_files FROM c GROUP BY 1")
def _(spark, sf):
    return A.blast_radius(graph(spark, sf, "calls", "references", "imports"))


@query("a16_file_scores", "SELECT file_path, CAST(sum(CASE WHEN is_declaration THEN 50 WHEN is_exported THEN 10 WHEN start_line%2=0 THEN 3 ELSE 1 END) AS BIGINT) AS score FROM nodes GROUP BY 1")
def _(spark, sf):
    role = F.when(F.col("is_declaration"), "named").when(F.col("is_exported"), "entry").when(F.col("start_line") % 2 == 0, "connected").otherwise("other")
    return A.file_scores(graph(spark, sf).nodes.select("file_path", role.alias("role")))


@query("a17_file_mass", "SELECT file_path, CAST(sum(start_line) AS BIGINT) AS mass FROM nodes GROUP BY 1")
def _(spark, sf):
    g = graph(spark, sf)
    return A.file_mass(g.nodes.select("id", F.col("start_line").cast("long").alias("rank")), g)


@query("l7_file_order", "f AS (SELECT path, node_count%5=0 AS named, CAST(node_count AS DOUBLE) AS mass, node_count%3 AS hits, CAST(node_count%7 AS DOUBLE) AS score, length(path) AS size FROM files), k AS (SELECT *, floor(mass/(max(mass) OVER ()*0.01)) AS step FROM f) SELECT path, row_number() OVER (ORDER BY named DESC, step DESC, hits DESC, regexp_matches(path,'(^|/)(tests?|__tests?__|spec)/'), score DESC, size, path) AS place FROM k ORDER BY place LIMIT 60")
def _(spark, sf):
    n = F.col("node_count")
    f = graph(spark, sf).files.select("path", (n % 5 == 0).alias("named"), n.cast("double").alias("mass"), (n % 3).alias("hits"), (n % 7).cast("double").alias("score"), F.length("path").alias("size"))
    top = A.file_order(f).limit(60)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long")).select("path", "place")  # 60 rows


@query("a18_evaluation", "want AS (SELECT n_regionkey AS c, n_name FROM nation), got AS (SELECT n_regionkey AS c, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS r FROM nation WHERE n_nationkey%2=0), j AS (SELECT w.c, g.r FROM want w LEFT JOIN got g ON g.c=w.c AND g.n_name=w.n_name) SELECT CAST(c AS BIGINT) AS case_id, round(count(r)*1.0/count(*),6) AS recall, round(coalesce(1.0/min(r),0),6) AS mrr, (SELECT count(*) FROM got WHERE got.c=j.c) AS node_count, count(r)*1.0/count(*)>=0.5 AS pass FROM j GROUP BY c", graph=False)
def _(spark, sf):
    from pyspark.sql import Window

    n = T.read(spark, sf, "nation").withColumn("case_id", F.col("n_regionkey").cast("long"))
    cases = n.groupBy("case_id").agg(F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("expected"))
    w = Window.partitionBy("case_id").orderBy(F.desc("n_nationkey"))
    found = n.filter("n_nationkey % 2 = 0").select("case_id", F.col("n_name").alias("name"), F.row_number().over(w).alias("rank"))
    return A.evaluation(found, cases).select("case_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "node_count", "pass")


@query("w8_line_windows", "h AS (SELECT DISTINCT l_partkey AS path, l_orderkey%997+1 AS line FROM lineitem), e AS (SELECT CAST(path AS VARCHAR) AS path, greatest(line-2,1) AS s, line+2 AS f FROM h), b AS (SELECT *, max(f) OVER (PARTITION BY path ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e), i AS (SELECT *, sum(CASE WHEN p IS NULL OR s>p+1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s, f) AS g FROM b) SELECT path, min(s) AS start, max(f) AS \"end\" FROM i GROUP BY path, g", graph=False)
def _(spark, sf):
    h = T.read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), (F.col("l_orderkey") % 997 + 1).alias("line")).distinct()
    return C.windows(h)


@query("w3_capped_by_file", "r AS (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY is_exported DESC, CAST(start_line AS DOUBLE) DESC, CASE WHEN kind IN ('class','interface') THEN 2 WHEN kind IN ('function','method') THEN 1 ELSE 0 END DESC, id) AS k FROM nodes) SELECT id, file_path FROM r WHERE k<=10")
def _(spark, sf):
    n = graph(spark, sf).nodes.withColumn("root", F.col("is_exported")).withColumn("score", F.col("start_line").cast("double"))
    return C.capped_by_file(n, 50).select("id", "file_path")


@query("u1_merged_channels", "x AS (SELECT id, CAST(start_line AS DOUBLE) AS score FROM nodes WHERE kind='method' UNION ALL SELECT id, CAST(end_line AS DOUBLE) FROM nodes WHERE language='go') SELECT id, max(score) AS score FROM x GROUP BY 1")
def _(spark, sf):
    n = graph(spark, sf).nodes
    return C.merged(n.filter("kind = 'method'").select("id", F.col("start_line").cast("double").alias("score")), n.filter("language = 'go'").select("id", F.col("end_line").cast("double").alias("score")))


# -- traversals ---------------------------------------------------------------


@query("g1_bfs", f"{reach('r', 'method:1', 'in', 4, ('extends',))} SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, sf):
    return V.bfs(graph(spark, sf, "extends"), "method:1", 4, ("extends",), direction="incoming", limit=None).select("id", "depth")


@query("g1_bfs_node_kinds", f"{reach('r', 'namespace:3', 'out', 3, (), ' JOIN nodes n ON n.id=e.target AND n.kind IN (' + chr(39) + 'class' + chr(39) + ',' + chr(39) + 'function' + chr(39) + ',' + chr(39) + 'namespace' + chr(39) + ')')} SELECT id, min(depth) AS depth FROM r WHERE depth>0 GROUP BY 1")
def _(spark, sf):
    out = V.bfs(graph(spark, sf), "namespace:3", 3, node_kinds=("class", "function", "namespace"), limit=None, include_start=False)
    return out.select("id", "depth")


@query("g2_dfs", f"{reach('r', 'method:3', 'in', 30, ('extends',))} SELECT DISTINCT id FROM r")
def _(spark, sf):
    g = graph(spark, sf, "extends")
    return V.depth_first(g, "method:3", kinds=("extends",), direction="incoming").select("id")


@query("g3_callers", f"SELECT n.id, n.name, n.file_path, e.kind AS edge_kind, e.line AS edge_line FROM edges e JOIN nodes n ON n.id=e.source WHERE e.target='method:1' AND e.kind IN {CALLS} AND e.source<>e.target")
def _(spark, sf):
    g = Graph(T.nodes(spark, sf), T.edges(spark, sf, ("calls", "references", "imports"), near="method:1"))
    return V.callers(g, "method:1").select("id", "name", "file_path", "edge_kind", "edge_line")


@query("g3_callers_depth_2", f"{reach('r', 'interface:3', 'in', 2, ('calls', 'references', 'imports'))} SELECT id, min(depth) AS depth FROM r WHERE id<>'interface:3' GROUP BY 1")
def _(spark, sf):
    return V.callers(graph(spark, sf, "calls", "references", "imports"), "interface:3", 2).select("id", "depth")


@query("g4_callees", f"SELECT n.id, n.name, e.kind AS edge_kind, e.line AS edge_line FROM edges e JOIN nodes n ON n.id=e.target WHERE e.source='method:2' AND e.kind IN {CALLS} AND e.source<>e.target")
def _(spark, sf):
    g = Graph(T.nodes(spark, sf), T.edges(spark, sf, ("calls", "references", "imports"), near="method:2"))
    return V.callees(g, "method:2").select("id", "name", "edge_kind", "edge_line")


@query("g5_call_graph", f"{reach('u', 'method:2', 'in', 2, ('calls', 'references', 'imports'))}, {reach('d', 'method:2', 'out', 2, ('calls', 'references', 'imports'))} SELECT id FROM u UNION SELECT id FROM d")
def _(spark, sf):
    return V.call_graph(graph(spark, sf, "calls", "references", "imports"), "method:2").select("id")


@query("g6_hierarchy", f"{reach('u', 'method:5', 'out', 40, ('extends', 'implements'))}, {reach('d', 'method:5', 'in', 40, ('extends', 'implements'))} SELECT id, min(depth) AS depth FROM u GROUP BY 1 UNION SELECT id, -min(depth) FROM d GROUP BY 1")
def _(spark, sf):
    return V.hierarchy(graph(spark, sf, "extends"), "method:5").select("id", "depth")


@query("g6_hierarchy_up", f"{reach('u', 'method:150', 'out', 40, ('extends', 'implements'))} SELECT id, min(depth) AS depth FROM u GROUP BY 1")
def _(spark, sf):
    return V.hierarchy(graph(spark, sf, "extends"), "method:150", "up").select("id", "depth")


@query("g7_usages", "SELECT n.id, n.kind, e.kind AS edge_kind FROM edges e JOIN nodes n ON n.id=e.source WHERE e.target='interface:3'")
def _(spark, sf):
    return V.usages(Graph(T.nodes(spark, sf), T.edges(spark, sf, near="interface:3")), "interface:3").select("id", "kind", "edge_kind")


@query("g8_impact", "m AS (SELECT e.source AS a, e.target AS b FROM edges e JOIN nodes n ON n.id=e.source AND n.kind IN ('class','interface','struct','trait','protocol','module','enum') WHERE e.kind='contains'), r(id, depth) AS (SELECT 'interface:3', 0 UNION SELECT x.b, r.depth+x.w FROM r JOIN (SELECT a, b, 0 AS w FROM m UNION ALL SELECT target, source, 1 FROM edges WHERE kind<>'contains') x ON x.a=r.id WHERE r.depth+x.w<=2) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, sf):
    return V.impact(graph(spark, sf), "interface:3", 2).select("id", "depth")


@query("g8_impact_container", "m AS (SELECT e.source AS a, e.target AS b FROM edges e JOIN nodes n ON n.id=e.source AND n.kind IN ('class','interface','struct','trait','protocol','module','enum') WHERE e.kind='contains'), r(id, depth) AS (SELECT 'module:2', 0 UNION SELECT x.b, r.depth+x.w FROM r JOIN (SELECT a, b, 0 AS w FROM m UNION ALL SELECT target, source, 1 FROM edges WHERE kind<>'contains') x ON x.a=r.id WHERE r.depth+x.w<=3) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, sf):
    return V.impact(graph(spark, sf), "module:2").select("id", "depth")


@query("g9_path", f"{reach('u', 'method:150', 'out', 40, ('extends',))} SELECT min(depth) AS step, id FROM u GROUP BY 2 HAVING min(depth)<=(SELECT min(depth) FROM u WHERE id='method:2')")
def _(spark, sf):
    return V.path(graph(spark, sf, "extends"), "method:150", "method:2", ("extends",)).select("step", "id")


@query("g9_path_none", "SELECT CAST(0 AS INT) AS step, id FROM nodes WHERE false")
def _(spark, sf):
    return V.path(graph(spark, sf, "extends"), "method:2", "method:150", ("extends",)).select("step", "id")


@query("g10_ancestors", "r(\"of\", id, depth) AS (SELECT id, id, 0 FROM nodes WHERE kind='function' UNION ALL SELECT r.\"of\", e.source, r.depth+1 FROM r JOIN edges e ON e.target=r.id AND e.kind='contains') SELECT \"of\", id, depth FROM r WHERE depth>0")
def _(spark, sf):
    g = graph(spark, sf, "contains")
    return V.ancestors(g, g.nodes.filter("kind = 'function'")).select("of", "id", "depth")


@query("g11_children", "SELECT n.id, n.name FROM edges e JOIN nodes n ON n.id=e.target WHERE e.kind='contains' AND e.source='namespace:3'")
def _(spark, sf):
    return V.children(graph(spark, sf, "contains"), "namespace:3").select("id", "name")


@query("g12_context", "r(id, depth) AS (SELECT 'namespace:3', 0 UNION ALL SELECT e.source, r.depth+1 FROM r JOIN edges e ON e.target=r.id AND e.kind='contains') SELECT 'focal' AS role, 'namespace:3' AS id, NULL AS edge_kind UNION ALL SELECT 'ancestor', id, NULL FROM r WHERE depth>0 UNION ALL SELECT 'child', target, NULL FROM edges WHERE kind='contains' AND source='namespace:3' UNION ALL SELECT 'incoming', source, kind FROM edges WHERE kind<>'contains' AND target='namespace:3' UNION ALL SELECT 'outgoing', target, kind FROM edges WHERE kind<>'contains' AND source='namespace:3'")
def _(spark, sf):
    return V.context(graph(spark, sf), "namespace:3")


_CYCLE = "p AS (SELECT source AS a, target AS b FROM edges WHERE kind='imports'), r(a, b, d) AS (SELECT a, b, 1 FROM p UNION SELECT r.a, p.b, d+1 FROM r JOIN p ON p.a=r.b WHERE d<30)"


@query("g14_cycles", f"{_CYCLE} SELECT n.file_path AS path, min(m.file_path) AS component FROM r JOIN r q ON q.a=r.b AND q.b=r.a JOIN nodes n ON n.id=r.a JOIN nodes m ON m.id=r.b WHERE n.id IN (SELECT a FROM r WHERE a=b AND a IN (SELECT x.a FROM r x JOIN r y ON x.b=y.a AND x.a=y.b AND x.a<>x.b)) GROUP BY 1")
def _(spark, sf):
    return G.cycles(graph(spark, sf, "imports"))


@query("g14_strong_components", f"{_CYCLE}, ids AS (SELECT a AS id FROM p UNION SELECT b FROM p) SELECT ids.id, coalesce(least(ids.id, (SELECT min(r.b) FROM r JOIN r q ON q.a=r.b AND q.b=r.a WHERE r.a=ids.id)), ids.id) AS component FROM ids")
def _(spark, sf):
    return G.strong_components(graph(spark, sf, "imports").edges.select(F.col("source").alias("a"), F.col("target").alias("b")))


@query("closure_reachable_pairs", f"{_CYCLE} SELECT DISTINCT a, b FROM r")
def _(spark, sf):
    return G.closure(graph(spark, sf, "imports").edges.select(F.col("source").alias("a"), F.col("target").alias("b")))


@query("g17_affected_tests", "dep AS (SELECT source_file AS b, target_file AS a FROM pairs), r(id, depth) AS (SELECT 'asia/nation_12/suppliers', 0 UNION SELECT dep.b, r.depth+1 FROM r JOIN dep ON dep.a=r.id WHERE r.depth<5 AND NOT contains(r.id,'/tests/')) SELECT DISTINCT id AS path, contains(id,'/tests/') AS test FROM r WHERE depth>0")
def _(spark, sf):
    return V.affected_tests(graph(spark, sf), ["asia/nation_12/suppliers"])


def _walk(rounds):
    steps = [f"k0 AS (SELECT id, r AS rank FROM base)"]
    for i in range(1, rounds + 1):
        steps.append(f"k{i} AS MATERIALIZED (SELECT b.id, 0.25*b.r+0.75*(coalesce((SELECT sum(s.share*p.rank) FROM step s JOIN k{i - 1} p ON p.id=s.a WHERE s.b=b.id),0)+CASE WHEN b.alone THEN (SELECT rank FROM k{i - 1} p WHERE p.id=b.id) ELSE 0 END) AS rank FROM base b)")
    return ", ".join(steps)


@query("g18_personal_rank", f"ids AS (SELECT id FROM nodes WHERE kind='namespace'), both_ways AS (SELECT source AS a, target AS b FROM edges WHERE kind='imports' UNION ALL SELECT target, source FROM edges WHERE kind='imports'), w AS (SELECT a, b, count(*) AS n FROM both_ways GROUP BY ALL), d AS (SELECT a, sum(n) AS degree FROM w GROUP BY 1), step AS MATERIALIZED (SELECT w.a, w.b, CAST(w.n AS DOUBLE)/CAST(d.degree AS DOUBLE) AS share FROM w JOIN d ON d.a=w.a), base AS MATERIALIZED (SELECT ids.id, CASE WHEN ids.id IN ('namespace:1','namespace:2') THEN 0.5 ELSE 0.0 END AS r, ids.id NOT IN (SELECT a FROM d) AS alone FROM ids), {_walk(25)} SELECT id, round(rank, 6) AS rank FROM k25")
def _(spark, sf):
    g = graph(spark, sf, "imports")
    return G.personal_rank(g, ["namespace:1", "namespace:2"], nodes=g.nodes.filter("kind = 'namespace'")).select("id", F.round("rank", 6).alias("rank"))


def _rank_sql(kinds, seeds, rounds):
    steps = [f"k{i} AS MATERIALIZED (SELECT id, sum(p) AS rank FROM (SELECT id, 0.25*r AS p FROM base UNION ALL SELECT s.b, 0.75*s.share*k.rank FROM step s JOIN k{i - 1} k ON k.id=s.a) GROUP BY 1)" for i in range(1, rounds + 1)]
    return f"""both_ways AS (SELECT source AS a, target AS b FROM edges WHERE kind IN {kinds} UNION ALL SELECT target, source FROM edges WHERE kind IN {kinds}), w AS (SELECT a, b, count(*) AS n FROM both_ways GROUP BY ALL), d AS (SELECT a, sum(n) AS degree FROM w GROUP BY 1),
step AS MATERIALIZED (SELECT w.a, w.b, CAST(w.n AS DOUBLE)/CAST(d.degree AS DOUBLE) AS share FROM w JOIN d ON d.a=w.a UNION ALL SELECT id, id, 1.0 FROM nodes WHERE id NOT IN (SELECT a FROM d)),
base AS MATERIALIZED (SELECT id, CASE WHEN id IN {seeds} THEN 0.5 ELSE 0.0 END AS r FROM nodes), k0 AS (SELECT id, r AS rank FROM base), {", ".join(steps)} SELECT id, round(rank, 6) AS rank FROM k{rounds} WHERE round(rank, 6)>0"""


@query("g18_personal_rank_calls", _rank_sql("('calls','references')", "('method:1','method:2')", 25))
def _(spark, sf):
    return G.personal_rank(graph(spark, sf, "calls", "references"), ["method:1", "method:2"]).select("id", F.round("rank", 6).alias("rank")).filter("rank > 0")


@query("g19_flow", f"{reach('r', 'namespace:1', 'out', 7, ('imports',))} SELECT id, min(depth) AS depth FROM r WHERE id IN ('namespace:2','namespace:5') AND depth>0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(spark, sf):
    g = graph(spark, sf, "imports")
    calls = g.with_edges(g.edges.withColumn("kind", F.lit("calls")))
    return G.flow(calls, ["namespace:1", "namespace:2", "namespace:5"]).select("id", "depth")


@query("g20_chains", "p AS (SELECT source AS a, target AS b FROM edges WHERE kind='imports'), r(path, last) AS (SELECT [x], x FROM (VALUES ('namespace:1'),('namespace:2')) v(x) UNION ALL SELECT list_append(path, b), b FROM r JOIN p ON p.a=r.last WHERE len(path)<6 AND NOT list_contains(path, b)), g AS (SELECT DISTINCT path FROM r WHERE len(path)>=3 AND list_contains(path,'namespace:1') AND list_contains(path,'namespace:2')) SELECT array_to_string(path, '>') AS path FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE len(h.path)>len(g.path) AND contains('>'||array_to_string(h.path,'>')||'>', '>'||array_to_string(g.path,'>')||'>')) ORDER BY len(g.path) DESC, 1 LIMIT 3")
def _(spark, sf):
    g = graph(spark, sf, "imports")
    calls = g.with_edges(g.edges.withColumn("kind", F.lit("calls")))
    return G.chains(calls, g.nodes.filter("kind = 'namespace'"), ["namespace:1", "namespace:2"]).select(F.array_join("path", ">").alias("path"))


@query("g21_dispatch_family", f"p AS (SELECT e.source AS a, e.target AS b FROM edges e JOIN nodes x ON x.id=e.source JOIN nodes y ON y.id=e.target AND x.name=y.name WHERE e.kind='extends'), q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, depth) AS (SELECT 'method:3', 0 UNION SELECT q.b, r.depth+1 FROM r JOIN q ON q.a=r.id WHERE r.depth<12) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, sf):
    g = graph(spark, sf, "extends")
    over = g.with_edges(g.edges.withColumn("kind", F.lit("overrides")))
    return G.dispatch_family(over, "method:3").select("id", "depth")


@query("g22_definitions", f"q AS (SELECT source AS a, target AS b FROM edges WHERE kind='imports' UNION ALL SELECT target, source FROM edges WHERE kind='imports'), r(id, depth) AS (SELECT 'namespace:4', 0 UNION SELECT q.b, r.depth+1 FROM r JOIN q ON q.a=r.id WHERE r.depth<26) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, sf):
    g = graph(spark, sf, "imports")
    return G.definitions(g.with_edges(g.edges.withColumn("kind", F.lit("defines"))), "namespace:4").select("id", "depth")


@query("g23_polymorphic", "u AS (SELECT DISTINCT source, target FROM edges WHERE kind='extends') SELECT DISTINCT source AS id FROM u WHERE target IN (SELECT target FROM u GROUP BY 1 HAVING count(*)>=2)")
def _(spark, sf):
    return A.polymorphic(graph(spark, sf, "extends"), 2)


@query("g24_glue", f"roots AS (SELECT id FROM nodes WHERE kind='interface' AND start_line<5), near AS (SELECT target AS id FROM edges WHERE kind IN {CALLS} AND source IN (SELECT id FROM roots) UNION SELECT source FROM edges WHERE kind IN {CALLS} AND target IN (SELECT id FROM roots)) SELECT near.id FROM near JOIN nodes n ON n.id=near.id WHERE n.file_path IN (SELECT path FROM files WHERE path LIKE 'parts/%small') AND near.id NOT IN (SELECT id FROM roots) ORDER BY 1 LIMIT 60")
def _(spark, sf):
    g = graph(spark, sf, "calls", "references", "imports")
    return G.glue(g, g.nodes.filter("kind = 'interface' and start_line < 5").select("id"), g.files.filter("path like 'parts/%small'").select("path"))


@query("x_camel_words", "SELECT DISTINCT name, array_to_string(regexp_split_to_array(lower(regexp_replace(regexp_replace(name,'([a-z])([A-Z])','\\1 \\2','g'),'([A-Z]+)([A-Z][a-z])','\\1 \\2','g')),'[\\s_.]+'),' ') AS words FROM nodes")
def _(spark, sf):
    return graph(spark, sf).nodes.select("name", F.array_join(X.camel_words("name"), " ").alias("words")).distinct()
