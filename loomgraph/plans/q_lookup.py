"""Queries: sources, sinks, lookups, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context as C
from ..operators import lookup as L
from ..operators import storage as W
from ..schema import Graph
from ..sources import tables as T
from .registry import query

NODE = ["id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "is_exported", "is_declaration"]
N = ", ".join(NODE)
SHORT = ["id", "kind", "name", "file_path", "start_line"]
SN = ", ".join(SHORT)


def nodes(spark, sf):
    return T.nodes(spark, sf)


@query("s5_all_nodes", f"SELECT {N} FROM nodes")
def _(spark, sf):
    return nodes(spark, sf).select(NODE)


@query("s5_all_files", "SELECT path, language, CAST(node_count AS BIGINT) AS node_count FROM files")
def _(spark, sf):
    return T.files(nodes(spark, sf)).select("path", "language", F.col("node_count").cast("long").alias("node_count"))


@query("s6_nodes_of_kind", f"SELECT {SN} FROM nodes WHERE kind='interface'")
def _(spark, sf):
    return L.of_kind(T.graph(spark, sf), "interface").select(SHORT)


def _tagged(spark, sf):
    deco = F.when(F.col("start_line") % 2 == 0, F.array(F.lit("expect"), F.lit("inline"))).otherwise(F.array(F.lit("actual")))
    return nodes(spark, sf).withColumn("decorators", deco)


@query("s7_decorated", f"SELECT {SN} FROM nodes WHERE language='kotlin' AND start_line%2=0")
def _(spark, sf):
    return L.decorated(Graph(_tagged(spark, sf), T.edges(spark, sf)), "kotlin", "expect").select(SHORT)


_EXT = [".py", ".ts", ".go", ".h", ".vue", ".txt", ".java", ".kts", ".tsx", ".sc", ".mm", ".rb"]
_PATHS = ["src/a/test_x.py", "pkg/y_test.go", "src/FooTest.kt", "src/latest.kt", "node_modules/z/i.js", "api/v1/t.pb.go", "web/u.generated.ts", "spec/v.rb", "examples/w.py", "src/jvmTest/k.kt", "lib/build/o.c", "src/FooGrpc.java", "src/core/m.rs", "a/x.egg-info/p.py", "tests/q.java", "mock_r.go"]


def _pick(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(key, values):
    return "list_extract([" + ",".join(f"'{v}'" for v in values) + f"], CAST({key}%{len(values)}+1 AS INT))"


@query("s3_language_by_extension", f"SELECT doc_id, p AS path, CASE e WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.h' THEN 'c' WHEN '.vue' THEN 'vue' WHEN '.java' THEN 'java' WHEN '.kts' THEN 'kotlin' WHEN '.tsx' THEN 'tsx' WHEN '.sc' THEN 'scala' WHEN '.mm' THEN 'objc' WHEN '.rb' THEN 'ruby' END AS language, e<>'.txt' AS is_source FROM (SELECT doc_id, e, source||'/f'||doc_id||e AS p FROM (SELECT doc_id, source, {_pick_sql('doc_id', _EXT)} AS e FROM documents))", graph=False)
def _(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), _pick(F.col("doc_id"), _EXT)).alias("path"))
    return d.withColumn("language", X.language_of("path")).withColumn("is_source", X.is_source("path"))


def _re(pattern):
    return pattern.replace("'", "''")


_BASE = "regexp_extract(p, '([^/]*)$', 1)"


@query("s19_s21_path_classes", f"SELECT doc_id, p AS path, regexp_matches(p, '{_re(X.IGNORED)}') AS ignored, regexp_matches(p, '{_re(X.GENERATED)}') AS generated, regexp_matches(lower({_BASE}), '{_re(X.TEST_NAME_LOWER)}') OR regexp_matches({_BASE}, '{_re(X.TEST_NAME)}') OR regexp_matches(lower(p), '{_re(X.TEST_DIR_LOWER)}') OR regexp_matches(p, '{_re(X.TEST_DIR)}') AS test, regexp_matches(lower(p), '{_re(X.LOW_VALUE)}') OR regexp_matches(p, '{_re(X.GENERATED)}') AS low_value FROM (SELECT doc_id, {_pick_sql('doc_id', _PATHS)} AS p FROM documents)", graph=False)
def _(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", _pick(F.col("doc_id"), _PATHS).alias("path"))
    return d.select("*", X.is_ignored("path").alias("ignored"), X.is_generated("path").alias("generated"), X.is_test("path").alias("test"), X.is_low_value("path").alias("low_value"))


@query("s8_source_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS source FROM documents", graph=False)
def _(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.lines("text", 2, 3).alias("source"))


@query("s9_s14_upsert_nodes", "SELECT id, CASE WHEN kind='method' AND start_line%3=0 THEN upper(name) ELSE name END AS name, kind FROM nodes UNION ALL SELECT 'extra:1', 'extra', 'function'")
def _(spark, sf):
    n = nodes(spark, sf)
    new = n.filter("kind = 'method' and start_line % 3 = 0").withColumn("name", F.upper("name"))
    bad = spark.createDataFrame([("extra:1", "function", "extra", "a", "go"), ("extra:2", "function", None, "a", "go")], "id string, kind string, name string, file_path string, language string")
    from ..schema import NODES, conform

    return W.insert_nodes(n, new.unionByName(conform(bad, NODES))).select("id", "name", "kind")


@query("s10_insert_edges", "SELECT source, target, kind, CAST(coalesce(line,-1) AS BIGINT) AS line FROM (SELECT * FROM edges UNION SELECT source, target, 'references', line FROM edges WHERE kind='calls' AND line=1)")
def _(spark, sf):
    g = T.graph(spark, sf)
    again = g.edges.filter("kind = 'extends'")
    more = g.edges.filter("kind = 'calls' and line = 1").withColumn("kind", F.lit("references"))
    dangling = g.edges.filter("kind = 'imports'").withColumn("target", F.lit("nowhere"))
    out = W.insert_edges(g, again.unionByName(more).unionByName(dangling))
    return out.select("source", "target", "kind", F.coalesce("line", F.lit(-1)).cast("long").alias("line"))


@query("s11_upsert_files", "SELECT path, CASE WHEN node_count>10 THEN 'new' ELSE language END AS language FROM files")
def _(spark, sf):
    f = T.files(nodes(spark, sf)).select("path", "language", "node_count")
    return W.upsert(f, f.filter("node_count > 10").withColumn("language", F.lit("new")), "path").select("path", "language")


@query("s13_delete_files", "gone AS (SELECT id FROM nodes WHERE file_path LIKE '%/tests/%') SELECT 'node' AS what, kind, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY ALL UNION ALL SELECT 'edge', kind, count(*) FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY ALL")
def _(spark, sf):
    g = T.graph(spark, sf)
    out = W.delete_files(g, g.files.filter(F.contains("path", F.lit("/tests/"))).select("path"))
    count = F.count(F.lit(1)).alias("n")
    return out.nodes.groupBy(F.lit("node").alias("what"), "kind").agg(count).unionByName(out.edges.groupBy(F.lit("edge").alias("what"), "kind").agg(count))


@query("s13_delete_edges_by_source", "SELECT source, target, kind FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE kind='function')")
def _(spark, sf):
    g = T.graph(spark, sf)
    return W.delete_edges_from(g, L.of_kind(g, "function")).edges.select("source", "target", "kind")


@query("s16_delete_refs", "SELECT ref_id, reference_name FROM refs WHERE NOT (language='java' AND reference_kind='calls')")
def _(spark, sf):
    r = T.refs(spark, sf)
    return W.delete_refs(r, r.filter("language = 'java' and reference_kind = 'calls'").select("from_node_id", "reference_name", "reference_kind")).select("ref_id", "reference_name")


@query("s17_metadata", "SELECT r_name AS key, CASE WHEN r_name='ASIA' THEN 'changed' ELSE 'v'||r_regionkey END AS value FROM region", graph=False)
def _(spark, sf):
    m = T.read(spark, sf, "region").select(F.col("r_name").alias("key"), F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("value"))
    return W.metadata_set(m, "ASIA", "changed").select("key", "value")


@query("s18_json", "SELECT '{\"id\":\"'||id||'\",\"kind\":\"'||kind||'\",\"start_line\":'||start_line||'}' AS json FROM nodes WHERE kind='namespace'")
def _(spark, sf):
    return C.as_json(nodes(spark, sf).filter("kind = 'namespace'").select("id", "kind", "start_line"))


@query("s22_config_leaf", "SELECT id, CASE WHEN language='yaml' THEN qualified_name ELSE 'text of '||name END AS shown FROM nodes WHERE kind IN ('module','class')")
def _(spark, sf):
    n = nodes(spark, sf).filter("kind in ('module', 'class')").withColumn("kind", F.when(F.col("kind") == "module", "property").otherwise(F.col("kind")))
    return n.select("id", X.shown_source(F.concat(F.lit("text of "), F.col("name"))).alias("shown"))


@query("s23_pending_page", "SELECT ref_id, reference_name FROM refs WHERE ref_id>100 ORDER BY ref_id LIMIT 50")
def _(spark, sf):
    return L.pending(T.refs(spark, sf), after=100, most=50).select("ref_id", "reference_name")


@query("f1_by_id", f"SELECT {N} FROM nodes WHERE id='method:7'")
def _(spark, sf):
    return L.by_id(T.graph(spark, sf), "method:7").select(NODE)


@query("f2_by_ids", f"SELECT {SN} FROM nodes WHERE kind='method' AND start_line%2=0")
def _(spark, sf):
    n = nodes(spark, sf)
    ids = n.filter("kind = 'method' and start_line % 2 = 0").select("id").unionByName(spark.createDataFrame([("missing:1",)], "id string"))
    return L.by_ids(T.graph(spark, sf), ids).select(SHORT)


@query("f3_existing_ids", "SELECT DISTINCT target AS id FROM edges WHERE kind IN ('extends','imports')")
def _(spark, sf):
    g = T.graph(spark, sf)
    ids = g.edges.filter("kind in ('extends', 'imports')").select(F.col("target").alias("id")).unionByName(spark.createDataFrame([("missing:1",)], "id string"))
    return L.existing(g, ids)


@query("f4_in_file", f"SELECT {SN} FROM nodes WHERE file_path=(SELECT min(file_path) FROM nodes WHERE kind='class')")
def _(spark, sf):
    g = T.graph(spark, sf)
    return L.in_file(g, g.nodes.filter("kind = 'class'").agg(F.min("file_path")).first()[0]).select(SHORT)


@query("f5_by_kind", f"SELECT {SN} FROM nodes WHERE kind='class'")
def _(spark, sf):
    return L.of_kind(T.graph(spark, sf), "class").select(SHORT)


@query("f6_by_name", f"SELECT {SN} FROM nodes WHERE name=(SELECT min(name) FROM nodes WHERE kind='method')")
def _(spark, sf):
    g = T.graph(spark, sf)
    return L.of_name(g, g.nodes.filter("kind = 'method'").agg(F.min("name")).first()[0]).select(SHORT)


@query("f7_by_qualified_name", f"SELECT {SN} FROM nodes WHERE qualified_name=(SELECT min(qualified_name) FROM nodes WHERE kind='method')")
def _(spark, sf):
    g = T.graph(spark, sf)
    return L.of_qualified_name(g, g.nodes.filter("kind = 'method'").agg(F.min("qualified_name")).first()[0]).select(SHORT)


@query("f8_by_lower_name", f"SELECT {SN} FROM nodes WHERE lower(name)='asia'")
def _(spark, sf):
    return L.of_lower_name(T.graph(spark, sf), "AsIa").select(SHORT)


@query("f9_f10_symbol", f"SELECT {SN} FROM nodes WHERE name=(SELECT min(name) FROM nodes WHERE kind='function' AND file_path LIKE 'asia/%') AND list_contains(string_split(file_path,'/'),'asia')")
def _(spark, sf):
    g = T.graph(spark, sf)
    first = g.nodes.filter("kind = 'function' and file_path like 'asia/%'").agg(F.min("name")).first()[0]
    return L.of_symbol(g, f"asia/{first}").select(SHORT)


@query("f9_symbol_suffix", f"SELECT {SN} FROM nodes WHERE qualified_name='ASIA::'||name AND name=(SELECT min(name) FROM nodes WHERE kind='namespace' AND qualified_name LIKE 'ASIA::%')")
def _(spark, sf):
    g = T.graph(spark, sf)
    first = g.nodes.filter("kind = 'namespace' and qualified_name like 'ASIA::%'").agg(F.min("name")).first()[0]
    return L.of_symbol(g, f"ASIA.{first}").select(SHORT)


@query("f11_filtered", f"SELECT {SN} FROM nodes WHERE kind IN ('class','method') AND language IN ('java','go') AND (lower(file_path) LIKE '%asia%' OR lower(file_path) LIKE '%parts%') AND lower(name) LIKE '%1%' ORDER BY is_declaration, length(name), name, qualified_name, kind, file_path, start_line, id LIMIT 40 OFFSET 5")
def _(spark, sf):
    return L.filtered(T.graph(spark, sf), ["class", "method"], ["java", "go"], ["Asia", "parts"], ["1"], limit=40, offset=5).select(SHORT)


@query("f12_path_globs", f"SELECT {SN} FROM nodes WHERE regexp_matches(lower(file_path), '^(asia|europe)/.*') AND NOT regexp_matches(lower(file_path), '(^|.*/)index$')")
def _(spark, sf):
    return nodes(spark, sf).filter(X.path_globs("file_path", ("asia/**", "EUROPE/**"), ("index",))).select(SHORT)


@query("f13_line_span", f"f AS (SELECT min(file_path) AS p FROM nodes WHERE kind='method'), l AS (SELECT min(start_line)+1 AS l FROM nodes, f WHERE file_path=p) SELECT {SN} FROM nodes, f, l WHERE file_path=p AND l BETWEEN start_line AND end_line")
def _(spark, sf):
    g = T.graph(spark, sf)
    p = g.nodes.filter("kind = 'method'").agg(F.min("file_path")).first()[0]
    line = g.nodes.filter(F.col("file_path") == p).agg(F.min("start_line")).first()[0] + 1
    return L.spanning(g, p, line).select(SHORT)


@query("f14_wildcard", f"SELECT {SN} FROM nodes WHERE kind IN ('class','interface','function','method','struct','trait','enum','module') AND regexp_matches(qualified_name, '^A.*::.*1.$')")
def _(spark, sf):
    return L.wildcard(T.graph(spark, sf), "A*::*1?").select(SHORT)


@query("f15_exported", f"SELECT {SN} FROM nodes WHERE is_exported AND file_path=(SELECT min(file_path) FROM nodes WHERE kind='function')")
def _(spark, sf):
    g = T.graph(spark, sf)
    return L.exported(g, g.nodes.filter("kind = 'function'").agg(F.min("file_path")).first()[0]).select(SHORT)


@query("f16_files_under", "SELECT path FROM files WHERE (path='asia' OR path LIKE 'asia/%') AND regexp_matches(path, 'n[^/]*_1')")
def _(spark, sf):
    return L.files_under(T.files(nodes(spark, sf)), "./asia/", "n*_1").select("path")


@query("f17_subgraph", "keep AS (SELECT id FROM nodes WHERE language='java' OR kind='namespace') SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep)")
def _(spark, sf):
    return L.subgraph(T.graph(spark, sf), "language = 'java' or kind = 'namespace'").edges.select("source", "target", "kind")


@query("f18_edges_in", "SELECT source, target, kind, line FROM edges WHERE target='method:1' AND kind IN ('calls','extends')")
def _(spark, sf):
    return L.in_edges(T.graph(spark, sf), "method:1", ("calls", "extends")).select("source", "target", "kind", "line")


@query("f18_edges_out", "SELECT source, target, kind, line FROM edges WHERE source='method:5'")
def _(spark, sf):
    return L.out_edges(T.graph(spark, sf), "method:5").select("source", "target", "kind", "line")


@query("f19_pending_refs", "SELECT ref_id, reference_name, file_path FROM refs WHERE file_path IN ('parts/brand_1/small','parts/brand_6/small')")
def _(spark, sf):
    return L.pending(T.refs(spark, sf), paths=["parts/brand_1/small", "parts/brand_6/small"]).select("ref_id", "reference_name", "file_path")


@query("f20_stale_files", "SELECT path FROM files WHERE node_count%3=0")
def _(spark, sf):
    f = T.files(nodes(spark, sf))
    return L.stale(f, f.select("path", F.when(F.col("node_count") % 3 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))).select("path")


_ASKED = ["getUser", "0x4237F001", "12345", "how does it work?", "two words", "RepAlloc.Rsp", "中文", " padded ", "a_b", "plain"]


@query("f21_query_guard", f"SELECT doc_id, q AS query, CASE WHEN regexp_matches(q,'[一-鿿]') THEN 'cjk' WHEN regexp_matches(trim(q),'^0x[0-9A-Fa-f]+$') THEN 'hex' WHEN regexp_matches(trim(q),'^[0-9]+$') THEN 'digits' WHEN regexp_matches(q,'[?？]') THEN 'question' WHEN regexp_matches(trim(q),'\\s') THEN 'space' END AS reason FROM (SELECT doc_id, {_pick_sql('doc_id', _ASKED)} AS q FROM documents)", graph=False)
def _(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", _pick(F.col("doc_id"), _ASKED).alias("query"))
    return d.withColumn("reason", X.query_guard("query"))


@query("f22_distinctive", "SELECT id, name, regexp_matches(name,'[_0-9]') OR regexp_matches(substr(name,2),'[A-Z]') AS distinctive FROM nodes WHERE kind IN ('module','method','class')")
def _(spark, sf):
    n = nodes(spark, sf).filter("kind in ('module', 'method', 'class')")
    return n.select("id", "name", X.is_distinctive("name").alias("distinctive"))


@query("fn_string_functions", """SELECT id, regexp_replace(lower(qualified_name),'[^a-z0-9]','','g') AS token, regexp_extract(qualified_name,'([^.:]*)$',1) AS tail, array_to_string(list_filter(regexp_split_to_array(qualified_name||'/x.y','::|[./]'), lambda x: x<>''),'::') AS canonical, string_split(file_path,'/')[-1] AS base, CASE WHEN contains(file_path,'/') THEN regexp_replace(file_path,'/[^/]*$','') ELSE '.' END AS dir, sha256(file_path) AS hash, CAST(levenshtein(name, 'order_100') AS BIGINT) AS distance FROM nodes""")
def _(spark, sf):
    n = nodes(spark, sf)
    return n.select(
        "id", X.name_token("qualified_name").alias("token"), X.name_tail("qualified_name").alias("tail"), X.canonical(F.concat("qualified_name", F.lit("/x.y"))).alias("canonical"), X.basename("file_path").alias("base"),
        X.dirname("file_path").alias("dir"), F.sha2(F.col("file_path").cast("binary"), 256).alias("hash"), F.levenshtein("name", F.lit("order_100")).cast("long").alias("distance"),
    )


@query("fn_node_id", "SELECT id AS old, kind||':'||substr(sha256(file_path||':'||kind||':'||name||':'||start_line),1,32) AS new_id FROM nodes")
def _(spark, sf):
    from ..schema import node_id

    return nodes(spark, sf).select(F.col("id").alias("old"), node_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line")).alias("new_id"))
