"""Queries: reference resolution, derived edges, incremental and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import resolve as R
from ..operators import synth as Y
from ..schema import EDGES, NODES, REFS, Graph, conform
from ..sources import files as S
from ..sources import tables as T
from ..streaming import watch
from . import build
from .q_graph import graph
from .registry import query

# -- resolution ---------------------------------------------------------------

_PROX = "least(80, 15*CAST((CASE WHEN string_split(a,'/')[1]<>string_split(b,'/')[1] OR NOT contains(a,'/') OR NOT contains(b,'/') THEN 0 WHEN len(string_split(a,'/'))<3 OR len(string_split(b,'/'))<3 OR string_split(a,'/')[2]<>string_split(b,'/')[2] THEN 1 WHEN len(string_split(a,'/'))<4 OR len(string_split(b,'/'))<4 OR string_split(a,'/')[3]<>string_split(b,'/')[3] THEN 2 ELSE 3 END) AS INT))"


def _fam(x):
    return f"CASE WHEN {x} IN ('java','kotlin') THEN 'jvm' ELSE {x} END"


_SCORED = f"""cand AS (SELECT r.ref_id, r.reference_kind, r.line, r.file_path AS a, r.language AS rl, n.id AS c_id, n.name, n.qualified_name, n.kind, n.file_path AS b, n.language AS cl, n.start_line, n.is_exported FROM refs r JOIN nodes n ON n.name=r.reference_name WHERE r.reference_kind<>'references' OR {_fam('n.language')}={_fam('r.language')}),
scored AS (SELECT *, {_PROX} AS prox FROM cand),
ranked AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n, CASE WHEN a=b THEN 100 ELSE 0 END + prox + CASE WHEN cl=rl THEN 50 ELSE -80 END + CASE WHEN reference_kind='calls' AND kind IN ('function','method') THEN 25 ELSE 0 END + CASE WHEN is_exported THEN 10 ELSE 0 END AS score FROM scored),
exact AS (SELECT ref_id, c_id AS target, CAST(CASE WHEN n=1 THEN CASE WHEN cl=rl THEN 0.9 ELSE 0.5 END ELSE CASE WHEN prox>=30 THEN 0.7 ELSE 0.4 END END AS DECIMAL(4,2)) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, name, qualified_name, kind, b, start_line, c_id) AS k FROM ranked) WHERE k=1 AND (n=1 OR score>-1))"""
_QUALIFIED = f"qual AS (SELECT ref_id, min(id) AS target, CAST(0.95 AS DECIMAL(4,2)) AS confidence FROM (SELECT r.ref_id, n.id FROM refs r JOIN nodes n ON n.qualified_name=r.reference_name WHERE contains(r.reference_name,'::') AND (r.reference_kind<>'references' OR {_fam('n.language')}={_fam('r.language')})) GROUP BY 1 HAVING count(*)=1)"


@query("r1_known_refs", "parts AS (SELECT ref_id, unnest(list_append(list_filter(regexp_split_to_array(reference_name,'::|[./]'), lambda x: x<>''), reference_name)) AS name FROM refs) SELECT DISTINCT ref_id FROM parts WHERE name IN (SELECT name FROM nodes)")
def _(spark, sf):
    return R.known(T.refs(spark, sf), T.nodes(spark, sf)).select("ref_id")


@query("r0_external_filter", "SELECT ref_id FROM refs WHERE NOT (ref_id%15=0 AND language IN ('python','go')) AND NOT (ref_id%15=5 AND language='go') AND NOT (ref_id%15=10 AND language='python')")
def _(spark, sf):
    r = T.refs(spark, sf)
    k = F.col("ref_id") % 15
    return R.external(r.withColumn("reference_name", F.when(k == 0, "print").when(k == 5, "fmt.Println").when(k == 10, "items.append").otherwise(F.col("reference_name"))), T.nodes(spark, sf)).select("ref_id")


@query("r4_r6_exact_name", f"{_SCORED} SELECT ref_id, target, confidence FROM exact")
def _(spark, sf):
    out = R.exact_name(T.refs(spark, sf), T.nodes(spark, sf))
    return out.select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


@query("r3_qualified_name", f"{_QUALIFIED} SELECT ref_id, target, confidence FROM qual")
def _(spark, sf):
    out = R.qualified_name(T.refs(spark, sf), T.nodes(spark, sf))
    return out.select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


@query("r7_proximity", f"SELECT DISTINCT a, b, CAST({_PROX} AS BIGINT) AS score FROM (SELECT source_file AS a, target_file AS b FROM pairs)")
def _(spark, sf):
    from ..operators.aggregates import file_pairs

    return file_pairs(graph(spark, sf)).select(F.col("source_file").alias("a"), F.col("target_file").alias("b"), X.proximity("source_file", "target_file").cast("long").alias("score"))


@query("r11_fuzzy_unique", f"c AS (SELECT o_orderkey AS ref_id, n.id, n.language AS cl, CASE o_orderkey%4 WHEN 0 THEN 'java' WHEN 1 THEN 'kotlin' WHEN 2 THEN 'python' ELSE 'go' END AS rl FROM orders JOIN nodes n ON lower(n.name)='order_'||o_orderkey AND n.kind IN ('function','method','class') WHERE o_orderkey%5=0) SELECT ref_id, min(id) AS target, min(CASE WHEN cl=rl THEN 0.5 ELSE 0.3 END)::DOUBLE AS confidence FROM c GROUP BY 1 HAVING count(*)=1")
def _(spark, sf):
    r = T.refs(spark, sf).withColumn("reference_name", F.concat(F.lit("ORDER_"), F.col("ref_id").cast("string"))).withColumn("reference_kind", F.lit("calls"))
    return R.fuzzy(r, T.nodes(spark, sf)).select("ref_id", "target", F.col("confidence").cast("double").alias("confidence"))


@query("r_near_name", "a AS (SELECT DISTINCT lower(reference_name) AS low FROM refs WHERE length(reference_name)>2 AND NOT contains(reference_name,'::')), n AS (SELECT DISTINCT lower(name) AS near FROM nodes WHERE kind='method' AND length(name)>2) SELECT low, near, CAST(levenshtein(low,near) AS BIGINT) AS distance FROM a, n WHERE levenshtein(low,near)<=2")
def _(spark, sf):
    r = T.refs(spark, sf).filter("not reference_name like '%::%'")
    return R.near_name(r, T.nodes(spark, sf).filter("kind = 'method'")).select("low", "near", F.col("distance").cast("long").alias("distance"))


@query("r14_r16_resolve", f"{_QUALIFIED}, {_SCORED} SELECT ref_id, target, confidence, 'qualified-name' AS resolved_by FROM qual UNION ALL SELECT ref_id, target, confidence, 'exact-match' FROM exact WHERE ref_id NOT IN (SELECT ref_id FROM qual)")
def _(spark, sf):
    return R.resolve(graph(spark, sf, "contains", "extends")).select("ref_id", "target", "confidence", "resolved_by")


@query("r16_choose", "x AS (SELECT ref_id, 'a' AS target, CAST(0.7 AS DECIMAL(4,2)) AS confidence, 'exact-match' AS resolved_by, 0 AS s FROM refs UNION ALL SELECT ref_id, 'b', 0.95, 'qualified-name', 1 FROM refs WHERE ref_id%2=0 UNION ALL SELECT ref_id, 'c', 0.9, 'import', 2 FROM refs WHERE ref_id%3=0) SELECT ref_id, target, confidence, resolved_by FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY (resolved_by='import' AND confidence>=0.9) DESC, confidence DESC, s) AS k FROM x) WHERE k=1")
def _(spark, sf):
    r = T.refs(spark, sf).select("ref_id")

    def rows(target, conf, by, cond="true"):
        return r.filter(cond).select("ref_id", F.lit(target).alias("target"), F.lit(conf).alias("confidence"), F.lit(by).alias("resolved_by"))

    return R.choose(rows("a", 0.7, "exact-match"), rows("b", 0.95, "qualified-name", "ref_id % 2 = 0"), rows("c", 0.9, "import", "ref_id % 3 = 0"))


@query("a13_resolution_stats", f"{_QUALIFIED}, {_SCORED} SELECT 'qualified-name' AS resolved_by, count(*) AS n FROM qual UNION ALL SELECT 'exact-match', count(*) FROM exact WHERE ref_id NOT IN (SELECT ref_id FROM qual)")
def _(spark, sf):
    from ..operators.aggregates import resolution_stats

    g = graph(spark, sf)
    return resolution_stats(R.first_hit(R.qualified_name(g.refs, g.nodes), R.exact_name(g.refs, g.nodes)))


@query("r17_promoted", f"{_SCORED} SELECT r.from_node_id AS source, e.target, CASE WHEN r.reference_kind='calls' AND e.target LIKE 'method:%' THEN 'calls' ELSE r.reference_kind END AS kind FROM exact e JOIN refs r ON r.ref_id=e.ref_id")
def _(spark, sf):
    g = graph(spark, sf)
    return R.promoted(R.exact_name(g.refs, g.nodes), g).select("source", "target", "kind")


@query("r19_retryable", "f AS (SELECT ref_id, regexp_extract(reference_name,'([^.:]*)$',1) AS tail FROM refs WHERE ref_id%2=0) SELECT ref_id, 'pending' AS status FROM f WHERE tail IN (SELECT tail FROM f GROUP BY 1 HAVING count(*)<=30) AND tail IN (SELECT name FROM nodes WHERE kind='method' AND start_line%2=0)")
def _(spark, sf):
    r = T.refs(spark, sf).filter("ref_id % 2 = 0").withColumn("status", F.lit("failed"))
    return R.retryable(r, T.nodes(spark, sf).filter("kind = 'method' and start_line % 2 = 0").select("name"), 30).select("ref_id", "status")


def _types(spark, sf):
    """Customers as a class tree with orders as methods named by priority."""
    c = T.read(spark, sf, "customer")
    o = T.read(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    key = F.col("c_custkey")
    cls = c.select(F.concat(F.lit("class:"), key.cast("string")).alias("id"), F.lit("class").alias("kind"), F.concat(F.lit("C"), key.cast("string")).alias("name"), F.concat(F.lit("f"), (key % 50).cast("string"), F.lit(".java")).alias("file_path"), F.lit("java").alias("language"))
    meth = o.select(F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("method").alias("kind"), F.col("o_orderpriority").alias("name"), F.lit("m.java").alias("file_path"), F.lit("java").alias("language"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("return_type"))
    ext = c.filter("c_custkey >= 2").select(F.concat(F.lit("class:"), key.cast("string")).alias("source"), F.concat(F.lit("class:"), F.floor(key / 2).cast("string")).alias("target"), F.lit("extends").alias("kind"))
    con = o.select(F.concat(F.lit("class:"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("target"), F.lit("contains").alias("kind"))
    return Graph(conform(cls, NODES).unionByName(conform(meth, NODES)), conform(ext, EDGES).unionByName(conform(con, EDGES)))


@query("r8_r9_method", "own AS (SELECT o_custkey AS c, min('method:'||o_orderkey) AS target FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1), up(t, s, d) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT t, CAST(floor(s/2) AS BIGINT), d+1 FROM up WHERE s>=2 AND d<4) SELECT ref_id, target, CAST(0.8 AS DECIMAL(4,2)) AS confidence FROM (SELECT t AS ref_id, target, row_number() OVER (PARTITION BY t ORDER BY d, target) AS k FROM up JOIN own ON own.c=up.s) WHERE k=1", graph=False)
def _(spark, sf):
    g = _types(spark, sf)
    n = g.nodes.withColumn("name", F.when((F.col("kind") == "method") & F.col("name").startswith("1"), "urgent").otherwise(F.col("name")))
    r = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("ref_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".urgent")).alias("reference_name"), F.lit("java").alias("language"), F.lit("calls").alias("reference_kind"))
    return R.method(conform(r, REFS), Graph(n, g.edges)).select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


@query("r15_module_files", "i AS (SELECT page_id AS import_id, page_id%10 AS a, page_id%4 AS e FROM pages) SELECT import_id, CASE e WHEN 0 THEN 'lib/u'||a||'.ts' WHEN 1 THEN 'lib/u'||a||'.ts' WHEN 2 THEN 'pkg/v'||a||'/index.ts' ELSE 'shared/u'||a||'.ts' END AS path FROM i", graph=False)
def _(spark, sf):
    p = T.read(spark, sf, "pages").select(F.col("page_id").alias("import_id"), (F.col("page_id") % 10).cast("string").alias("a"), (F.col("page_id") % 4).alias("e"))
    module = F.when(F.col("e") == 0, F.concat(F.lit("./u"), "a")).when(F.col("e") == 1, F.concat(F.lit("../lib/u"), "a")).when(F.col("e") == 2, F.concat(F.lit("../pkg/v"), "a")).otherwise(F.concat(F.lit("@s/u"), "a"))
    files = spark.range(10).select(F.explode(F.array(*(F.concat(F.lit(x), F.col("id").cast("string"), F.lit(y)) for x, y in (("lib/u", ".ts"), ("pkg/v", "/index.ts"), ("shared/u", ".ts"), ("lib/u", ".js"))))).alias("path"))
    alias = spark.createDataFrame([("@s/", "shared/"), ("@", "nowhere/")], "prefix string, target string")
    return R.module_files(p.select("import_id", module.alias("module"), F.lit("lib/main.ts").alias("file_path")), files, aliases=alias)


@query("r2_j16_file_path", "r AS (SELECT doc_id AS ref_id, CASE doc_id%3 WHEN 0 THEN 'asia/nation_12/suppliers.h' WHEN 1 THEN 'nation_12/suppliers.h' ELSE 'x/only.h' END AS name FROM documents) SELECT ref_id, CASE WHEN name='x/only.h' THEN 'file:b/only.h' ELSE 'file:asia/nation_12/suppliers.h' END AS target, CAST(CASE ref_id%3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.7 END AS DECIMAL(4,2)) AS confidence FROM r", graph=False)
def _(spark, sf):
    d = T.read(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, "asia/nation_12/suppliers.h").when(F.col("doc_id") % 3 == 1, "nation_12/suppliers.h").otherwise("x/only.h")
    refs = conform(d.select(F.col("doc_id").alias("ref_id"), name.alias("reference_name"), F.lit("imports").alias("reference_kind"), F.lit("asia/main.c").alias("file_path"), F.lit("c").alias("language")), REFS)
    paths = spark.createDataFrame([("asia/nation_12/suppliers.h",), ("europe/nation_12/suppliers.h",), ("b/only.h",)], "file_path string")
    nodes = conform(paths.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.lit("file").alias("kind"), X.basename("file_path").alias("name"), F.col("file_path").alias("qualified_name"), "file_path", F.lit("c").alias("language")), NODES)
    return R.file_path(refs, nodes).select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


# -- derived edges ------------------------------------------------------------


@query("y8_y12_override", "m AS (SELECT DISTINCT 'class:'||o_custkey AS owner, o_custkey, 'method:'||o_orderkey AS id, o_orderpriority AS name FROM orders), p AS (SELECT DISTINCT b.id AS source, d.id AS target FROM customer c JOIN m b ON b.o_custkey=CAST(floor(c.c_custkey/2) AS BIGINT) JOIN m d ON d.o_custkey=c.c_custkey AND d.name=b.name WHERE c.c_custkey>=2) SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM p) WHERE k<=40", graph=False)
def _(spark, sf):
    return Y.interface_dispatch(_types(spark, sf)).select("source", "target")


@query("y2_j13_satisfies", "want AS (SELECT 'i:'||l_orderkey AS target, list_sort(list(DISTINCT l_returnflag||l_linestatus)) AS m FROM lineitem GROUP BY 1), have AS (SELECT 's:'||l_partkey AS source, list_sort(list(DISTINCT l_returnflag||l_linestatus)) AS m FROM lineitem GROUP BY 1), sets AS (SELECT DISTINCT m FROM want), r AS (SELECT sets.m, source, row_number() OVER (PARTITION BY sets.m ORDER BY source) AS k FROM sets JOIN have ON list_has_all(have.m, sets.m)) SELECT source, target FROM want JOIN r ON r.m=want.m WHERE k<=40", graph=False)
def _(spark, sf):
    li = T.read(spark, sf, "lineitem")
    name = F.concat("l_returnflag", "l_linestatus").alias("name")
    i = li.select(F.concat(F.lit("i:"), F.col("l_orderkey").cast("string")).alias("owner"), name).distinct()
    s = li.select(F.concat(F.lit("s:"), F.col("l_partkey").cast("string")).alias("owner"), name).distinct()
    both = i.unionByName(s)
    m = both.select(F.concat_ws("#", "owner", "name").alias("id"), F.lit("method").alias("kind"), "name", F.lit("a.go").alias("file_path"), F.lit("go").alias("language"))
    t = both.select(F.col("owner").alias("id"), F.when(F.col("owner").startswith("i:"), "interface").otherwise("struct").alias("kind"), F.col("owner").alias("name"), F.lit("a.go").alias("file_path"), F.lit("go").alias("language")).distinct()
    e = both.select(F.col("owner").alias("source"), F.concat_ws("#", "owner", "name").alias("target"), F.lit("contains").alias("kind"))
    return Y.satisfies(Graph(conform(m, NODES).unionByName(conform(t, NODES)), conform(e, EDGES))).select("source", "target")


@query("y5_j14_channel", "e AS (SELECT DISTINCT 'class:'||c_custkey AS id, CAST(c_custkey//5 AS VARCHAR) AS event FROM customer), h AS (SELECT DISTINCT 'interface:'||s_suppkey AS id, CAST(s_suppkey//2 AS VARCHAR) AS event FROM supplier), ee AS (SELECT * FROM e WHERE event IN (SELECT event FROM e GROUP BY 1 HAVING count(*)<=6)), hh AS (SELECT * FROM h WHERE event IN (SELECT event FROM h GROUP BY 1 HAVING count(*)<=6)) SELECT ee.id AS source, hh.id AS target, event FROM ee JOIN hh USING(event)", graph=False)
def _(spark, sf):
    c = T.read(spark, sf, "customer").select(F.concat(F.lit("class:"), F.col("c_custkey").cast("string")).alias("id"), F.expr("c_custkey div 5").cast("string").alias("event"), F.lit(1).alias("line"))
    s = T.read(spark, sf, "supplier").select(F.concat(F.lit("interface:"), F.col("s_suppkey").cast("string")).alias("id"), F.expr("s_suppkey div 2").cast("string").alias("event"))
    return Y.channel(c, s).select("source", "target", F.element_at("metadata", "event").alias("event"))


def _c_parts(spark, sf):
    p = T.read(spark, sf, "part")
    decl = F.col("p_size") % 5 == 0
    return p.select(F.concat(F.lit("f:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("function").alias("kind"), F.concat("p_brand", "p_name").alias("name"), F.concat(F.lit("p"), (F.col("p_partkey") % 9).cast("string"), F.when(decl, ".h").otherwise(".c")).alias("file_path"), F.lit("c").alias("language"), decl.alias("is_declaration"))


@query("y10_declarations", "n AS (SELECT 'f:'||p_partkey AS id, p_brand||p_name AS name, p_size%5=0 AS d FROM part), dd AS (SELECT * FROM n WHERE d), ff AS (SELECT * FROM n WHERE NOT d) SELECT dd.id AS source, ff.id AS target FROM dd JOIN ff USING(name)", graph=False)
def _(spark, sf):
    g = Graph(conform(_c_parts(spark, sf), NODES), conform(spark.createDataFrame([], "source string"), EDGES))
    return Y.declarations(g).select("source", "target")


@query("y1_receiver_contains", "SELECT 'S:'||s_suppkey AS source, 'M:'||p_partkey AS target FROM part JOIN supplier ON s_suppkey=p_partkey%20", graph=False)
def _(spark, sf):
    p, s = T.read(spark, sf, "part"), T.read(spark, sf, "supplier")
    m = p.select(F.concat(F.lit("M:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("method").alias("kind"), F.lit("run").alias("name"), F.concat(F.lit("T"), (F.col("p_partkey") % 20).cast("string"), F.lit("::run")).alias("qualified_name"), F.concat(F.lit("d"), (F.col("p_partkey") % 5).cast("string"), F.lit("/b.go")).alias("file_path"), F.lit("go").alias("language"))
    t = s.select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("struct").alias("kind"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("d"), (F.col("s_suppkey") % 5).cast("string"), F.lit("/a.go")).alias("file_path"), F.lit("go").alias("language"))
    g = Graph(conform(m, NODES).unionByName(conform(t, NODES)), conform(spark.createDataFrame([], "source string"), EDGES))
    return Y.receiver_contains(g).select("source", "target")


@query("y15_tag_children", "t AS (SELECT DISTINCT 'page:'||page_id AS source, unnest(regexp_extract_all(html,'<([a-z][a-z0-9]*)',1)) AS name FROM pages), k AS (SELECT DISTINCT name FROM t), p AS (SELECT source, 'component:'||t.name AS target FROM t) SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS r FROM p) WHERE r<=10", graph=False)
def _(spark, sf):
    pages = T.read(spark, sf, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_path"), F.col("html").alias("text"))
    names = Y.occurrences(pages, "<([a-z][a-z0-9]*)", "name").select("name").distinct()
    n = conform(names.select(F.concat(F.lit("component:"), "name").alias("id"), F.lit("component").alias("kind"), "name", F.lit("lib").alias("file_path"), F.lit("html").alias("language")), NODES)
    return Y.tag_children(Graph(n, None), pages, "<([a-z][a-z0-9]*)", 10).select("source", "target")


@query("y18_cross_platform", "n AS (SELECT DISTINCT 'm:'||p_partkey AS id, p_brand||p_type AS k, CASE p_size%2 WHEN 0 THEN 'swift' ELSE 'kotlin' END AS l FROM part), f AS (SELECT * FROM n WHERE k IN (SELECT k FROM n GROUP BY 1 HAVING count(*)<=40)) SELECT a.id AS source, b.id AS target FROM f a JOIN f b ON a.k=b.k AND a.l<>b.l", graph=False)
def _(spark, sf):
    p = T.read(spark, sf, "part")
    n = p.select(F.concat(F.lit("m:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("method").alias("kind"), F.concat("p_brand", "p_type").alias("qualified_name"), F.lit("x").alias("name"), F.lit("f").alias("file_path"), F.when(F.col("p_size") % 2 == 0, "swift").otherwise("kotlin").alias("language"))
    return Y.cross_platform(Graph(conform(n, NODES), None)).select("source", "target")


@query("y13_expect_actual", "n AS (SELECT 'm:'||p_partkey AS id, p_name AS q, p_partkey%3=0 AS e, p_partkey%7 AS f FROM part) SELECT a.id AS source, b.id AS target FROM n a JOIN n b ON a.q=b.q AND a.e AND NOT b.e AND a.f<>b.f", graph=False)
def _(spark, sf):
    p, key = T.read(spark, sf, "part"), F.col("p_partkey")
    n = p.select(F.concat(F.lit("m:"), key.cast("string")).alias("id"), F.lit("method").alias("kind"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.concat(F.lit("f"), (key % 7).cast("string")).alias("file_path"), F.lit("kotlin").alias("language"), F.array(F.when(key % 3 == 0, "expect").otherwise("actual")).alias("decorators"))
    return Y.expect_actual(Graph(conform(n, NODES), None)).select("source", "target")


@query("y20_native_component", "SELECT 'c:'||n_nationkey AS source, 'k:'||n_nationkey AS target FROM nation", graph=False)
def _(spark, sf):
    n, i = T.read(spark, sf, "nation"), F.col("n_nationkey")
    c = n.select(F.concat(F.lit("c:"), i.cast("string")).alias("id"), F.lit("component").alias("kind"), F.col("n_name").alias("name"), F.lit("a.tsx").alias("file_path"), F.lit("tsx").alias("language"))
    ending = F.element_at(F.array(*map(F.lit, Y.SUFFIXES)), (i % 5 + 1).cast("int"))
    k = n.select(F.concat(F.lit("k:"), i.cast("string")).alias("id"), F.lit("class").alias("kind"), F.concat("n_name", ending).alias("name"), F.lit("a.mm").alias("file_path"), F.lit("objc").alias("language"))
    return Y.native_component(Graph(conform(c, NODES).unionByName(conform(k, NODES)), None)).select("source", "target")


@query("y21_mapper_statements", "j AS (SELECT p_brand||'::'||p_name AS k, min('j:'||p_partkey) AS id FROM part GROUP BY 1 HAVING count(*)=1) SELECT j.id AS source, 'x:'||p_partkey AS target FROM part JOIN j ON j.k=p_brand||'::'||p_name", graph=False)
def _(spark, sf):
    p = T.read(spark, sf, "part")
    row = lambda pre, lang: p.select(F.concat(F.lit(pre), F.col("p_partkey").cast("string")).alias("id"), F.lit("method").alias("kind"), F.col("p_name").alias("name"), F.concat_ws("::", F.lit("com"), "p_brand", "p_name").alias("qualified_name"), F.lit("f").alias("file_path"), F.lit(lang).alias("language"))
    return Y.mapper_statements(Graph(conform(row("x:", "xml"), NODES).unionByName(conform(row("j:", "java"), NODES)), None)).select("source", "target")


@query("y23_paired_files", "SELECT 'form:'||n_nationkey AS source, 'unit:'||n_nationkey AS target FROM nation WHERE n_nationkey%2=0", graph=False)
def _(spark, sf):
    n, i = T.read(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    f = n.select(F.concat(F.lit("form:"), i).alias("id"), F.lit("file").alias("kind"), F.lit("f").alias("name"), F.concat("n_name", F.when(F.col("n_nationkey") % 4 == 0, ".dfm").otherwise(".fmx")).alias("file_path"), F.lit("pascal").alias("language"))
    u = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("unit:"), i).alias("id"), F.lit("file").alias("kind"), F.lit("f").alias("name"), F.concat("n_name", F.lit(".pas")).alias("file_path"), F.lit("pascal").alias("language"))
    return Y.paired_files(Graph(conform(f, NODES).unionByName(conform(u, NODES)), None)).select("source", "target")


@query("y24_page_loaders", "SELECT 'p:'||n_nationkey AS source, 'l:'||n_nationkey AS target FROM nation", graph=False)
def _(spark, sf):
    n, i = T.read(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    row = lambda pre, end: n.select(F.concat(F.lit(pre), i).alias("id"), F.lit("file").alias("kind"), F.lit("f").alias("name"), F.concat("n_name", F.lit(end)).alias("file_path"), F.lit("svelte").alias("language"))
    return Y.page_loaders(Graph(conform(row("p:", "/+page.svelte"), NODES).unionByName(conform(row("l:", "/+page.server.ts"), NODES)), None)).select("source", "target")


@query("j11_enclosing", "p AS (SELECT o_orderkey AS point_id, file_path, o_orderkey%997+2 AS line FROM orders JOIN nodes ON id='function:'||o_orderkey), h AS (SELECT point_id, n.id, row_number() OVER (PARTITION BY point_id ORDER BY n.start_line DESC, n.end_line, n.id) AS k FROM p JOIN nodes n ON n.file_path=p.file_path AND n.kind IN ('function','method') AND p.line BETWEEN n.start_line AND n.end_line) SELECT point_id, id FROM h WHERE k=1")
def _(spark, sf):
    g = graph(spark, sf, "imports")
    p = g.nodes.filter("kind = 'function'").select(F.substring_index("id", ":", -1).cast("long").alias("point_id"), "file_path", (F.col("start_line") + 1).alias("line"))
    return Y.enclosing(p, g)


@query("w5_first_pass_wins", "x AS (SELECT source, target, kind, 0 AS p FROM edges WHERE kind='extends' UNION ALL SELECT source, target, 'overrides', 1 FROM edges WHERE kind='extends' UNION ALL SELECT source, target, kind, 1 FROM edges WHERE kind='imports') SELECT source, target, kind FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY p) AS k FROM x) WHERE k=1")
def _(spark, sf):
    e = T.edges(spark, sf, ("extends",))
    return Y.merge(e, e.withColumn("kind", F.lit("overrides")).unionByName(T.edges(spark, sf, ("imports",)))).select("source", "target", "kind")


@query("y_synthesize", "p AS (SELECT DISTINCT b.id AS source, d.id AS target FROM customer c JOIN (SELECT 'method:'||o_orderkey AS id, o_custkey, o_orderpriority AS name FROM orders) b ON b.o_custkey=CAST(floor(c.c_custkey/2) AS BIGINT) JOIN (SELECT 'method:'||o_orderkey AS id, o_custkey, o_orderpriority AS name FROM orders) d ON d.o_custkey=c.c_custkey AND d.name=b.name WHERE c.c_custkey>=2) SELECT source, target, 'calls' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM p) WHERE k<=40", graph=False)
def _(spark, sf):
    return Y.synthesize(_types(spark, sf)).select("source", "target", "kind")


# -- incremental and streaming ------------------------------------------------

_OLD = "old AS (SELECT 'd'||doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id%10<>0), new AS (SELECT 'd'||doc_id AS path, sha256(CASE WHEN doc_id%7=0 THEN upper(text) ELSE text END) AS h FROM documents WHERE doc_id%11<>0)"


def _snapshots(spark, sf):
    d = T.read(spark, sf, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    h = lambda c: F.sha2(c.cast("binary"), 256).alias("content_hash")
    new = F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text"))
    return d.filter("doc_id % 10 <> 0").select("path", h(F.col("text"))), d.filter("doc_id % 11 <> 0").select("path", h(new))


@query("i7_u5_changes", f"{_OLD} SELECT coalesce(old.path,new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.path=new.path WHERE old.path IS NULL OR new.path IS NULL OR old.h<>new.h")
def _(spark, sf):
    return build.changes(*_snapshots(spark, sf))


@query("i8_rewire", "s AS (SELECT e.source, b.name, b.kind, b.file_path AS f FROM edges e JOIN nodes b ON b.id=e.target WHERE e.kind='references'), n AS (SELECT file_path AS f, name, kind, min(id||'x') AS id FROM nodes WHERE start_line%3<>0 GROUP BY ALL HAVING count(*)=1) SELECT DISTINCT s.source, n.id AS target FROM s JOIN n ON n.f=s.f AND n.name=s.name AND n.kind=s.kind")
def _(spark, sf):
    g = graph(spark, sf, "references")
    t = g.nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), F.col("file_path").alias("target_file"))
    saved = g.edges.join(t, "target").withColumn("source_file", F.lit("s"))
    new = g.nodes.filter("start_line % 3 <> 0").withColumn("id", F.concat("id", F.lit("x")))
    return build.rewire(saved, new)[0].select("source", "target").distinct()


@query("i9_resurrected", "SELECT source AS from_node_id, target AS reference_name, kind AS reference_kind, 'pending' AS status FROM edges WHERE kind='extends'")
def _(spark, sf):
    e = T.edges(spark, sf, ("extends", "imports"))
    gone = e.withColumn("metadata", F.when(F.col("kind") == "extends", F.create_map(F.lit("reference"), F.col("target"))))
    return build.resurrected(gone).select("from_node_id", "reference_name", "reference_kind", "status")


@query("i11_annotated", "SELECT id, file_path LIKE 'asia/%' AS stale FROM nodes WHERE kind='class'")
def _(spark, sf):
    n = T.nodes(spark, sf)
    return build.annotated(n.filter("kind = 'class'"), n.filter("file_path like 'asia/%'").select(F.col("file_path").alias("path"))).select("id", "stale")


@query("i13_macro_readers", "SELECT DISTINCT 'd'||doc_id AS path FROM documents WHERE list_contains(regexp_extract_all(text,'\\b([A-Z][A-Z0-9_]+)\\b',1),'MIT') OR list_contains(regexp_extract_all(text,'\\b([A-Z][A-Z0-9_]+)\\b',1),'CC')", graph=False)
def _(spark, sf):
    d = T.read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    return build.macro_readers(d, spark.createDataFrame([("MIT",), ("CC",)], "name string"))


_EVENTS = "SELECT 'user_'||user_id AS path, ts, event_type AS event FROM events"


def _events(spark, sf):
    return T.read(spark, sf, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"), "ts", F.col("event_type").alias("event"))


@query("i2_w9_bursts", f"SELECT * FROM (WITH e AS ({_EVENTS}), l AS (SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts) AS p FROM e), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts>=p+INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT path, epoch_us(min(ts))//1000 AS start_ms, epoch_us(max(ts)+INTERVAL 2 HOUR)//1000 AS end_ms, count(*) AS events FROM g GROUP BY path, s)", graph=False)
def _(spark, sf):
    return watch.bursts(_events(spark, sf), "2 hours").select("path", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "events")


@query("i3_pending", f"SELECT path, epoch_us(min(ts))//1000 AS first_ms, epoch_us(max(ts))//1000 AS last_ms FROM ({_EVENTS}) GROUP BY 1 HAVING max(ts)>(SELECT quantile_disc(ts,0.9) FROM events)", graph=False)
def _(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    started = e.select(F.expr("percentile_disc(0.9) within group (order by unix_micros(ts))").alias("t")).first()["t"]
    return watch.pending(e, F.timestamp_micros(F.lit(int(started)))).select("path", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"))


@query("i4_latest_event", f"SELECT path, epoch_us(max(ts))//1000 AS last_ms, count(*) AS n FROM ({_EVENTS}) GROUP BY 1", graph=False)
def _(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return watch.latest(e).join(e.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path").select("path", F.unix_millis("ts").alias("last_ms"), "n")


@query("udtf_route_extraction", "SELECT 'page'||page_id AS path, unnest(regexp_extract_all(html,'<a href=\"([^\"]*)\"',1)) AS name, 'link' AS kind FROM pages", graph=False)
def _(spark, sf):
    rule = S._by_pattern("links", ("html",), {"link": r'<a href="([^"]*)"'}, {})
    p = T.read(spark, sf, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    return S.extract(p, [rule]).select("path", "name", "kind")


@query("build_index", f"{_QUALIFIED}, {_SCORED}, found AS (SELECT ref_id FROM qual UNION SELECT ref_id FROM exact) SELECT kind, '' AS provenance, count(*) AS n FROM (SELECT kind FROM edges UNION ALL SELECT reference_kind FROM refs JOIN found USING (ref_id)) GROUP BY 1")
def _(spark, sf):
    g = graph(spark, sf)
    out = build.index(g)
    return out.edges.groupBy("kind", F.coalesce("provenance", F.lit("")).alias("provenance")).agg(F.count(F.lit(1)).alias("n"))
