"""Queries: imports, chains, gates, rules over text, frameworks, order and terms.

Sources that the tables do not have (statements, signatures, templates) are made
from their keys, one for each row of the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.cpp import parameter_key, without_comments
from ..operators import aggregates as A
from ..operators import context as C
from ..operators import imports as I
from ..operators import resolve as R
from ..operators import search as S
from ..operators import storage as W
from ..operators import synth as Y
from ..operators import traverse as V
from ..schema import EDGES, FILES, NODES, REFS, Graph, conform
from ..sources import files as SF
from ..sources import frameworks as FW
from ..sources import tables as T
from ..streaming import watch
from . import build
from .q_graph import graph
from .q_rules import _types
from .registry import query


def key(name):
    return F.col(name).cast("string")


def text(*parts):
    """Literals and columns (given as Column) put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def rows(df, schema, **columns):
    return conform(df.select(*((F.lit(v) if not hasattr(v, "alias") else v).alias(k) for k, v in columns.items())), schema)


def no_edges(spark):
    return conform(spark.createDataFrame([], "source string"), EDGES)


def two(*names):
    return [F.col(n) for n in names]


# -- order, filters, storage --------------------------------------------------


@query("l6_structural_priority", "SELECT kind, CAST(CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END AS INT) AS priority, count(*) AS n FROM edges GROUP BY ALL")
def _(spark, sf):
    return V.structural(graph(spark, sf).edges).groupBy("kind", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("l8_tree_order", "p AS (SELECT path, string_split(path,'/') AS s FROM files), a AS (SELECT path, false AS directory, s FROM p UNION SELECT array_to_string(s[1:k],'/'), true, s[1:k] FROM (SELECT s, unnest(range(1,len(s))) AS k FROM p)) SELECT path, directory, CAST(len(s)-1 AS INT) AS depth, array_to_string(list_transform(s, lambda x, i: CASE WHEN i=len(s) AND NOT directory THEN '1' ELSE '0' END||x),'/') AS place FROM a")
def _(spark, sf):
    return C.tree_rows(graph(spark, sf).files)


@query("l9_definitions_first", "SELECT id, row_number() OVER (PARTITION BY name ORDER BY is_declaration, length(name), name, qualified_name, kind, file_path, start_line, id)::INT AS place FROM nodes")
def _(spark, sf):
    return A.definitions_first(T.nodes(spark, sf)).select("id", "place")


@query("u2_filter_intersection", "SELECT id FROM nodes WHERE kind='class' ORDER BY is_declaration, length(name), name, qualified_name, kind, file_path, start_line, id LIMIT 20")
def _(spark, sf):
    return S.search(graph(spark, sf), "kind:class kind:interface", kinds=["class", "method"]).select("id")


@query("u2_empty_intersection", "SELECT id FROM nodes WHERE false")
def _(spark, sf):
    return S.search(graph(spark, sf), "kind:class asia", kinds=["method"]).select("id")


@query("u4_impact_of_overloads", "s AS (SELECT unnest(['interface:3','interface:4','interface:5']) AS id), r AS (SELECT id, 0 AS depth FROM s UNION ALL SELECT source, 1 FROM edges WHERE kind<>'contains' AND target IN (SELECT id FROM s)) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, sf):
    return V.impact_of_all(graph(spark, sf), ["interface:3", "interface:4", "interface:5", "interface:3"], 1)[0]


@query("s12_snapshot", "SELECT 'nodes' AS part, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'refs', count(*) FROM refs")
def _(spark, sf):
    at = W.save(graph(spark, sf), f"{W.shared_folder(spark)}/snapshots")
    back = W.load(spark, at)
    parts = [getattr(back, p).agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ("nodes", "edges", "files", "refs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s15_insert_refs", "SELECT ref_id, reference_name, 'pending' AS status FROM refs")
def _(spark, sf):
    r = T.refs(spark, sf)
    held = r.filter("ref_id % 2 = 0")
    return W.insert_refs(held, r.withColumn("status", F.lit("new"))).select("ref_id", "reference_name", "status")


# -- chains, gates, receivers -------------------------------------------------

_UP = "own AS (SELECT o_custkey AS c, min('method:'||o_orderkey) AS target FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1), up(t, s, d) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT t, CAST(floor(s/2) AS BIGINT), d+1 FROM up WHERE s>=2 AND d<4), near AS (SELECT t, target FROM (SELECT t, target, row_number() OVER (PARTITION BY t ORDER BY d, target) AS k FROM up JOIN own ON own.c=up.s) WHERE k=1)"


def _chained(spark, sf):
    """Orders as methods: those of the first priority are ``urgent``, the others have
    names of their own; each returns the class of its customer."""
    g = _types(spark, sf)
    k = F.substring_index("id", ":", -1)
    n = g.nodes.withColumn("name", F.when(F.col("kind") != "method", F.col("name")).when(F.col("name").startswith("1"), "urgent").otherwise(F.concat(F.lit("make"), k)))
    o = T.read(spark, sf, "orders").filter(~F.col("o_orderpriority").startswith("1"))
    refs = rows(o, REFS, ref_id=F.col("o_orderkey"), reference_name=text("make", key("o_orderkey"), "().urgent"), reference_kind="calls", language="java", file_path="m.java")
    return Graph(n, g.edges, None, refs)


@query("r10_chains", f"{_UP} SELECT o_orderkey AS ref_id, target, CAST(0.85 AS DECIMAL(4,2)) AS confidence FROM orders JOIN near ON t=o_custkey WHERE o_orderpriority NOT LIKE '1%'")
def _(spark, sf):
    g = _chained(spark, sf)
    return R.chain(g.refs, g).select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


@query("r10a_return_types", "SELECT DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'make'||o_orderkey END AS inner_name, 'C'||o_custkey AS type_name FROM orders", graph=False)
def _(spark, sf):
    return R.return_types(_chained(spark, sf))


@query("r18_conformance", f"{_UP} SELECT o_orderkey AS ref_id, target, 'chain' AS resolved_by FROM orders JOIN near ON t=o_custkey WHERE o_orderpriority NOT LIKE '1%'")
def _(spark, sf):
    g = _chained(spark, sf)
    return R.conformance(g, g.refs).select("ref_id", "target", "resolved_by")


@query("r8b_field_receivers", "SELECT o_orderkey AS ref_id, 'T'||(o_custkey%10) AS type_name FROM orders", graph=False)
def _(spark, sf):
    c, o = T.read(spark, sf, "customer"), T.read(spark, sf, "orders")
    kotlin = F.col("c_custkey") % 2 == 0
    typed = text("T", (F.col("c_custkey") % 10).cast("string"))
    signature = F.when(kotlin, text("val helper: ", typed, "<Int> = x")).otherwise(text("private final ", typed, " helper = null;"))
    fields = rows(c, NODES, id=text("f:", key("c_custkey")), kind="field", name="helper", file_path="f", language=F.when(kotlin, "kotlin").otherwise("java"), signature=signature)
    inside = rows(c, EDGES, source=text("class:", key("c_custkey")), target=text("f:", key("c_custkey")), kind="contains")
    own = rows(o, EDGES, source=text("class:", key("o_custkey")), target=text("m:", key("o_orderkey")), kind="contains")
    refs = rows(o, REFS, ref_id=F.col("o_orderkey"), from_node_id=text("m:", key("o_orderkey")), reference_name=F.when(F.col("o_orderkey") % 2 == 0, "this.helper.run").otherwise("helper.run"))
    return R.receivers_by_field(refs, Graph(fields, inside.unionByName(own)))


@query("r8a_receiver_types", "SELECT 'm:'||p_partkey AS id, unnest(['a','b','c']) AS receiver, unnest(['T'||(p_partkey%7), 'Pool', 'Node']) AS type_name FROM part", graph=False)
def _(spark, sf):
    p = T.read(spark, sf, "part")
    return FW.receiver_types(p.select(text("m:", key("p_partkey")).alias("id"), text("T", (F.col("p_partkey") % 7).cast("string"), " a; Pool* b = 0; auto c = Node(1); Late a;").alias("text")))


@query("r13_constructible", "SELECT s_suppkey AS ref_id, 'n:'||s_suppkey AS target FROM supplier WHERE (s_suppkey%6=0) OR (s_suppkey%6=1 AND s_suppkey%4=1) OR (s_suppkey%6=2)", graph=False)
def _(spark, sf):
    s, k = T.read(spark, sf, "supplier"), F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("class", "interface", "struct", "protocol", "enum", "trait")))
    language = F.when(k % 4 == 1, "java").otherwise("kotlin")
    n = rows(s, NODES, id=text("n:", key("s_suppkey")), kind=F.element_at(kinds, (k % 6 + 1).cast("int")), name=F.col("s_name"), qualified_name=F.col("s_name"), file_path="a/b", language=language)
    r = rows(s, REFS, ref_id=k, reference_name=F.col("s_name"), reference_kind="instantiates", file_path="a/c", language=language)
    return R.exact_name(r, n).select("ref_id", "target")


@query("r6_decorates", "SELECT s_suppkey AS ref_id, CASE WHEN s_suppkey%2=0 THEN 'm:' ELSE 'i:' END||s_suppkey AS target FROM supplier", graph=False)
def _(spark, sf):
    s, k = T.read(spark, sf, "supplier"), F.col("s_suppkey")

    def one(prefix, kind):
        return rows(s, NODES, id=text(prefix, key("s_suppkey")), kind=kind, name=F.col("s_name"), qualified_name=F.col("s_name"), file_path="a/b", language="java")

    # a method against an interface, an interface against a variable
    n = one("m:", "method").filter("cast(split(id, ':')[1] as int) % 2 = 0").unionByName(one("i:", "interface")).unionByName(one("v:", "variable"))
    r = rows(s, REFS, ref_id=k, reference_name=F.col("s_name"), reference_kind="decorates", file_path="a/c", language="java")
    return R.exact_name(r, n).select("ref_id", "target")


@query("r_hot_names", "n AS (SELECT 'n:'||p_partkey AS id, p_partkey AS k, 'd'||(p_partkey%3)||'/e'||(p_partkey%5)||'/f'||(p_partkey%40) AS path, CASE p_partkey%2 WHEN 0 THEN 'java' ELSE 'go' END AS lang FROM part), r AS (SELECT s_suppkey AS ref_id, 'd'||(s_suppkey%3)||'/e'||(s_suppkey%5)||'/g'||(s_suppkey%40) AS path FROM supplier), c AS (SELECT ref_id, id, (CASE WHEN split_part(r.path,'/',1)=split_part(n.path,'/',1) THEN 15 + CASE WHEN split_part(r.path,'/',2)=split_part(n.path,'/',2) THEN 15 ELSE 0 END ELSE 0 END) + CASE WHEN lang='java' THEN 50 ELSE -80 END + 25 AS score, n.path AS p FROM r, n) SELECT ref_id, target FROM (SELECT ref_id, id AS target, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, p, id) AS k FROM c) WHERE k=1")
def _(spark, sf):
    p, s = T.read(spark, sf, "part"), T.read(spark, sf, "supplier")

    def path(k, last):
        return text("d", (F.col(k) % 3).cast("string"), "/e", (F.col(k) % 5).cast("string"), last, (F.col(k) % 40).cast("string"))

    n = rows(p, NODES, id=text("n:", key("p_partkey")), kind="function", name="get", qualified_name="get", file_path=path("p_partkey", "/f"), language=F.when(F.col("p_partkey") % 2 == 0, "java").otherwise("go"))
    r = rows(s, REFS, ref_id=F.col("s_suppkey"), reference_name="get", reference_kind="calls", file_path=path("s_suppkey", "/g"), language="java")
    return R.exact_name(r, n).select("ref_id", "target")


@query("r23_final_gates", "SELECT s_suppkey AS ref_id FROM supplier WHERE s_suppkey%3<>0 AND s_suppkey%3<>2", graph=False)
def _(spark, sf):
    s, k = T.read(spark, sf, "supplier"), F.col("s_suppkey")
    kinds = F.when(k % 3 == 0, "references").when(k % 3 == 1, "instantiates").otherwise("instantiates")
    n = rows(s, NODES, id=text("n:", key("s_suppkey")), kind=F.when(k % 3 == 2, "enum").otherwise("class"), name="x", file_path="f", language=F.when(k % 3 == 0, "swift").otherwise("java"))
    r = rows(s, REFS, ref_id=k, reference_name="x", reference_kind=kinds, file_path="f", language="java")
    found = s.select(k.alias("ref_id"), text("n:", key("s_suppkey")).alias("target"), F.lit(0.9).alias("confidence"), F.lit("exact-match").alias("resolved_by"))
    return R.final_gates(found, Graph(n, None, None, r)).select("ref_id")


@query("r20_parameter_keys", "SELECT p_partkey AS id, CASE p_partkey%4 WHEN 0 THEN 'int,T&' WHEN 1 THEN '' WHEN 2 THEN 'std::map<K,V>*' ELSE 'double' END AS k FROM part", graph=False)
def _(spark, sf):
    p, k = T.read(spark, sf, "part"), F.col("p_partkey")
    signature = F.when(k % 4 == 0, "void run(const int a, T & b)").when(k % 4 == 1, "void run(void)").when(k % 4 == 2, "auto run(std::map<K, V> *m = nullptr)").otherwise("bool operator()(double)")
    name = F.when(k % 4 == 3, "operator()").otherwise("run")
    return p.select(k.alias("id"), signature.alias("s"), name.alias("n")).select("id", parameter_key("s", "n").alias("k"))


@query("r22_selectors", "SELECT n_nationkey AS id, 'setName'||n_nationkey||':' AS setter, 'name'||n_nationkey AS property, 'tableView' AS base, 'loadWithItem:at:,loadItem:at:,load:item:at:' AS selectors FROM nation", graph=False)
def _(spark, sf):
    n = T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), text("name", key("n_nationkey")).alias("name"))
    setter = FW.property_setter(F.col("name"))
    picks = FW.selectors_of(F.lit("load"), F.array(F.lit("item"), F.lit("at")))
    return n.select("id", setter.alias("setter"), FW.setter_property(setter).alias("property"), FW.selector_base(F.lit("tableViewWithStyle:")).alias("base"), F.array_join(picks, ",").alias("selectors"))


# -- imports ------------------------------------------------------------------


def _modules(df, id_, module, path="src/main.ts"):
    return df.select(id_.alias("import_id"), (F.lit(module) if isinstance(module, str) else module).alias("module"), (F.lit(path) if isinstance(path, str) else path).alias("file_path"))


def _paths(df, *parts):
    out = None
    for p in parts:
        one = df.select(p.alias("path"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


@query("r15b_external_modules", "SELECT n_nationkey AS import_id, CASE n_nationkey%4 WHEN 1 THEN 'lib'||n_nationkey ELSE '@org/pkg'||n_nationkey END AS package FROM nation WHERE n_nationkey%4 IN (1,2)", graph=False)
def _(spark, sf):
    n, k, i = T.read(spark, sf, "nation"), key("n_nationkey"), F.col("n_nationkey")
    m = _modules(n, i, F.when(i % 4 == 0, text("./a", k)).when(i % 4 == 1, text("lib", k, "/part")).when(i % 4 == 2, text("@org/pkg", k, "/x/y")).otherwise(text("own/b", k)))
    found = R.module_files(m, _paths(n, text("src/a", k, ".ts"), text("own/b", k, ".ts")))
    return I.external_modules(m, found)


@query("r15d_aliases", "SELECT s_suppkey AS import_id, CASE WHEN s_suppkey%2=0 THEN 'app/shared/u'||s_suppkey||'.ts' ELSE 'app/u'||s_suppkey||'.ts' END AS path FROM supplier", graph=False)
def _(spark, sf):
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    even = F.col("s_suppkey") % 2 == 0
    aliases = spark.createDataFrame([("~/", "app/"), ("~/shared/", "app/shared/"), ("~", "nowhere/")], "prefix string, target string")
    files = _paths(s, text("app/u", k, ".ts"), text("app/shared/u", k, ".ts"))
    return R.module_files(_modules(s, F.col("s_suppkey"), F.when(even, text("~/shared/u", k)).otherwise(text("~/u", k))), files, aliases=aliases)


@query("r15e_workspaces", "SELECT n_nationkey AS import_id, CASE n_nationkey%2 WHEN 0 THEN 'packages/p'||n_nationkey||'/index.ts' ELSE 'packages/p'||n_nationkey||'/sub/x.ts' END AS path FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    packages = n.select(text("@org/p", k).alias("name"), text("packages/p", k).alias("directory"))
    m = _modules(n, F.col("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, text("@org/p", k)).otherwise(text("@org/p", k, "/sub/x")))
    return R.module_files(m, _paths(n, text("packages/p", k, "/index.ts"), text("packages/p", k, "/sub/x.ts")), aliases=I.workspace_aliases(packages))


@query("r15f_go_packages", "SELECT n_nationkey AS import_id, CASE WHEN n_nationkey%3=0 THEN 'tools/pkg'||n_nationkey ELSE 'pkg'||n_nationkey END AS directory FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    roots = spark.createDataFrame([("example.com/mod", ""), ("example.com/mod/tools", "tools")], "prefix string, directory string")
    third = F.col("n_nationkey") % 3 == 0
    m = _modules(n, F.col("n_nationkey"), F.when(third, text("example.com/mod/tools/pkg", k)).otherwise(text("example.com/mod/pkg", k)), "main.go")
    return I.go_packages(m, roots, _paths(n, text("pkg", k, "/a.go"), text("tools/pkg", k, "/b.go")))


@query("r15f_go_members", "SELECT n_nationkey AS ref_id, 'f:'||n_nationkey AS target FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    nodes = rows(n, NODES, id=text("f:", k), kind="function", name=text("Run", k), file_path=text("pkg", k, "/a.go"), language="go")
    refs = rows(n, REFS, ref_id=F.col("n_nationkey"), reference_name=text("p", k, ".Run", k), file_path="main.go", language="go")
    used = n.select(F.lit("main.go").alias("file_path"), text("p", k).alias("local"), text("pkg", k).alias("directory"))
    return I.go_members(refs, used, nodes).select("ref_id", "target")


@query("r15g_includes", "SELECT s_suppkey AS ref_id, CASE WHEN s_suppkey%2=0 THEN 'src/h'||s_suppkey||'.h' ELSE 'include/h'||s_suppkey||'.h' END AS path, CAST(CASE WHEN s_suppkey%2=0 THEN 0.92 ELSE 0.9 END AS DECIMAL(4,2)) AS confidence FROM supplier", graph=False)
def _(spark, sf):
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    beside = s.filter("s_suppkey % 2 = 0")
    refs = rows(s, REFS, ref_id=F.col("s_suppkey"), reference_name=text("h", k, ".h"), reference_kind="imports", file_path="src/a.c", language="c")
    files = _paths(s, text("include/h", k, ".h")).unionByName(_paths(beside, text("src/h", k, ".h")))
    return R.included(refs, files, ("include",)).select("ref_id", "path", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


@query("r15h_php_includes", "SELECT n_nationkey AS import_id, CASE n_nationkey%3 WHEN 0 THEN 'web/i'||n_nationkey||'.php' ELSE 'lib/i'||n_nationkey||'.php' END AS path FROM nation WHERE n_nationkey%3<>2", graph=False)
def _(spark, sf):
    n, k, i = T.read(spark, sf, "nation"), key("n_nationkey"), F.col("n_nationkey")
    m = _modules(n, i, F.when(i % 3 == 0, text("i", k, ".php")).when(i % 3 == 1, text("lib/i", k, ".php")).otherwise(text("gone", k, ".php")), "web/index.php")
    return I.php_includes(m, _paths(n, text("web/i", k, ".php"), text("lib/i", k, ".php")))


_BINDINGS = """x AS (SELECT n_nationkey AS k FROM nation) SELECT 'f'||k||'.ts' AS file_path, unnest(['b'||k,'c','Main','ns','q']) AS local, unnest(['a'||k,'c','default','*','*']) AS exported, unnest(['./m'||k,'./m'||k,'./m'||k,'./all','req'||k]) AS module FROM x WHERE k%5=0
UNION ALL SELECT 'f'||k||'.py', unnest(['b'||k,'c','os.path']), unnest(['a'||k,'c','*']), unnest(['pkg.m'||k,'pkg.m'||k,'os.path']) FROM x WHERE k%5=1
UNION ALL SELECT 'f'||k||'.go', unnest(['m'||k,'al']), '*', unnest(['ex.com/m'||k,'ex.com/other']) FROM x WHERE k%5=2
UNION ALL SELECT 'f'||k||'.java', 'A'||k, 'A'||k, 'com.x.A'||k FROM x WHERE k%5=3
UNION ALL SELECT 'f'||k||'.php', unnest(['A'||k,'Z']), unnest(['A'||k,'B'||k]), unnest(['App\\A'||k,'App\\B'||k]) FROM x WHERE k%5=4"""


@query("r15i_bindings", _BINDINGS, graph=False)
def _(spark, sf):
    n, k, i = T.read(spark, sf, "nation"), key("n_nationkey"), F.col("n_nationkey")
    code = (
        F.when(i % 5 == 0, text("import { a", k, " as b", k, ", c } from './m", k, "'\nimport Main from './m", k, "'\nimport * as ns from './all'\nconst q = require('req", k, "')\n"))
        .when(i % 5 == 1, text("from pkg.m", k, " import a", k, " as b", k, ", c\nimport os.path\n"))
        .when(i % 5 == 2, text("import (\n\t\"ex.com/m", k, "\"\n\tal \"ex.com/other\"\n)\n"))
        .when(i % 5 == 3, text("import com.x.A", k, ";\n"))
        .otherwise(text("use App\\A", k, ";\nuse App\\B", k, " as Z;\n"))
    )
    ends = F.array(*map(F.lit, (".ts", ".py", ".go", ".java", ".php")))
    langs = F.array(*map(F.lit, ("typescript", "python", "go", "java", "php")))
    at = (i % 5 + 1).cast("int")
    return I.bindings(n.select(text("f", k, F.element_at(ends, at)).alias("file_path"), F.element_at(langs, at).alias("language"), code.alias("text")))


@query("r15j_reexports", "SELECT s_suppkey AS ref_id, 'n:'||s_suppkey AS target, CAST(CASE WHEN s_suppkey%2=0 THEN 0.92 ELSE 0.9 END AS DECIMAL(4,2)) AS confidence FROM supplier", graph=False)
def _(spark, sf):
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    odd = s.filter("s_suppkey % 2 = 1")
    nodes = rows(s, NODES, id=text("n:", k), kind="function", name=text("fn", k), file_path=text("lib/deep", k, ".ts"), language="typescript", is_exported=True)
    refs = rows(s, REFS, ref_id=F.col("s_suppkey"), reference_name=text("use", k), reference_kind="calls", file_path="src/main.ts", language="typescript")
    straight = F.col("s_suppkey") % 2 == 0
    mapping = s.select(F.lit("src/main.ts").alias("file_path"), text("use", k).alias("local"), F.when(straight, text("fn", k)).otherwise(text("pub", k)).alias("exported"), F.when(straight, text("lib/deep", k, ".ts")).otherwise(text("lib/index", k, ".ts")).alias("path"))
    contents = odd.select(text("lib/index", k, ".ts").alias("file_path"), F.lit("typescript").alias("language"), text("export { fn", k, " as pub", k, " } from './mid", k, "'\n").alias("text"))
    contents = contents.unionByName(odd.select(text("lib/mid", k, ".ts").alias("file_path"), F.lit("typescript").alias("language"), text("export * from './deep", k, "'\nexport * from './mid", k, "'\n").alias("text")))
    again = I.reexports(contents)
    chased = again.select(F.col("file_path").alias("path"), "exported", text("lib/", F.substr("module", F.lit(3)), ".ts").alias("to_path"), F.col("name").alias("to_name"))
    return R.imported(refs, mapping, nodes, chased).select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


@query("r15k_jvm_imports", "SELECT n_nationkey AS import_id, CASE WHEN n_nationkey%2=0 THEN 'q:' ELSE 'p:' END||n_nationkey AS target FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    name = text("T", k)
    even, odd = n.filter("n_nationkey % 2 = 0"), n
    q = rows(even, NODES, id=text("q:", k), kind="class", name=name, qualified_name=text("com::a::T", k), file_path="x.java", language="java")
    p = rows(odd, NODES, id=text("p:", k), kind="class", name=name, qualified_name=name, file_path=text("main/com/a/T", k, ".kt"), language="kotlin")
    o = rows(n, NODES, id=text("o:", k), kind="class", name=name, qualified_name=text("org::T", k), file_path="org/T.java", language="java")
    return I.jvm_imports(_modules(n, F.col("n_nationkey"), text("com.a.T", k)), q.unionByName(p).unionByName(o))


@query("r15l_python_modules", "SELECT n_nationkey AS import_id, CASE n_nationkey%3 WHEN 0 THEN 'pkg/m'||n_nationkey||'.py' WHEN 1 THEN 'pkg/d'||n_nationkey||'/__init__.py' ELSE 'app/n'||n_nationkey||'.py' END AS path FROM nation", graph=False)
def _(spark, sf):
    n, k, i = T.read(spark, sf, "nation"), key("n_nationkey"), F.col("n_nationkey")
    m = _modules(n, i, F.when(i % 3 == 0, text("pkg.m", k)).when(i % 3 == 1, text("pkg.d", k)).otherwise(text("..n", k)), "app/sub/main.py")
    return I.python_modules(m, _paths(n, text("pkg/m", k, ".py"), text("pkg/d", k, "/__init__.py"), text("app/n", k, ".py")))


@query("r15m_rust_paths", "SELECT n_nationkey AS import_id, CASE n_nationkey%3 WHEN 0 THEN 'src/a'||n_nationkey||'/mod.rs' WHEN 1 THEN 'src/net/b'||n_nationkey||'.rs' ELSE 'src/c'||n_nationkey||'.rs' END AS path FROM nation", graph=False)
def _(spark, sf):
    n, k, i = T.read(spark, sf, "nation"), key("n_nationkey"), F.col("n_nationkey")
    m = _modules(n, i, F.when(i % 3 == 0, text("crate::a", k, "::Item")).when(i % 3 == 1, text("self::b", k, "::f")).otherwise(text("super::c", k)), "src/net.rs")
    return I.rust_paths(m, _paths(n, text("src/a", k, "/mod.rs"), text("src/net/b", k, ".rs"), text("src/c", k, ".rs")))


@query("r15n_lua_requires", "SELECT n_nationkey AS import_id, CASE WHEN n_nationkey%2=0 THEN 'game/m'||n_nationkey||'.lua' ELSE 'game/m'||n_nationkey||'/init.lua' END AS path FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    files = _paths(n.filter("n_nationkey % 2 = 0"), text("game/m", k, ".lua")).unionByName(_paths(n, text("game/m", k, "/init.lua")))
    return I.lua_requires(_modules(n, F.col("n_nationkey"), text("game.m", k), "main.lua"), files)


@query("r15o_whole_modules", "SELECT n_nationkey AS import_id, 'file:'||n_nationkey AS target FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    nodes = rows(n, NODES, id=text("file:", k), kind="file", name=text("m", k), file_path=text("src/m", k, ".ts"), language="typescript")
    found = R.module_files(_modules(n, F.col("n_nationkey"), text("./m", k)), nodes.select(F.col("file_path").alias("path")))
    return I.module_nodes(found, nodes)


@query("r21_razor_usings", "x AS (SELECT n_nationkey AS k, 'Pages/r'||n_regionkey||'/p'||n_nationkey||'.razor' AS path, n_regionkey AS r FROM nation) SELECT path, 'App' AS namespace FROM x UNION ALL SELECT path, 'App.R'||r FROM x UNION ALL SELECT path, 'Own'||k FROM x WHERE k%2=0", graph=False)
def _(spark, sf):
    n, k, r = T.read(spark, sf, "nation"), key("n_nationkey"), key("n_regionkey")
    path = text("Pages/r", r, "/p", k, ".razor")
    declared = spark.createDataFrame([("_Imports.razor", "App"), ("Other/_Imports.razor", "No")], "path string, namespace string")
    declared = declared.unionByName(n.select(text("Pages/r", r, "/_Imports.razor").alias("path"), text("App.R", r).alias("namespace"))).unionByName(n.filter("n_nationkey % 2 = 0").select(path.alias("path"), text("Own", k).alias("namespace")))
    return I.usings(n.select(path.alias("path")), declared)


# -- rules over text ----------------------------------------------------------


def _pairs(spark, sf, language, first, second, kind="method", names=("a", "b")):
    """A graph of two callables a supplier, a:k and b:k in file k, with their texts."""
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    path = text("f", k)
    n = rows(s, NODES, id=text("a:", k), kind=kind, name=first[0], file_path=path, language=language).unionByName(rows(s, NODES, id=text("b:", k), kind=kind, name=second[0], file_path=path, language=language))
    t = s.select(text("a:", k).alias("id"), path.alias("file_path"), first[1].alias("text")).unionByName(s.select(text("b:", k).alias("id"), path.alias("file_path"), second[1].alias("text")))
    return Graph(n, no_edges(spark)), t


_AB = "SELECT 'a:'||s_suppkey AS source, 'b:'||s_suppkey AS target FROM supplier"


@query("y3_observers", _AB, graph=False)
def _(spark, sf):
    k = key("s_suppkey")
    g, t = _pairs(spark, sf, "typescript", ("doEmit", text("for (const f of this.subs", k, ") f()")), ("addListener", text("this.subs", k, ".push(x)")))
    return Y.observers(t, g).select("source", "target")


@query("y4_closures", _AB, graph=False)
def _(spark, sf):
    k = key("s_suppkey")
    g, t = _pairs(spark, sf, "javascript", ("run", text("for (const f of hooks", k, ") f()")), ("add", text("hooks", k, ".push(x)")))
    return Y.closures(t, g).select("source", "target")


@query("y5_event_emitter", "SELECT 'a:'||s_suppkey AS source, 'b:'||s_suppkey AS target, 'e'||s_suppkey AS event FROM supplier", graph=False)
def _(spark, sf):
    k = key("s_suppkey")
    g, t = _pairs(spark, sf, "javascript", ("send", text("bus.emit('e", k, "', 1)")), (text("hear", k), text("bus.on('e", k, "', hear", k, ")")))
    return Y.event_emitter(g, t).select("source", "target", F.element_at("metadata", "event").alias("event"))


def _siblings(spark, sf, language, setter, render):
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    g, _ = _pairs(spark, sf, language, ("change", F.lit("")), (render, F.lit("")))
    e = rows(s, EDGES, source=text("c:", k), target=text("a:", k), kind="contains").unionByName(rows(s, EDGES, source=text("c:", k), target=text("b:", k), kind="contains"))
    r = rows(s, REFS, ref_id=F.col("s_suppkey"), from_node_id=text("a:", k), reference_name=setter)
    return Graph(g.nodes, e, None, r)


@query("y6_react_rerender", _AB, graph=False)
def _(spark, sf):
    return Y.sibling_render(_siblings(spark, sf, "tsx", "this.setState", "render")).select("source", "target")


@query("y7_flutter_rebuild", _AB, graph=False)
def _(spark, sf):
    return Y.flutter_rebuild(_siblings(spark, sf, "dart", "setState", "build")).select("source", "target")


@query("y9_cpp_declarations", "SELECT 'd:'||p_partkey||':'||s AS source, 'x:'||p_partkey||':'||s AS target FROM part, (VALUES ('int'),('double')) v(s)", graph=False)
def _(spark, sf):
    p = T.read(spark, sf, "part").withColumn("s", F.explode(F.array(F.lit("int"), F.lit("double"))))
    k, name = text(key("p_partkey"), ":", F.col("s")), text("run", key("p_partkey"))
    signature = text("void ", name, "(", F.col("s"), " a)")
    d = rows(p, NODES, id=text("d:", k), kind="method", name=name, qualified_name=text("T::", name), file_path="a.hpp", language="cpp", is_declaration=True, signature=signature)
    x = rows(p, NODES, id=text("x:", k), kind="method", name=name, qualified_name=text("ns::T::", name), file_path="a.cpp", language="cpp", is_declaration=False, signature=signature)
    return Y.cpp_declarations(Graph(d.unionByName(x), no_edges(spark))).select("source", "target")


@query("y11_variable_declarations", "SELECT 'd:'||p_partkey AS source, 'x:'||p_partkey AS target FROM part", graph=False)
def _(spark, sf):
    p, k = T.read(spark, sf, "part"), key("p_partkey")
    one = lambda pre, path, declared: rows(p, NODES, id=text(pre, k), kind="variable", name=text("v", k), file_path=path, language="c", is_declaration=declared)
    return Y.variable_declarations(Graph(one("d:", "a.h", True).unionByName(one("x:", "a.c", False)), no_edges(spark))).select("source", "target")


@query("y14_grpc_stubs", "SELECT 't:'||n_nationkey AS source, 'i:'||n_nationkey AS target FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    m = n.withColumn("j", F.explode(F.array(F.lit("Get"), F.lit("Put"))))
    name = text(F.col("j"), k)
    i = rows(n, NODES, id=text("i:", k), kind="interface", name=text("S", k, "Server"), file_path="api_grpc.pb.go", language="go")
    t = rows(n, NODES, id=text("t:", k), kind="struct", name=text("impl", k), file_path="impl.go", language="go")
    im = rows(m, NODES, id=text("im:", name), kind="method", name=name, file_path="api_grpc.pb.go", language="go")
    tm = rows(m, NODES, id=text("tm:", name), kind="method", name=name, file_path="impl.go", language="go")
    e = rows(m, EDGES, source=text("i:", k), target=text("im:", name), kind="contains").unionByName(rows(m, EDGES, source=text("t:", k), target=text("tm:", name), kind="contains"))
    return Y.stub_implementation(Graph(i.unionByName(t).unionByName(im).unionByName(tm), e)).select("source", "target")


@query("y16_vue_templates", "SELECT 'v:'||n_nationkey AS source, unnest(['c:'||n_nationkey,'h:'||n_nationkey]) AS target FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    c = rows(n, NODES, id=text("c:", k), kind="component", name=text("MyBox", k), file_path="box.vue", language="vue")
    h = rows(n, NODES, id=text("h:", k), kind="function", name=text("save", k), file_path=text("v", k, ".vue"), language="vue")
    t = n.select(text("v:", k).alias("id"), text("v", k, ".vue").alias("file_path"), text("<template><my-box", k, " @click=\"save", k, "\"/></template>").alias("text"))
    return Y.vue_template(Graph(c.unionByName(h), no_edges(spark)), t).select("source", "target")


@query("y17_native_events", _AB, graph=False)
def _(spark, sf):
    k = key("s_suppkey")
    g, t = _pairs(spark, sf, "objc", ("send", text("[self sendEventWithName:@\"e", k, "\" body:x]")), ("hear", text("emitter.addListener('e", k, "', f)")))
    return Y.native_events(g, t.filter("id like 'a:%'"), t.filter("id like 'b:%'")).select("source", "target")


@query("y19_called_across_platforms", "SELECT 'a:'||s_suppkey AS source, 'b:'||s_suppkey AS target FROM supplier WHERE s_suppkey%2=0 UNION ALL SELECT 'b:'||s_suppkey, 'a:'||s_suppkey FROM supplier WHERE s_suppkey%2=0", graph=False)
def _(spark, sf):
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    one = lambda pre, language: rows(s, NODES, id=text(pre, k), kind="method", name="x", qualified_name=text("Mod.run", k), file_path="f", language=language)
    js = conform(spark.createDataFrame([("js", "function", "f", "a.ts", "typescript")], "id string, kind string, name string, file_path string, language string"), NODES)
    e = rows(s.filter("s_suppkey % 2 = 0"), EDGES, source="js", target=text("a:", k), kind="calls")
    return Y.cross_platform(Graph(one("a:", "swift").unionByName(one("b:", "kotlin")).unionByName(js), e), called_from=("typescript",)).select("source", "target")


@query("y22_middleware", "SELECT 'next' AS source, 'h:'||n_nationkey AS target FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    h = rows(n, NODES, id=text("h:", k), kind="function", name=text("Auth", k), file_path="a.go", language="go")
    d = conform(spark.createDataFrame([("next", "method", "Next", "ctx.go", "go")], "id string, kind string, name string, file_path string, language string"), NODES)
    source = n.select(text("s:", k).alias("id"), F.lit("r.go").alias("file_path"), text("r.Use(Auth", k, ")").alias("text"))
    g = Graph(h.unionByName(d), no_edges(spark))
    return Y.middleware(g, Y.registered(g, source)).select("source", "target")


@query("y25_scoped_declarations", "SELECT 'd:'||p_partkey AS source, 'x:'||p_partkey AS target FROM part WHERE p_partkey%10=3", graph=False)
def _(spark, sf):
    p, k = T.read(spark, sf, "part"), key("p_partkey")
    tenth = (F.col("p_partkey") % 10).cast("string")
    one = lambda pre, path, declared: rows(p, NODES, id=text(pre, k), kind="function", name=text("f", k), qualified_name=text("f", k), file_path=path, language="c", is_declaration=declared)
    g = Graph(one("d:", text("h", tenth, ".h"), True).unionByName(one("x:", text("c", tenth, ".c"), False)), no_edges(spark))
    return Y.scoped_declarations(g, spark.createDataFrame([("c3.c",)], "path string")).select("source", "target")


@query("y_synthesize_text", "SELECT source, target FROM (SELECT 'a:'||s_suppkey AS source, 'b:'||s_suppkey AS target FROM supplier)", graph=False)
def _(spark, sf):
    k = key("s_suppkey")
    g, t = _pairs(spark, sf, "javascript", ("send", text("bus.emit('e", k, "', 1)")), (text("hear", k), text("bus.on('e", k, "', hear", k, ")")))
    return Y.synthesize(g, t).select("source", "target")


# -- sync and streams ---------------------------------------------------------


@query("i5_backoff", "SELECT n_nationkey AS failures, CAST(least(2000*power(2,greatest(n_nationkey-1,0)),30000) AS BIGINT) AS ms FROM nation", graph=False)
def _(spark, sf):
    return T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("failures"), watch.retry_after(F.col("n_nationkey")).alias("ms"))


@query("i6_reconcile", "SELECT CASE WHEN count(DISTINCT user_id)>500 THEN 'full' ELSE 'scoped' END AS mode, count(DISTINCT user_id) AS paths FROM events", graph=False)
def _(spark, sf):
    from .q_rules import _events

    return watch.reconcile(watch.latest(_events(spark, sf)))


@query("i1_event_source", "SELECT path, max(ts_ms) AS last_ms, count(*) AS n FROM (SELECT 'user_'||user_id AS path, epoch_us(ts)//1000 AS ts_ms FROM events) GROUP BY 1", graph=False)
def _(spark, sf):
    """The stream that a watcher reads, to its end, into a table."""
    import uuid

    from .q_rules import _events

    home, name = f"{W.shared_folder(spark)}/events-{uuid.uuid4().hex}", f"seen_{uuid.uuid4().hex[:8]}"
    _events(spark, sf).select("path", F.col("ts").cast("timestamp").alias("ts"), "event").write.json(f"{home}/in")
    stream = watch.source(spark, f"{home}/in").groupBy("path").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("path", F.unix_millis("ts").alias("last_ms"), "n")


_SYNCED = "x AS (SELECT s_suppkey AS k, s_suppkey%10 AS f FROM supplier)"


@query("i10_update", f"{_SYNCED} SELECT 'c:'||k AS source, CASE WHEN f=0 THEN 'g2:' ELSE 'g:' END||k AS target, 'calls' AS kind FROM x WHERE f<>1", graph=False)
def _(spark, sf):
    """Callers in files of their own; callees in ten files, of which number 0 is read
    again with other ids and number 1 goes."""
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    tenth = F.col("s_suppkey") % 10
    callee = lambda df, pre: rows(df, NODES, id=text(pre, k), kind="function", name=text("go", k), qualified_name=text("go", k), file_path=text("d/f", tenth.cast("string")), language="java", start_line=1)
    caller = rows(s, NODES, id=text("c:", k), kind="function", name=text("call", k), qualified_name=text("call", k), file_path=text("d/c", k), language="java", start_line=1)
    refs = rows(s, REFS, ref_id=F.col("s_suppkey"), from_node_id=text("c:", k), reference_name=text("go", k), reference_kind="calls", line=F.lit(2), col=F.lit(0), file_path=text("d/c", k), language="java", status="pending")
    nodes = caller.unionByName(callee(s, "g:"))
    files = conform(nodes.select(F.col("file_path").alias("path"), F.lit("old").alias("content_hash"), F.lit("java").alias("language")).distinct(), FILES)
    built = build.index(Graph(nodes, no_edges(spark), files, refs))
    now = files.filter("path <> 'd/f1'").withColumn("content_hash", F.when(F.col("path") == "d/f0", "new").otherwise(F.col("content_hash")))
    read = callee(s.filter(tenth == 0), "g2:")
    out, _ = build.update(built, now, Graph(read, no_edges(spark), None, refs.limit(0)))
    return out.edges.select("source", "target", "kind")


@query("build_index_imports", "SELECT 'u:'||s_suppkey AS source, unnest(['n:'||s_suppkey,'h:'||s_suppkey]) AS target, unnest(['import','event-emitter']) AS by FROM supplier", graph=False)
def _(spark, sf):
    """An index of files that import from each other, with rules over their text."""
    s, k = T.read(spark, sf, "supplier"), key("s_suppkey")
    main, lib = text("src/m", k, ".ts"), text("src/lib", k, ".ts")
    one = lambda pre, name, at: rows(s, NODES, id=text(pre, k), kind="function", name=text(name, k), qualified_name=text(name, k), file_path=at, language="typescript", start_line=1, is_exported=True)
    nodes = one("u:", "use", main).unionByName(one("h:", "hear", main)).unionByName(one("n:", "fn", lib))
    refs = rows(s, REFS, ref_id=F.col("s_suppkey"), from_node_id=text("u:", k), reference_name=text("f", k), reference_kind="calls", line=F.lit(3), col=F.lit(0), file_path=main, language="typescript", status="pending")
    files = conform(nodes.select(F.col("file_path").alias("path"), "language").distinct(), FILES)
    contents = s.select(main.alias("file_path"), F.lit("typescript").alias("language"), text("import { fn", k, " as f", k, " } from './lib", k, "'\n").alias("text"))
    source = s.select(text("u:", k).alias("id"), main.alias("file_path"), text("bus.emit('e", k, "')").alias("text")).unionByName(s.select(text("h:", k).alias("id"), main.alias("file_path"), text("bus.on('e", k, "', hear", k, ")").alias("text")))
    out = build.index(Graph(nodes, no_edges(spark), files, refs), I.Imports(I.bindings(contents)), source)
    m = F.col("metadata")
    return out.edges.select("source", "target", F.coalesce(F.try_element_at(m, F.lit("resolvedBy")), F.try_element_at(m, F.lit("synthesizedBy"))).alias("by"))


# -- terms, parser, prose -----------------------------------------------------


@query("t1s_query_parser", "SELECT 'find x'||n_nationkey AS text, 'class' AS kinds, 'java' AS languages, 'src/a b'||n_nationkey AS paths, 'n'||n_nationkey AS names FROM nation", graph=False)
def _(spark, sf):
    keys = [r[0] for r in T.read(spark, sf, "nation").select("n_nationkey").collect()]  # 25 rows
    parsed = [S.parse(f'kind:class lang:Java find path:"src/a b{k}" name:n{k} x{k}') for k in keys]
    return spark.createDataFrame([(p.text, ",".join(p.kinds), ",".join(p.languages), ",".join(p.paths), ",".join(p.names)) for p in parsed], "text string, kinds string, languages string, paths string, names string")


@query("t10s_terms", "SELECT n_nationkey AS id, 'getuserid'||',user_name_'||n_nationkey||',get,user,name'||CASE WHEN n_nationkey>=100 THEN ','||n_nationkey ELSE '' END AS terms FROM nation", graph=False)
def _(spark, sf):
    keys = [r[0] for r in T.read(spark, sf, "nation").select("n_nationkey").collect()]  # 25 rows
    return spark.createDataFrame([(k, ",".join(S.terms(f"how does the getUserId of user_name_{k} work", with_stems=False))) for k in keys], "id long, terms string")


@query("t11s_stems", "SELECT c AS word, array_to_string(f, ',') AS forms FROM (VALUES ('caching',['cach','cache']),('running',['runn','runne','run']),('eviction',['evict']),('expression',['express']),('management',['manage']),('entries',['entry']),('processes',['process']),('errors',['error']),('class',[]),('handled',['handle','handl']),('carried',['carrie','carri','carry']),('builder',['build','builde']),('getter',['gett','gette','get']),('need',[])) v(c, f)", graph=False)
def _(spark, sf):
    words = "caching running eviction expression management entries processes errors class handled carried builder getter need".split()
    return spark.createDataFrame([(w, ",".join(S.stems(w))) for w in words], "word string, forms string")


@query("t14s_symbols", "SELECT n_nationkey AS id, 'getUserId,user_name_'||n_nationkey||',MAX_SIZE,Tree.find,Tree,find' AS symbols FROM nation", graph=False)
def _(spark, sf):
    keys = [r[0] for r in T.read(spark, sf, "nation").select("n_nationkey").collect()]  # 25 rows
    wanted = lambda k: ("getUserId", f"user_name_{k}", "MAX_SIZE", "Tree.find", "Tree", "find")
    found = lambda k: set(C.symbols(f"does getUserId call user_name_{k} or `Tree.find` up to MAX_SIZE"))
    return spark.createDataFrame([(k, ",".join(w for w in wanted(k) if w in found(k))) for k in keys], "id long, symbols string")


# -- text functions and plug-ins ----------------------------------------------


@query("fn_strip_comments", "SELECT p_partkey AS id, 'x = \"// '||p_name||'\" '||repeat(' ', length('// '||p_brand)) AS text FROM part", graph=False)
def _(spark, sf):
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), text('x = "// ', F.col("p_name"), '" // ', F.col("p_brand")).alias("text"), F.lit("java").alias("language"))
    return p.select("id", without_comments("text", "language").alias("text"))


@query("fn_json_list", "SELECT p_partkey AS id, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_name||'|'||p_brand END AS items FROM part", graph=False)
def _(spark, sf):
    p = T.read(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, "no list").otherwise(F.to_json(F.array("p_name", "p_brand")))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(X.json_list(raw), "|").alias("items"))


@query("udtf_registration", "SELECT 'd'||doc_id AS path, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text,'(?:^|\\n)([A-Z][a-z]+)',1)) FROM documents) GROUP BY 1", graph=False)
def _(spark, sf):
    first = SF._by_pattern("starts", ("text",), {"word": r"^([A-Z][a-z]+)"}, {})
    SF.register(SF._by_pattern("starts", ("text",), {"word": r"(nothing)"}, {}))
    SF.register(first)  # a rule of the same name replaces the other
    d = T.read(spark, sf, "documents").select(text("d", key("doc_id")).alias("path"), F.lit("text").alias("language"), "text")
    return SF.extract(d, [r for r in SF.rules() if r.name == "starts"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("udtf_batch_prefixes", "SELECT 'c'||n_nationkey AS path, '/api'||n_regionkey||'/r'||n_nationkey AS name FROM nation", graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    routes = n.select(text("c", k).alias("path"), text("/r", k, "/").alias("name"))
    return FW.prefixed_routes(routes, n.select(text("c", k).alias("path"), text("/api", key("n_regionkey"), "/").alias("prefix")))


#: For each pack: language, source with %s for the row's number, kind, name, handler.
_SAMPLES = (
    ("laravel", "php", "Route::get('/u%s', [UserController%s::class])", "route", "/u%s", "UserController%s"),
    ("drupal", "yaml", "x:\n  path: '/u%s'\n  defaults:\n    _controller: 'Ctl%s'\n", "route", "/u%s", "Ctl%s"),
    ("express", "javascript", "app.get('/u%s', show%s)", "route", "/u%s", "show%s"),
    ("nestjs", "typescript", "@Get('u%s')\nasync show%s() {}", "route", "u%s", "show%s"),
    ("react", "tsx", "export default function Box%s() {}", "component", "Box%s", ""),
    ("svelte", "svelte", "<Box%s/>", "component", "Box%s", ""),
    ("vue", "vue", "export default { name: 'Box%s' }", "component", "Box%s", ""),
    ("django", "python", "path('u%s', views.show%s)", "route", "u%s", "views.show%s"),
    ("flask", "python", "@app.route('/u%s')\ndef show%s(): pass", "route", "/u%s", "show%s"),
    ("fastapi", "python", "@app.get('/u%s')\nasync def show%s(): pass", "route", "/u%s", "show%s"),
    ("rails", "ruby", "get '/u%s', to: 'users#show%s'", "route", "/u%s", "users#show%s"),
    ("spring", "java", "@GetMapping(\"/u%s\")\npublic String show%s() {}", "route", "/u%s", "show%s"),
    ("play", "scala", "GET /u%s controllers.U.show%s", "route", "/u%s", "controllers.U.show%s"),
    ("go-web", "go", "r.GET(\"/u%s\", show%s)", "route", "/u%s", "show%s"),
    ("rust-web", "rust", "#[get(\"/u%s\")]\nasync fn show%s() {}", "route", "/u%s", "show%s"),
    ("aspnet", "csharp", "app.MapGet(\"/u%s\", Show%s);", "route", "/u%s", "Show%s"),
    ("swiftui", "swift", "struct Box%s: View {}", "component", "Box%s", ""),
    ("uikit", "swift", "class Box%s: UIViewController {}", "component", "Box%s", ""),
    ("vapor", "swift", "app.get(\"u%s\", use: show%s)", "route", "u%s", "show%s"),
    ("react-native", "objc", "RCT_EXPORT_METHOD(run%s:(int)a)", "method", "run%s", ""),
    ("expo-modules", "kotlin", "AsyncFunction(\"run%s\") {}", "method", "run%s", ""),
    ("fabric", "typescript", "codegenNativeComponent<P>('Box%s')", "component", "Box%s", ""),
    ("cargo-workspace", "toml", "name = \"box%s\"", "module", "box%s", ""),
)


def _numbered_sql(template):
    return "'" + template.replace("'", "''").replace("%s", "'||n_nationkey||'") + "'"


@query("fw_packs", " UNION ALL ".join(f"SELECT '{pack}' AS pack, 'node' AS what, '{kind}' AS kind, {_numbered_sql(name)} AS name FROM nation" + (f" UNION ALL SELECT '{pack}', 'reference', 'references', {_numbered_sql(handler)} FROM nation" if handler else "") for pack, _, _, kind, name, handler in _SAMPLES), graph=False)
def _(spark, sf):
    n, k = T.read(spark, sf, "nation"), key("n_nationkey")
    filled = lambda template: F.concat(*(x for part in template.split("%s") for x in (F.lit(part), k)[: 2]))
    out = None
    for pack, language, source, *_ in _SAMPLES:
        code = F.substring_index(filled(source + "\x00"), "\x00", 1)
        contents = n.select(text(f"{pack}/", k).alias("path"), F.lit(language).alias("language"), code.alias("text"))
        rule = [p.rule() for p in FW.PACKS if p.name == pack]
        found = SF.extract(contents, rule).select(F.lit(pack).alias("pack"), "what", "kind", "name")
        out = found if out is None else out.unionByName(found)
    return out


@query("fw_detected", "SELECT unnest(['express','react','rails','django','rust-web','cargo-workspace']) AS pack", graph=False)
def _(spark, sf):
    """Manifests among as many other files as there are documents."""
    d = T.read(spark, sf, "documents").select(text("docs/d", key("doc_id"), ".md").alias("path"), "text")
    own = [("web/package.json", '{"dependencies": {"express": "4", "react": "18"}}'), ("Gemfile", "gem 'rails'"), ("app/manage.py", "import django"), ("Cargo.toml", "[workspace]\n[dependencies]\naxum = 1\n"), ("notes/package.txt", '"vue"')]
    return FW.detected(d.unionByName(spark.createDataFrame(own, "path string, text string")))


@query("fw_handlers", "SELECT n_nationkey AS ref_id, unnest_t AS target FROM (SELECT n_nationkey, CASE n_nationkey%3 WHEN 0 THEN 'r:'||n_nationkey WHEN 1 THEN 'l:'||n_nationkey ELSE 'd:'||n_nationkey END AS unnest_t FROM nation)", graph=False)
def _(spark, sf):
    n, k, i = T.read(spark, sf, "nation"), key("n_nationkey"), F.col("n_nationkey")
    one = lambda pre, kind, qualified, at: rows(n, NODES, id=text(pre, k), kind=kind, name=text("show", k), qualified_name=qualified, file_path=at, language="x")
    nodes = one("r:", "method", text("UserItemsController::show", k), "c.rb").unionByName(one("l:", "method", text("PostController::show", k), "c.php")).unionByName(one("d:", "function", text("show", k), "blog/views.py"))
    refs = rows(n, REFS, ref_id=i, reference_kind="references", reference_name=F.when(i % 3 == 0, text("admin/user_items#show", k)).when(i % 3 == 1, text("PostController@show", k)).otherwise(text("blog.views.show", k)))
    return FW.resolved_handlers(refs, nodes, ("rails", "laravel", "django")).select("ref_id", "target")
