"""Operators on graphs small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregates as A
from loomgraph.operators import algorithms as G
from loomgraph.operators import context as C
from loomgraph.operators import lookup as L
from loomgraph.operators import resolve as R
from loomgraph.operators import search as S
from loomgraph.operators import storage as W
from loomgraph.operators import synth as Y
from loomgraph.operators import traverse as V
from loomgraph.plans import build
from loomgraph.schema import EDGES, FILES, NODES, REFS, Graph, conform

FILE = {"base": "BaseClass getValue Printable", "derived": "DerivedClass print getName", "utils": "formatValue processValue doubleValue unusedHelper", "main": "main"}
KIND = {"BaseClass": "class", "DerivedClass": "class", "Printable": "interface", "getValue": "method", "print": "method", "getName": "method"}
CLOSED = {"getValue", "print", "getName", "unusedHelper"}
LINKS = """BaseClass contains getValue|DerivedClass contains print getName|DerivedClass extends BaseClass|DerivedClass implements Printable|print calls getName getValue
processValue calls formatValue|main calls processValue doubleValue print getValue|main instantiates DerivedClass"""


def graph(spark, nodes, edges, refs=()):
    n = conform(spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean"), NODES)
    e = conform(spark.createDataFrame(edges or [("", "", "")], "source string, target string, kind string").filter("source <> ''"), EDGES)
    f = conform(n.select(F.col("file_path").alias("path"), F.lit("h").alias("content_hash"), "language").distinct(), FILES)
    r = conform(spark.createDataFrame(refs or [(0, "", "", "", "", "")], "ref_id long, from_node_id string, reference_name string, reference_kind string, file_path string, language string").filter("from_node_id <> ''").withColumn("status", F.lit("pending")), REFS)
    return Graph(n.cache(), e.cache(), f, r)


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(n, KIND.get(n, "function"), n, n, f"src/{f}.ts", "typescript", 10 * i + 1, 10 * i + 9, n not in CLOSED) for f, ns in FILE.items() for i, n in enumerate(ns.split())]
    edges = [(s, t, k) for part in LINKS.replace("\n", "|").split("|") for s, k, *ts in [part.split()] for t in ts]
    return graph(spark, nodes, edges)


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_calls(g):
    assert ids(V.callers(g, "formatValue")) == {"processValue"}
    assert ids(V.callees(g, "print")) == {"getName", "getValue"}
    for n in ("print", "main", "getValue"):  # callers and callees are inverse
        assert all(n in ids(V.callees(g, c)) for c in ids(V.callers(g, n)))
    assert ids(V.call_graph(g, "processValue", 1)) == {"processValue", "main", "formatValue"}


def test_deeper_is_more(g):
    last = set()
    for depth in (1, 2, 3, 5):
        now = ids(V.bfs(g, "main", depth))
        assert last <= now
        last = now
    assert V.dfs(g, "main")[0] == "main" and set(V.dfs(g, "main")) == ids(V.bfs(g, "main"))


def test_dead_code(g):
    found = ids(A.dead_code(g))
    assert "unusedHelper" in found and "formatValue" not in found


def test_files(g):
    assert ids(A.file_dependencies(g, "src/main.ts"), "path") == {"src/derived.ts", "src/utils.ts", "src/base.ts"}
    assert ids(A.file_dependents(g, "src/base.ts"), "path") == {"src/derived.ts", "src/main.ts"}
    assert ids(V.affected_tests(g, ["src/utils.ts"]), "path") == {"src/main.ts"}


def test_hierarchy(g):
    assert ids(V.hierarchy(g, "DerivedClass", "up")) == {"DerivedClass", "BaseClass", "Printable"}
    assert "DerivedClass" in ids(V.hierarchy(g, "BaseClass"))


def test_impact(g):
    assert ids(V.impact(g, "getName", 1)) == {"getName", "print"}  # no siblings
    assert {"getValue", "DerivedClass", "print", "main"} <= ids(V.impact(g, "BaseClass", 1))


def test_paths(g):
    step = lambda a, b: [r["id"] for r in V.path(g, a, b).orderBy("step").collect()]
    assert step("main", "formatValue") == ["main", "processValue", "formatValue"]
    assert step("formatValue", "main") == [] and step("main", "main") == ["main"]


def test_context(g):
    rows = {(r["role"], r["id"]) for r in V.context(g, "print").collect()}
    assert {("focal", "print"), ("ancestor", "DerivedClass"), ("incoming", "main"), ("outgoing", "getName")} <= rows
    with pytest.raises(KeyError):
        V.context(g, "nobody")


def test_metrics_and_walk(g):
    m = {r["id"]: r for r in A.node_metrics(g).collect()}
    assert (m["print"]["incoming"], m["print"]["outgoing"], m["print"]["calls"], m["print"]["callers"], m["DerivedClass"]["children"]) == (2, 2, 2, 1, 2)
    rank = {r["id"]: r["rank"] for r in G.personal_rank(g, ["main"]).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["unusedHelper"] == 0 and rank["main"] == max(rank.values())


def test_chain_of_modules(spark):
    n = 20
    nodes = [(f"fn{i}", "function", f"fn{i}", f"fn{i}", f"m{i}.ts", "typescript", 1, 2, True) for i in range(n)] + [(f"Mod{i}", "class", f"Mod{i}", f"Mod{i}", f"m{i}.ts", "typescript", 3, 9, True) for i in range(n)]
    g = graph(spark, nodes, [(f"fn{i}", f"fn{i - 1}", "calls") for i in range(1, n)] + [(f"Mod{i}", f"Mod{i - 1}", "extends") for i in range(1, n)])
    assert V.path(g, f"fn{n - 1}", "fn0").count() == n
    assert V.hierarchy(g, f"Mod{n - 1}", "up").count() == n
    assert G.cycles(g).count() == 0
    back = g.with_edges(g.edges.unionByName(conform(spark.createDataFrame([("fn3", "fn9", "calls")], "source string, target string, kind string"), EDGES)))
    assert ids(G.cycles(back), "path") == {f"m{i}.ts" for i in range(3, 10)}
    assert ids(V.bfs(g, f"fn{n - 1}", limit=5)) == {f"fn{n - 1 - i}" for i in range(5)}


def test_strong_components(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("e", "g")], "a string, b string")
    assert {r["id"]: r["component"] for r in G.strong_components(pairs).collect()} == dict(a="a", b="a", c="a", d="d", e="d", f="f", g="g")


def test_lookup_names(spark):
    names = ["getUser", "GetUser", "getuser", "getUserById"]
    nodes = [(f"n{i}", "function", n, f"A::{n}", "src/a.rs", "rust", i, i + 1, True) for i, n in enumerate(names)] + [(f"d{i}", "method", "dup", "X::dup", "b/c.rs", "rust", i, i, True) for i in range(120)]
    g = graph(spark, nodes, [])
    assert ids(S.exact(g, "getUser")) == {"n0"} and ids(S.exact(g, "A.getUser")) == {"n0"}
    assert S.exact(g, "X::dup", limit=200).count() == 120 and ids(S.exact(g, "X::dup", line=77)) == {"d77"}
    assert ids(S.exact(g, "OtherA::getUser")) == set() and ids(S.exact(g, "a::getUser")) == {"n0"}  # a file's stem
    assert S.tool_search(g, "GETUSERBYID")[0] == "case-insensitive" and S.tool_search(g, "getUsr")[0] == "fuzzy" and S.tool_search(g, "A::getUsr")[0] == "none"
    assert ids(L.by_ids(g, [f"d{i}" for i in range(1500)])) == {f"d{i}" for i in range(120)}
    assert ids(S.search(g, 'name:getuser kind:function')) >= {"n0"}


def test_query_parser():
    p = S.parse('kind:class lang:Go path:"a b/c" name:x foo:bar kind:nope "quoted text" trailing:')
    assert (p.kinds, p.languages, p.paths, p.names) == (["class"], ["go"], ["a b/c"], ["x"])
    assert p.text == 'foo:bar kind:nope "quoted text" trailing:'
    assert S.parse('open "quote kind:class').text and S.parse("").text == ""


def test_terms():
    assert S.terms("getUserName for the cache_builder", with_stems=False) == ["getusername", "cache_builder", "get", "user", "name", "cache", "builder"]
    assert {"cach", "cache"} <= set(S.stems("caching")) and "run" in S.stems("running") and "entry" in S.stems("entries")
    assert S.stems("class") == [] and "evic" not in S.stems("eviction") and "evict" in S.stems("eviction")
    assert C.symbols("Why does `parseQuery` call UserService.save or MAX_SIZE?")[0] in ("parseQuery", "UserService")


def test_edges_are_unique_and_have_ends(g, spark):
    new = conform(spark.createDataFrame([("main", "nowhere", "calls"), ("main", "print", "calls"), ("main", "getName", "calls"), ("main", "getName", "calls")], "source string, target string, kind string"), EDGES)
    out = W.insert_edges(g, new)
    assert out.count() == g.edges.count() + 1


def test_resolution(spark):
    nodes = [("a", "function", "run", "A::run", "x/y/a.py", "python", 1, 5, True), ("b", "function", "run", "B::run", "z/b.py", "python", 1, 5, True), ("c", "class", "Box", "Box", "x/y/c.py", "python", 1, 9, True), ("m", "method", "open", "Box::open", "x/y/c.py", "python", 2, 3, False), ("f", "file", "util.h", "lib/util.h", "lib/util.h", "c", 1, 1, False)]
    refs = [(1, "q", "run", "calls", "x/y/d.py", "python"), (2, "q", "B::run", "calls", "x/y/d.py", "python"), (3, "q", "box.open", "calls", "x/y/d.py", "python"), (4, "q", "util.h", "imports", "src/m.c", "c"), (5, "q", "console", "calls", "x", "python"), (6, "q", "nothing", "calls", "x", "python"), (7, "q", "OPEN", "calls", "x", "go"), (8, "q", "Box", "calls", "w.py", "python")]
    g = graph(spark, nodes, [("c", "m", "contains")], refs)
    got = {r["ref_id"]: (r["target"], float(r["confidence"]), r["resolved_by"]) for r in R.resolve(g).collect()}
    assert got[1] == ("a", 0.7, "exact-match") and got[2][:2] == ("b", 0.95) and got[3] == ("m", 0.8, "method") and got[4][0] == "f" and got[8][0] == "c"
    assert not {5, 6} & set(got)
    edges = {(r["target"], r["kind"]) for r in R.promoted(R.resolve(g), g).collect()}
    assert ("c", "instantiates") in edges
    left = R.parked(g.refs, R.resolve(g))
    assert {r["ref_id"] for r in left.collect()} == {1, 2, 3, 4, 5, 6, 7, 8} - set(got)
    assert R.retryable(left, spark.createDataFrame([("nothing",)], "name string")).count() == 1


def test_reexports(spark):
    nodes = [("t", "function", "deep", "deep", "c.ts", "typescript", 1, 2, True)]
    g = graph(spark, nodes, [], [(1, "q", "local.x", "calls", "main.ts", "typescript")])
    mapping = spark.createDataFrame([("main.ts", "local", "pub", "a.ts")], "file_path string, local string, exported string, path string")
    re = spark.createDataFrame([("a.ts", "pub", "b.ts", "deep"), ("b.ts", "*", "c.ts", None), ("c.ts", "*", "a.ts", None)], "path string, exported string, to_path string, to_name string")
    assert [(r["target"], r["confidence"]) for r in R.imported(g.refs, mapping, g.nodes, re).collect()] == [("t", 0.9)]


def test_rules_on_text(spark):
    nodes = [("e", "function", "emitter", "emitter", "a.js", "javascript", 1, 2, True), ("h", "function", "onSave", "onSave", "a.js", "javascript", 3, 4, True), ("r", "function", "setup", "setup", "a.js", "javascript", 5, 6, True), ("A", "component", "App", "App", "a.jsx", "jsx", 1, 9, True), ("B", "component", "Box", "Box", "b.jsx", "jsx", 1, 9, True)]
    g = graph(spark, nodes, [])
    src = spark.createDataFrame([("e", "a.js", "bus.emit('save')"), ("r", "a.js", "bus.on('save', onSave)"), ("A", "a.jsx", "<Box/><Other/><Box/>")], "id string, file_path string, text string")
    pair = lambda df: {(r["source"], r["target"]) for r in df.collect()}
    assert pair(Y.event_emitter(g, src)) == {("e", "h")}
    assert pair(Y.tag_children(g, src)) == {("A", "B")}
    run = spark.createDataFrame([("e", "a.js", "for (const f of handlers) f()"), ("r", "a.js", "handlers.push(x)")], "id string, file_path string, text string")
    assert pair(Y.closures(run, g)) == {("e", "r")}
    obs = graph(spark, [("d", "method", "notify", "d", "o.ts", "typescript", 1, 1, True), ("l", "method", "addListener", "l", "o.ts", "typescript", 2, 2, True)], [])
    fields = spark.createDataFrame([("d", "o.ts", "this.subs.forEach"), ("l", "o.ts", "this.subs.push(x)")], "id string, file_path string, text string")
    assert pair(Y.observers(fields, obs)) == {("d", "l")}


def test_parameter_keys(spark):
    from loomgraph.functions.cpp import parameter_key, without_comments

    df = spark.createDataFrame([("void f(const int a, std::map<K, V> *m)", "f"), ("f(int, std::map<K,V>* other = nullptr)", None), ("f(void)", "f"), ("f", "f"), (None, "f"), ("bool operator()(int)", "operator()"), ("bool operator()(double x)", "operator()")], "s string, n string")
    assert [r[0] for r in df.select(parameter_key("s", "n")).collect()] == ["int,std::map<K,V>*", "int,std::map<K,V>*", "", None, None, "int", "double"]
    code = spark.createDataFrame([('x = "# no" # yes', "python"), ("a /* b\nc */ d // e", "go"), (None, "go")], "t string, l string")
    assert [r[0] for r in code.select(without_comments("t", "l")).collect()] == ['x = "# no"      ', "a     \n     d     ", None]


def test_incremental_is_a_rebuild(g, spark):
    """One file changes, one goes, one comes: the same graph as from scratch."""
    files = g.files
    moved = g.nodes.filter("file_path = 'src/base.ts'").withColumn("id", F.concat("id", F.lit("2"))).withColumn("start_line", F.col("start_line") + 5)
    extra = conform(spark.createDataFrame([("New", "function", "New", "src/new.ts", "typescript")], "id string, kind string, name string, file_path string, language string"), NODES)
    new_files = conform(files.filter("path <> 'src/utils.ts'").withColumn("content_hash", F.when(F.col("path") == "src/base.ts", "x").otherwise(F.col("content_hash"))).unionByName(conform(spark.createDataFrame([("src/new.ts", "n", "typescript")], "path string, content_hash string, language string"), FILES)), FILES)
    own = conform(spark.createDataFrame([("BaseClass2", "getValue2", "contains")], "source string, target string, kind string"), EDGES)
    out, again = build.sync(g, new_files, Graph(moved.unionByName(extra), own))
    want_nodes = ids(g.nodes.filter("file_path not in ('src/base.ts', 'src/utils.ts')")) | {"BaseClass2", "getValue2", "Printable2", "New"}
    assert ids(out.nodes) == want_nodes and ids(again, "path") == {"src/main.ts"}
    renamed = {"BaseClass": "BaseClass2", "getValue": "getValue2", "Printable": "Printable2"}
    want = {(renamed.get(r["source"], r["source"]), renamed.get(r["target"], r["target"]), r["kind"]) for r in g.edges.collect()}
    want = {e for e in want if e[0] in want_nodes and e[1] in want_nodes}
    assert {(r["source"], r["target"], r["kind"]) for r in out.edges.collect()} == want
    same, none = build.sync(g, files, Graph(g.nodes.limit(0), g.edges.limit(0)))
    assert ids(same.nodes) == ids(g.nodes) and same.edges.count() == g.edges.count() and none.count() == 0


def test_snapshots(g, spark, tmp_path):
    at = W.save(g, str(tmp_path))
    back = W.load(spark, at)
    assert ids(back.nodes) == ids(g.nodes) and back.edges.count() == g.edges.count()


def test_answers(g, spark):
    found = C.relevant(g, "how does processValue use formatValue")
    assert found.confidence == "high" and {"processValue", "formatValue"} <= ids(found.nodes.filter("root"))
    contents = spark.createDataFrame([("src/utils.ts", "\n".join(f"line {i}" for i in range(1, 50)))], "path string, text string")
    blocks = C.code_blocks(found.nodes, contents)
    assert blocks.count() >= 2
    assert "processValue" in C.as_markdown(found, blocks)
    assert C.as_tree(["b.ts", "a/c.ts", "a/b/d.ts"]) == "a/\n  b/\n    d.ts\n  c.ts\nb.ts"
    assert C.relevant(g, "the of").confidence == "none"
    assert C.explore(g, "processValue formatValue").first()["path"] == "src/utils.ts"
    assert C.target(g, "print")[0] == "found" and C.target(g, "nobody")[0] == "none"
    with pytest.raises(ValueError):
        C.manifest(g, contents, [])


def test_no_alias_is_dropped(spark):
    from loomgraph.operators import resolve

    imports = spark.createDataFrame([(i, f"@p{i}/x", "lib/main.ts") for i in range(1500)], "import_id long, module string, file_path string")
    aliases = spark.createDataFrame([(f"@p{i}/", f"src/p{i}/") for i in range(1500)] + [("@", "all/")], "prefix string, target string")
    files = spark.createDataFrame([(f"src/p{i}/x.ts",) for i in range(1500)], "path string")
    got = {r["import_id"]: r["path"] for r in resolve.module_files(imports, files, aliases=aliases).collect()}
    assert got == {i: f"src/p{i}/x.ts" for i in range(1500)}
