"""Work that grows with the input and not with the square of a group: the most rows
that one step of a plan makes, for names and files that many rows share."""

from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.schema import EDGES, NODES, REFS, Graph, conform


def most_rows(df):
    """The rows, and the most that one operator of the plan gave out."""
    rows = df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        m = p.metrics().get("numOutputRows")
        below = p.children()
        return max([m.get().value() if m.isDefined() else 0] + [walk(below.apply(i)) for i in range(below.size())])

    return rows, walk(df._jdf.queryExecution().executedPlan())


N = 1000


def _same_names(spark):
    """N nodes of one name in each of two types' files, and N references to it."""
    i = F.col("id").cast("string")
    n = spark.range(N).select(F.concat(F.lit("method:"), i).alias("id"), F.lit("method").alias("kind"), F.lit("run").alias("name"), F.lit("ns::T::run").alias("qualified_name"), F.lit("f").alias("file_path"), F.lit("java").alias("language"))
    sole = spark.createDataFrame([("method:x", "method", "run", "ns::Sole::run", "g", "java")], "id string, kind string, name string, qualified_name string, file_path string, language string")
    name = F.when(F.col("id") % 2 == 0, "T::run").otherwise("Sole::run")
    r = spark.range(N).select(F.col("id").alias("ref_id"), name.alias("reference_name"), F.lit("calls").alias("reference_kind"), F.lit("h").alias("file_path"), F.lit("java").alias("language"))
    return conform(n, NODES).unionByName(conform(sole, NODES)), conform(r, REFS)


def test_qualified_names_that_many_share(spark):
    nodes, refs = _same_names(spark)
    rows, most = most_rows(R.qualified_name(refs, nodes))
    assert {(r["ref_id"], r["target"], r["confidence"]) for r in rows} == {(k, "method:x", 0.85) for k in range(1, N, 2)}
    assert most < 10 * N


def test_fuzzy_names_that_many_share(spark):
    nodes, refs = _same_names(spark)
    rows, most = most_rows(R.fuzzy(refs.withColumn("reference_name", F.lit("RUN")), nodes))
    assert not rows and most < 10 * N


def test_members_that_many_types_have(spark):
    i = F.col("id").cast("string")
    t = conform(spark.range(N).select(F.concat(F.lit("class:"), i).alias("id"), F.lit("class").alias("kind"), F.concat(F.lit("BigShop"), i).alias("name"), F.lit("f").alias("file_path"), F.lit("java").alias("language")), NODES)
    m = conform(spark.range(N).select(F.concat(F.lit("method:"), i).alias("id"), F.lit("method").alias("kind"), F.lit("run").alias("name"), F.lit("f").alias("file_path"), F.lit("java").alias("language")), NODES)
    e = conform(spark.range(N).select(F.concat(F.lit("class:"), i).alias("source"), F.concat(F.lit("method:"), i).alias("target"), F.lit("contains").alias("kind")), EDGES)
    name = F.when(F.col("id") == 0, "bigShopHelper.run").otherwise(F.concat(F.lit("bigShop"), i, F.lit(".run")))
    r = conform(spark.range(N).select(F.col("id").alias("ref_id"), name.alias("reference_name"), F.lit("calls").alias("reference_kind"), F.lit("java").alias("language")), REFS)
    rows, most = most_rows(R.method(r, Graph(t.unionByName(m), e)))
    got = {r["ref_id"]: (r["target"], float(r["confidence"])) for r in rows}
    assert got == {k: (f"method:{k}", 0.8) for k in range(1, N)}
    assert most < 10 * N


def test_references_of_unknown_language_meet_names_that_many_have(spark):
    nodes, refs = _same_names(spark)
    rows = R.exact_name(refs.withColumn("reference_name", F.lit("run")).withColumn("language", F.lit(None).cast("string")).withColumn("file_path", F.lit("f")), nodes).collect()
    assert len(rows) == N and {r["target"] for r in rows} == {"method:0"}


def test_lines_that_many_ranges_have(spark):
    from loomgraph.operators import synth as Y

    i = F.col("id")
    n = spark.range(N).select(F.concat(F.lit("function:"), i.cast("string")).alias("id"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit("a.c").alias("file_path"), (i % 10 * 100).alias("start_line"), (i % 10 * 100 + 50 - i % 2).alias("end_line"))
    outer = spark.createDataFrame([("function:x", "function", "f", "a.c", 0, 5000)], "id string, kind string, name string, file_path string, start_line int, end_line int")
    g = Graph(conform(n, NODES).unionByName(conform(outer, NODES)), None)
    points = spark.range(N).select(i.alias("point_id"), F.lit("a.c").alias("file_path"), (i % 10 * 100 + 20 + F.when(i < 10, 60).otherwise(0)).alias("line"))
    rows, most = most_rows(Y.enclosing(points, g))
    want = {k: "function:x" if k < 10 else min(f"function:{j}" for j in range(k % 10, N, 10)) for k in range(N)}
    assert {r["point_id"]: r["id"] for r in rows} == want
    assert most < 10 * N


def _star(spark, n):
    i = F.col("id").cast("string")
    nodes = spark.range(n).select(F.concat(F.lit("m:"), i).alias("id"), F.lit("method").alias("kind"), F.lit("m").alias("name"), F.lit("f").alias("file_path"), F.lit("go").alias("language"))
    edges = spark.range(1, n).select(F.concat(F.lit("m:"), F.floor(F.col("id") / 2).cast("string")).alias("source"), F.concat(F.lit("m:"), i).alias("target"), F.lit("calls").alias("kind"))
    return Graph(conform(nodes, NODES), conform(edges, EDGES))


def test_depth_first_order_of_many_nodes(spark):
    from loomgraph.operators import traverse as V

    n = 12_000
    got = {r["id"]: r["place"] for r in V.depth_first(_star(spark, n), "m:1").collect()}
    assert set(got) == {f"m:{k}" for k in range(1, n)} and sorted(got.values()) == list(range(n - 1))
    want, todo = [], [1]
    while todo:
        k = todo.pop()
        want.append(f"m:{k}")
        todo += sorted((x for x in (2 * k, 2 * k + 1) if x < n), key=lambda x: f"m:{x}", reverse=True)
    assert sorted(got, key=got.get) == want


def test_few_ids_reach_the_scan_below_distinct_edges(spark):
    from loomgraph.operators import traverse as V

    g = _star(spark, 50)
    g = g.with_edges(g.edges.select("source", "target", "kind").distinct())
    front = V.cut(spark.createDataFrame([("m:3",)], "id string"))
    plan = V.onward(V.arcs(g, (), "both"), front, 1)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate") < text.index("LeftSemi")
    assert {(r["a"], r["b"]) for r in plan.collect()} == {("m:3", "m:6"), ("m:3", "m:7"), ("m:3", "m:1")}


def test_impact_of_several_nodes_is_one_traversal(spark, monkeypatch):
    from loomgraph.operators import traverse as V

    runs, one = [], V.impact
    monkeypatch.setattr(V, "impact", lambda *a: runs.append(a) or one(*a))
    found, _ = V.impact_of_all(_star(spark, 30), ["m:28", "m:5", "m:28"], 2)
    assert {r["id"]: r["depth"] for r in found.collect()} == {"m:28": 0, "m:5": 0, "m:14": 1, "m:7": 2, "m:2": 1, "m:1": 2}
    assert len(runs) == 1


def test_rank_works_out_only_what_the_walk_can_reach(spark, monkeypatch):
    from loomgraph.operators import algorithms as G

    two = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string").unionByName(spark.range(N).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("x"), (F.col("id") + 1).cast("string")).alias("target")))
    e = conform(two.withColumn("kind", F.lit("calls")), EDGES)
    ids = two.select(F.col("source").alias("id")).unionByName(two.select(F.col("target").alias("id"))).distinct()
    sizes, real = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, *c: sizes.append((out := real(df, *c)).count()) or out)
    got = {r["id"]: r["rank"] for r in G.personal_rank(Graph(conform(ids, NODES), e), ["a"], ("calls",)).collect()}
    assert len(got) == N + 4 and abs(sum(got.values()) - 1) < 1e-9 and {k for k, v in got.items() if v} == {"a", "b", "c"}
    assert abs(got["b"] - 0.75 * (got["a"] + got["c"])) < 1e-3
    assert sizes == [N + 4, 3, 4]  # all ids, those within reach, their steps


def test_pairs_of_one_name_are_dealt_out(spark):
    from loomgraph.operators import synth as Y

    i = F.col("id")
    n = spark.range(4 * N).select(F.concat(F.lit("m:"), i.cast("string")).alias("id"), F.lit("method").alias("kind"), F.lit("m").alias("name"), F.when(i < 4 * N - 2, "q").otherwise("r").alias("qualified_name"), F.concat(F.lit("f"), (i % 7).cast("string")).alias("file_path"), F.lit("kotlin").alias("language"), F.array(F.when(i % 2 == 0, "expect").otherwise("actual")).alias("decorators"))
    df = Y.expect_actual(Graph(conform(n, NODES), None)).select("source", "target")
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_pa" in text and "_pb" in text
    want = sum(1 for a in range(0, 4 * N - 2, 2) for r in range(7) if r != a % 7 for _ in range(len(range(1, 4 * N - 2, 2)[((r - 1) * 4) % 7 :: 7])))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source", "target").alias("d")).first()
    assert got["n"] == got["d"] == want + 1


def test_parameters_are_worked_out_once_a_node(spark):
    from loomgraph.operators import synth as Y

    cols = "id string, name string, qualified_name string, file_path string, is_declaration boolean, signature string"
    rows = [("d1", "run", "T::run", "a.hpp", True, "void run(int a)"), ("d2", "run", "T::run", "a.hpp", True, None), ("d3", "run", "T::run", "a.hpp", True, "void run"), ("x1", "run", "n::T::run", "a.cpp", False, "void run(int)"), ("x2", "run", "n::T::run", "a.cpp", False, "void run(double)"), ("x3", "run", "n::T::run", "a.cpp", False, None), ("x4", "run", "n::T::run", "a.hpp", False, "void run(int)"), ("x1", "run", "n::T::run", "b.cpp", False, "void run(int)")]
    n = conform(spark.createDataFrame(rows, cols).withColumn("kind", F.lit("method")).withColumn("language", F.lit("cpp")), NODES)
    df = Y.cpp_declarations(Graph(n, conform(spark.createDataFrame([], "source string"), EDGES))).select("source", "target")
    got = sorted((r["source"], r["target"]) for r in df.collect())
    assert got == [("d1", "x1"), ("d1", "x3"), ("d2", "x1"), ("d2", "x2"), ("d2", "x3"), ("d3", "x3")]
    assert "ArrowEvalPython" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_parameters_after_the_name():
    from loomgraph.functions.cpp import _parameters

    assert _parameters("A run$(char) my_run(x) run (int a, T<b, c> d = {1})", "run") == "int,T<b,c>"
    assert _parameters("operator()(int) const", "operator()") == "int" and _parameters("f(double)", "g") == "double" and _parameters("f", "f") is None
