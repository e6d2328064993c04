"""A relational schema of orders and parts, seen as a property graph.

Regions, nations, customers, suppliers, orders and parts are modules,
namespaces, classes, interfaces, functions and methods; nesting is ``contains``,
order lines are ``calls``, and so on. The graph is a set of views: nothing is
copied, and filters on it reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES, FILES, NODES, REFS, Graph, conform

LANGUAGES = ("java", "kotlin", "python", "go")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lang4(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LANGUAGES)), (k % 4 + 1).cast("int"))


def segment(c: Column) -> Column:
    return F.when(c == "MACHINERY", "tests").otherwise(F.lower(c))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their regions: 25 rows."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    return n.join(r, n.n_regionkey == r.r_regionkey)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _places(spark, sf_dir)
    region, nation = F.lower("r_name"), F.lower("n_name")
    customer = read(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    owner = customer.select("c_custkey", "c_name", F.concat_ws("/", region, nation, segment(F.col("c_mktsegment")), F.lit("core")).alias("file_path"))
    orders = read(spark, sf_dir, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey"))

    def node(df, prefix, key, kind, name, qualified, path, language, start, length, exported, declared):
        return df.select(
            F.concat(F.lit(f"{prefix}:"), key.cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"),
            path.alias("file_path"), language.alias("language"), start.cast("int").alias("start_line"), (start + length).cast("int").alias("end_line"),
            F.lit(0).alias("start_column"), exported.alias("is_exported"), declared.alias("is_declaration"),
        )

    one, no, yes = F.lit(1), F.lit(False), F.lit(True)
    line = lambda k: F.col(k) % 997 + 1
    parts = [
        node(read(spark, sf_dir, "region"), "module", F.col("r_regionkey"), "module", F.col("r_name"), F.col("r_name"), F.concat(region, F.lit("/index")), F.lit("yaml"), one, F.lit(0), yes, no),
        node(place, "namespace", F.col("n_nationkey"), "namespace", F.col("n_name"), F.concat_ws("::", "r_name", "n_name"), F.concat_ws("/", region, nation, F.lit("index")), F.lit("yaml"), one, F.lit(0), yes, no),
        node(customer, "class", F.col("c_custkey"), "class", F.col("c_name"), F.concat_ws("::", "r_name", "n_name", "c_name"), F.concat_ws("/", region, nation, segment(F.col("c_mktsegment")), F.lit("core")), F.lit("java"), line("c_custkey"), F.lit(9), F.col("c_acctbal") >= 0, no),
        node(supplier, "interface", F.col("s_suppkey"), "interface", F.col("s_name"), F.concat_ws("::", "r_name", "n_name", "s_name"), F.concat_ws("/", region, nation, F.lit("suppliers")), F.lit("kotlin"), line("s_suppkey"), F.lit(9), F.col("s_acctbal") >= 0, no),
        node(orders, "function", F.col("o_orderkey"), "function", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.concat(F.col("c_name"), F.lit("::order_"), F.col("o_orderkey").cast("string")), F.col("file_path"), lang4(F.col("o_orderkey")), line("o_orderkey"), F.lit(4), F.col("o_orderstatus") == "O", no),
        node(read(spark, sf_dir, "part"), "method", F.col("p_partkey"), "method", F.replace("p_name", F.lit(" "), F.lit("_")), F.concat_ws("::", F.replace("p_brand", F.lit("#"), F.lit("_")), "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))), F.concat_ws("/", F.lit("parts"), F.lower("p_brand"), F.lower("p_type")), lang4(F.col("p_size")), line("p_partkey"), F.col("p_size"), F.col("p_size") % 2 == 0, F.col("p_size") % 5 == 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return conform(out, NODES)


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("contains", "calls", "references", "extends", "imports"), near: str | None = None) -> DataFrame:
    """Only the tables of the wanted kinds are read; with ``near``, a node's id, only
    rows of which it is an end: its key is compared with the tables' own columns, so
    the comparison reaches the Parquet scan."""
    at, _, number = near.partition(":") if near else ("", "", "")

    def edge(df, kind, a, source, b, target, line=None):
        if near:
            mine = F.lit(False)
            for prefix, key in ((a, source), (b, target)):
                mine = mine | (key == int(number)) if prefix == at else mine
            df = df.filter(mine)
        return df.select(
            F.concat(F.lit(f"{a}:"), source.cast("string")).alias("source"), F.concat(F.lit(f"{b}:"), target.cast("string")).alias("target"),
            F.lit(kind).alias("kind"), (F.lit(None) if line is None else line).cast("int").alias("line"),
        )

    c = F.col
    lines = read(spark, sf_dir, "lineitem")
    n = read(spark, sf_dir, "nation")
    by_kind = {
        "contains": [
            edge(n, "contains", "module", c("n_regionkey"), "namespace", c("n_nationkey")),
            edge(read(spark, sf_dir, "customer"), "contains", "namespace", c("c_nationkey"), "class", c("c_custkey")),
            edge(read(spark, sf_dir, "supplier"), "contains", "namespace", c("s_nationkey"), "interface", c("s_suppkey")),
            edge(read(spark, sf_dir, "orders"), "contains", "class", c("o_custkey"), "function", c("o_orderkey")),
        ],
        "calls": [edge(lines.select("l_orderkey", "l_partkey", "l_linenumber").distinct(), "calls", "function", c("l_orderkey"), "method", c("l_partkey"), c("l_linenumber"))],
        "references": [edge(lines.select("l_partkey", "l_suppkey").distinct(), "references", "method", c("l_partkey"), "interface", c("l_suppkey"))],
        "extends": [edge(read(spark, sf_dir, "part").filter(F.floor(c("p_partkey") / 2) >= 1), "extends", "method", c("p_partkey"), "method", F.floor(c("p_partkey") / 2).cast("long"))],
        "imports": [edge(n, "imports", "namespace", c("n_nationkey"), "namespace", (c("n_nationkey") * c("n_nationkey") + 1) % 25)],
    }
    out = None
    for k in kinds:
        for e in by_kind[k]:
            out = e if out is None else out.unionByName(e)
    return conform(out, EDGES)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending references of every fifth order to a part by name."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"), F.concat_ws("::", F.replace("p_brand", F.lit("#"), F.lit("_")), "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("q"))
    total = part.agg(F.count(F.lit(1)).alias("total"))
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").filter(k % 5 == 0).join(F.broadcast(total)).withColumn("p_partkey", k % F.col("total"))  # one row
    o = o.join(part, "p_partkey")
    name = F.when(k % 11 == 0, F.concat(F.substring("n", 1, 1), F.substr("n", F.lit(3)))).when(k % 7 == 0, F.col("q")).otherwise(F.col("n"))
    return conform(
        o.select(
            k.alias("ref_id"), F.concat(F.lit("function:"), k.cast("string")).alias("from_node_id"), name.alias("reference_name"),
            F.when(F.col("o_orderpriority").startswith("1"), "references").otherwise("calls").alias("reference_kind"), (k % 997 + 1).cast("int").alias("line"), F.lit(0).alias("col"),
            F.concat(F.lit("parts/brand_"), (k % 25 + 1).cast("string"), F.lit("/small")).alias("file_path"), lang4(k).alias("language"), F.lit("pending").alias("status"),
            F.regexp_extract(name, r"([^.:]*)$", 1).alias("name_tail"),
        ),
        REFS,
    )


def files(node_rows: DataFrame) -> DataFrame:
    """One row for each path that nodes have."""
    by = node_rows.groupBy(F.col("file_path").alias("path")).agg(F.min("language").alias("language"), F.count(F.lit(1)).cast("int").alias("node_count"))
    return conform(by.withColumn("content_hash", F.sha2(F.col("path").cast("binary"), 256)), FILES)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    n = nodes(spark, sf_dir)
    return Graph(n, edges(spark, sf_dir), files(n), refs(spark, sf_dir))
