"""Counts, projections onto files, gates and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import CALL_KINDS, Graph, det_order




def stats(g: Graph) -> DataFrame:
    """One row: nodes, edges and files, with a map of counts for each grouping."""

    def total(df: DataFrame, by: str, count: str, name: str) -> DataFrame:
        each = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
        return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(count), F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(name))

    n = total(g.nodes, "kind", "node_count", "nodes_by_kind")
    e = total(g.edges, "kind", "edge_count", "edges_by_kind")
    f = total(g.files, "language", "file_count", "files_by_language")
    return n.join(F.broadcast(e)).join(F.broadcast(f))  # a row each


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def last_indexed(files: DataFrame) -> DataFrame:
    return files.agg(F.max("indexed_at").alias("last_indexed_at"))


def distinct_names(g: Graph, paths: list[str] | None = None) -> DataFrame:
    nodes = g.nodes if paths is None else g.nodes.filter(F.col("file_path").isin(*paths))
    return nodes.select("name").distinct()


def languages(files: DataFrame) -> DataFrame:
    return files.select("language").distinct()


def edge_files(g: Graph, kinds: tuple[str, ...] | None = None, without: tuple[str, ...] = ("contains",)) -> DataFrame:
    """(source_file, target_file, kind, source, target) of each edge with both ends."""
    e = g.edges.filter(F.col("kind").isin(*kinds)) if kinds else g.edges
    e = e.filter(~F.col("kind").isin(*without)) if without else e
    n = g.nodes.select("id", "file_path")
    s = n.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"))
    t = n.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"))
    return e.select("source", "target", "kind").join(s, "source").join(t, "target")


def file_pairs(g: Graph) -> DataFrame:
    """Distinct (source_file, target_file) across files."""
    return edge_files(g).filter("source_file <> target_file").select("source_file", "target_file").distinct()


def file_dependencies(g: Graph, path: str) -> DataFrame:
    return file_pairs(g).filter(F.col("source_file") == path).select(F.col("target_file").alias("path"))


def file_dependents(g: Graph, path: str) -> DataFrame:
    return file_pairs(g).filter(F.col("target_file") == path).select(F.col("source_file").alias("path"))


def incoming_across(g: Graph, paths: list[str]) -> DataFrame:
    """Edges from other files into symbols of ``paths``, with what finds their
    target again: its name, kind and file."""
    t = g.nodes.filter(F.col("file_path").isin(*paths)).select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), F.col("file_path").alias("target_file"))
    s = g.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"))
    return g.edges.join(t, "target").join(s, "source").filter("source_file <> target_file")


def co_importers(g: Graph, paths: list[str]) -> DataFrame:
    """Files outside ``paths`` that import a name which a file in ``paths`` imports."""
    imports = g.nodes.filter(F.col("kind") == "import").select("file_path", "name")
    mine = imports.filter(F.col("file_path").isin(*paths)).select("name").distinct()
    return imports.join(mine, "name", "left_semi").filter(~F.col("file_path").isin(*paths)).select(F.col("file_path").alias("path")).distinct()


def dominant_file(g: Graph, least: int = 20, top: int = 20) -> DataFrame:
    """At most one row: the file with the most edges inside it, and the next one's
    count. Low-value files are left out of the ``top``; under ``least`` edges none."""
    inside = edge_files(g, without=()).filter("source_file = target_file").groupBy(F.col("source_file").alias("file_path")).agg(F.count(F.lit(1)).alias("edge_count"))
    ranked = inside.orderBy(F.desc("edge_count"), "file_path").limit(top).filter(~X.is_low_value("file_path"))
    w = Window.orderBy(F.desc("edge_count"), "file_path")  # over ``top`` rows
    return ranked.withColumn("next_edge_count", F.lead("edge_count").over(w)).orderBy(F.desc("edge_count"), "file_path").limit(1).filter(F.col("edge_count") >= least)


def top_route_file(g: Graph, top: int = 20) -> DataFrame:
    """The file with the most routes: of three at least, with a share of 30 % at
    least of what the ``top`` files have after low-value ones are left out."""
    routes = g.nodes.filter(F.col("kind") == "route").groupBy("file_path").agg(F.count(F.lit(1)).alias("routes"))
    rows = routes.orderBy(F.desc("routes"), "file_path").limit(top).filter(~X.is_low_value("file_path"))
    rows = rows.withColumn("total", F.sum("routes").over(Window.partitionBy()))  # over ``top`` rows
    best = rows.orderBy(F.desc("routes"), "file_path").limit(1)
    return best.filter((F.col("total") >= 3) & (F.col("routes") >= 3) & (F.col("routes") >= 0.3 * F.col("total")))


def routing_manifest(g: Graph, limit: int = 200, least: int = 3) -> DataFrame:
    """(route, handler, handler_kind, file_path, line): the limit comes before the
    filter of low-value files, and fewer than ``least`` rows are none."""
    r = g.nodes.filter(F.col("kind") == "route").select(F.col("id").alias("source"), F.col("name").alias("route"))
    h = g.nodes.filter(F.col("kind").isin("function", "method", "class", "component")).select(F.col("id").alias("target"), F.col("name").alias("handler"), F.col("kind").alias("handler_kind"), "file_path", F.col("start_line").alias("line"))
    e = g.edges.filter(F.col("kind").isin("references", "calls")).select("source", "target")
    rows = e.join(r, "source").join(h, "target").select("route", "handler", "handler_kind", "file_path", "line").distinct()
    rows = rows.orderBy("route", "handler", "file_path", "line").limit(limit).filter(~X.is_low_value("file_path"))
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).filter(F.col("_n") >= least).drop("_n")  # over ``limit`` rows


def node_metrics(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(id, incoming, outgoing, calls, callers, children): one aggregation of the
    edges seen from both ends."""
    ends = g.edges.select(F.col("source").alias("id"), "kind", F.lit(True).alias("out")).unionByName(g.edges.select(F.col("target").alias("id"), "kind", F.lit(False).alias("out")))
    ends = ends if ids is None else ends.join(ids.select("id").distinct(), "id", "left_semi")
    out, calls = F.col("out"), F.col("kind") == "calls"
    got = ends.groupBy("id").agg(F.count_if(~out).alias("incoming"), F.count_if(out).alias("outgoing"), F.count_if(out & calls).alias("calls"), F.count_if(~out & calls).alias("callers"), F.count_if(out & (F.col("kind") == "contains")).alias("children"))
    base = (g.nodes if ids is None else g.nodes.join(ids.select("id").distinct(), "id", "left_semi")).select("id")
    return base.join(got, "id", "left").fillna(0)


def modules(files: DataFrame) -> DataFrame:
    """(directory, paths): the root is ``.``."""
    return files.groupBy(X.dirname("path").alias("directory")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.desc("n"), "language")


def grouped_by_file(rows: DataFrame) -> DataFrame:
    """Nodes of a result by their file."""
    item = F.struct("start_line", "name", "kind", "id")
    return rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("symbols"))


def distinct_symbols_per_file(hits: DataFrame) -> DataFrame:
    """hits: (file_path, symbol). How many of the symbols each file has."""
    return hits.groupBy("file_path").agg(F.count_distinct("symbol").alias("symbols"))


def term_hits(hits: DataFrame) -> DataFrame:
    """hits: (id, term, score). How many terms hit a node, and its best score."""
    return hits.groupBy("id").agg(F.count_distinct("term").alias("terms"), F.max("score").alias("score"))


def failed_tails(refs: DataFrame, most: int = 500) -> DataFrame:
    """Name tails of failed references, but those that too many have."""
    return refs.filter((F.col("status") == "failed") & (F.col("name_tail") != "")).groupBy("name_tail").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)


def resolution_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolved_by").agg(F.count(F.lit(1)).alias("n"))


def blast_radius(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(id, callers, files, test_files): distinct callers of each node, and the
    distinct files they are in, apart by whether these are tests."""
    e = g.edges.filter(F.col("kind").isin(*CALL_KINDS) & (F.col("source") != F.col("target"))).select("source", F.col("target").alias("id")).distinct()
    e = e if ids is None else e.join(ids.select("id").distinct(), "id", "left_semi")
    c = g.nodes.select(F.col("id").alias("source"), "file_path")
    c = c.withColumn("test", X.is_test("file_path"))
    path = F.col("file_path")
    return e.join(c, "source").groupBy("id").agg(F.count(F.lit(1)).alias("callers"), F.count_distinct(F.when(~F.col("test"), path)).alias("files"), F.count_distinct(F.when(F.col("test"), path)).alias("test_files"))


def file_scores(nodes: DataFrame) -> DataFrame:
    """nodes: (file_path, role), role one of named, entry, connected, other."""
    weight = F.when(F.col("role") == "named", 50).when(F.col("role") == "entry", 10).when(F.col("role") == "connected", 3).otherwise(1)
    return nodes.groupBy("file_path").agg(F.sum(weight).alias("score"))


def file_mass(ranks: DataFrame, g: Graph) -> DataFrame:
    """ranks: (id, rank). The sum of ranks by file."""
    return ranks.join(g.nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.sum("rank").alias("mass"))


def file_order(files: DataFrame) -> DataFrame:
    """Rank files for display: named ones, then graph mass in steps of 1 % of the
    largest (a total order, unlike a comparison within 1 %), term hits, value,
    generated, score, size."""
    top = F.max("mass").over(Window.partitionBy())
    step = F.floor(F.col("mass") / F.when(top > 0, top * 0.01).otherwise(1.0))
    keyed = files.withColumn("_step", step)  # files of one answer
    return keyed.orderBy(F.desc("named"), F.desc("_step"), F.desc("hits"), X.is_low_value("path"), X.is_generated("path"), F.desc("score"), "size", "path").drop("_step")


def dead_code(g: Graph) -> DataFrame:
    """Functions, methods and classes that are not exported and that no edge but
    containment reaches; a self-loop counts as reaching."""
    used = g.edges.filter(F.col("kind") != "contains").select(F.col("target").alias("id")).distinct()
    own = g.nodes.filter(F.col("kind").isin("function", "method", "class") & ~F.coalesce("is_exported", F.lit(False)))
    return own.join(used, "id", "left_anti")


def polymorphic(g: Graph, least: int = 3) -> DataFrame:
    """Ids whose supertype has ``least`` subtypes or more."""
    up = g.edges.filter(F.col("kind").isin("extends", "implements")).select(F.col("source").alias("id"), "target").distinct()
    wide = up.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return up.join(wide, "target", "left_semi").select("id").distinct()


def evaluation(found: DataFrame, cases: DataFrame, edges: DataFrame | None = None, passing: float = 0.5) -> DataFrame:
    """found: (case_id, name, kind, file_path, rank); cases: (case_id, expected).
    Recall, reciprocal rank of the first expected name, and whether it passes."""
    want = cases.select("case_id", F.explode("expected").alias("e"))
    best = found.groupBy("case_id", "name").agg(F.min("rank").alias("rank"))
    got = want.join(best, (want["case_id"] == best["case_id"]) & (want["e"]["name"] == best["name"]), "left").select(want["case_id"], "rank")
    score = got.groupBy("case_id").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"))
    size = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("node_count"))
    out = score.join(size, "case_id", "left").fillna(0, ["node_count"]).withColumn("pass", F.col("recall") >= passing)
    if edges is not None:
        out = out.join(edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("edge_count")), "case_id", "left").fillna(0, ["edge_count"])
        out = out.withColumn("edge_density", F.when(F.col("node_count") > 0, F.col("edge_count") / F.col("node_count")).otherwise(0.0))
    return out


def completeness(files: DataFrame) -> DataFrame:
    """One row: files, those with errors, errors by class, and whether complete."""
    each = files.select("path", F.explode_outer("errors").alias("e"))
    return each.agg(
        F.count_distinct("path").alias("files"), F.count_distinct(F.when(F.col("e").isNotNull(), F.col("path"))).alias("failed_files"),
        F.count_if(F.col("e.severity") == "error").alias("errors"), F.count_if(F.col("e.severity") == "warning").alias("warnings"),
    ).withColumn("complete", (F.col("errors") == 0) & (F.col("warnings") == 0))


def definitions_first(nodes: DataFrame) -> DataFrame:
    """Nodes with ``place`` among those of their name: generated files last,
    definitions before declarations, then the total order."""
    late = X.is_generated("file_path").alias("_late")
    w = Window.partitionBy("name").orderBy("_late", *det_order())
    return nodes.select("*", late).withColumn("place", F.row_number().over(w)).drop("_late")
