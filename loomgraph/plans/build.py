"""Whole builds and incremental maintenance, as plans over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imports as I
from ..operators import resolve as R
from ..operators import synth
from ..operators.storage import add_edges, cut, delete_files, identity, insert_edges, insert_nodes, insert_refs, stored, upsert
from ..schema import EDGES, REFS, Graph, conform


def index(g: Graph, imports: I.Imports | None = None, source: DataFrame | None = None, claims: tuple[DataFrame, ...] = ()) -> Graph:
    """Resolve the pending references, then derive edges, then resolve what needed
    inheritance edges; what is left has failed and is kept for a retry.

    ``imports`` brings in what files import; ``source`` (id, file_path, text) of the
    callables lets rules over text take part; ``claims`` are rows (ref_id, target,
    confidence, resolved_by) of frameworks that know their own references."""
    g = Graph(stored(g.nodes), stored(identity(g.edges)), g.files, g.refs)
    waiting = g.refs.filter(F.col("status") == "pending")
    more = claims + ((I.strategy(g, imports),) if imports is not None else ())
    resolved = cut(R.final_gates(R.resolve(g, more), g))
    now = g.with_edges(add_edges(g, conform(R.promoted(resolved, g), EDGES)))
    now = now.with_edges(add_edges(now, synth.synthesize(now, source)))
    left = R.parked(waiting, resolved)
    late = cut(R.conformance(now, left))
    now = now.with_edges(add_edges(now, conform(R.promoted(late, now), EDGES)))
    failed = g.refs.filter(F.col("status") != "pending").unionByName(R.parked(left, late).select(*g.refs.columns))
    return Graph(now.nodes, now.edges, g.files, failed)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of files (path, content_hash[, size, modified_at]): added,
    modified, removed. Size and whole-second time are compared first where both
    sides have them; only then the hash."""
    o, n = old.alias("o"), new.alias("n")
    same_stat = F.lit(False)
    if {"size", "modified_at"} <= set(old.columns) & set(new.columns):
        same_stat = F.coalesce((F.col("o.size") == F.col("n.size")) & (F.floor(F.col("o.modified_at") / 1000) == F.floor(F.col("n.modified_at") / 1000)), F.lit(False))
    change = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(~same_stat & (F.col("o.content_hash") != F.col("n.content_hash")), "modified")
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("o.path", "n.path").alias("path"), change.alias("change")).filter("change is not null")


def rewire(saved: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """saved: edges into changed files, with target_name, target_kind, target_file
    and source_file. Edges to the sole node of that name and kind in the file, and
    the source files of the rest, which must be read again."""
    n = nodes.groupBy(F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_new"))
    got = saved.join(n, ["target_file", "target_name", "target_kind"], "left")
    found = got.filter("_n = 1").withColumn("target", F.col("_new"))
    lost = got.filter("_n is null or _n > 1").select(F.col("source_file").alias("path")).distinct()
    return conform(found, EDGES), lost


def resurrected(gone: DataFrame) -> DataFrame:
    """References again, from the metadata of edges whose target is gone."""
    m = F.col("metadata")
    return gone.filter(F.try_element_at(m, F.lit("reference")).isNotNull()).select(
        F.col("source").alias("from_node_id"), F.try_element_at(m, F.lit("reference")).alias("reference_name"), F.col("kind").alias("reference_kind"), "line", "col", F.lit("pending").alias("status")
    )


def sync(g: Graph, new_files: DataFrame, new: Graph) -> tuple[Graph, DataFrame]:
    """The graph after a change: ``new`` holds what was extracted from added and
    modified files. Also (path) of files that must be read again."""
    diff = cut(changes(g.files, new_files))
    touched = diff.filter("change <> 'added'").select("path")
    paths = touched.select(F.col("path").alias("target_file"))
    s = g.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"))
    t = g.nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), F.col("file_path").alias("target_file"))
    into = g.edges.join(t.join(paths, "target_file", "left_semi"), "target").join(s.join(touched.select(F.col("path").alias("source_file")), "source_file", "left_anti"), "source")
    into = cut(into)
    kept = delete_files(g, touched)
    nodes = cut(insert_nodes(kept.nodes, new.nodes))
    edges, again = rewire(into, nodes)
    base = Graph(nodes, kept.edges, upsert(kept.files, new_files.join(diff.filter("change <> 'removed'"), "path", "left_semi").select(*g.files.columns), "path"), kept.refs)
    joined = insert_edges(base, new.edges.select(*EDGES.names).unionByName(edges))
    return Graph(nodes, cut(joined), base.files, base.refs), again


def update(g: Graph, new_files: DataFrame, new: Graph, imports: I.Imports | None = None, source: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """:func:`sync`, and then the steps that leave the graph as a build from scratch
    would: the new references, those of edges whose target is gone, and failed ones
    that a new symbol may answer are pending again and resolved; derived edges are
    derived anew, as a change may take away what they rested on."""
    now, again = sync(g, new_files, new)
    refs = g.refs.limit(0) if now.refs is None else now.refs
    ends = now.nodes.select("id")
    lost = g.edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_anti")
    name = F.try_element_at(F.col("metadata"), F.lit("reference"))
    kept = now.edges.select("source", "kind", name.alias("reference_name")).filter("reference_name is not null")
    places = now.nodes.select(F.col("id").alias("from_node_id"), "file_path", "language")
    gone = resurrected(lost).join(kept.withColumnRenamed("source", "from_node_id").withColumnRenamed("kind", "reference_kind"), ["from_node_id", "reference_name", "reference_kind"], "left_anti").join(places, "from_node_id")
    gone = gone.withColumn("ref_id", F.xxhash64("from_node_id", "reference_name", "reference_kind", "line", "col"))
    retry = R.retryable(refs, new.nodes.select("name"))
    queue = refs.join(retry.select("ref_id"), "ref_id", "left_anti").select(*refs.columns).unionByName(retry.select(*refs.columns))
    for more in (new.refs, conform(gone, REFS)):
        queue = insert_refs(queue, more.select(*queue.columns)) if more is not None else queue
    plain = now.edges.filter(F.coalesce(F.col("provenance"), F.lit("")) != "heuristic")
    return index(Graph(now.nodes, cut(plain), now.files, cut(queue)), imports, source), again


def macro_readers(contents: DataFrame, changed: DataFrame) -> DataFrame:
    """contents: (path, text); changed: (name). Files that mention a changed macro."""
    words = contents.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9_]+)\b"), F.lit(1)))).alias("name"))
    return words.join(changed.select("name").distinct(), "name", "left_semi").select("path").distinct()


def annotated(rows: DataFrame, pending: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows with whether their file waits for a sync."""
    p = pending.select(F.col("path").alias(path), F.lit(True).alias("_p")).distinct()
    return rows.join(p, path, "left").withColumn("stale", F.coalesce("_p", F.lit(False))).drop("_p")
