"""Point, batch and filter lookups of nodes, edges and references."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import Graph, det_order

#: Values that are sent with a plan; longer lists become a table to join with.
INLINE = 1000
WILDCARD_KINDS = ("class", "interface", "function", "method", "struct", "trait", "enum", "module")


def by_id(g: Graph, node_id: str) -> DataFrame:
    return g.nodes.filter(F.col("id") == node_id)


def among(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; a semi-join beyond :data:`INLINE`."""
    values = list(dict.fromkeys(values))
    if len(values) <= INLINE:
        return df.filter(F.col(column).isin(*values)) if values else df.limit(0)
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return df.join(wanted, column, "left_semi")


def by_ids(g: Graph, ids: Iterable[str] | DataFrame) -> DataFrame:
    """Nodes of the given ids; missing ids are absent."""
    if isinstance(ids, DataFrame):
        return g.nodes.join(ids.select("id"), "id", "left_semi")
    return among(g.nodes, "id", ids)


def existing(g: Graph, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi")


def in_file(g: Graph, path: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")


def of_kind(g: Graph, kind: str) -> DataFrame:
    return g.nodes.filter(F.col("kind") == kind)


def of_name(g: Graph, name: str) -> DataFrame:
    return g.nodes.filter(F.col("name") == name)


def of_qualified_name(g: Graph, name: str) -> DataFrame:
    return g.nodes.filter(F.col("qualified_name") == name)


def of_lower_name(g: Graph, name: str) -> DataFrame:
    return g.nodes.filter(F.lower("name") == name.lower())


def decorated(g: Graph, language: str, decorator: str) -> DataFrame:
    return g.nodes.filter((F.col("language") == language) & F.array_contains("decorators", decorator))


ROOTS = ("crate", "super", "self")


def matches(symbol: str) -> Column:
    """Whether a node is what a bare or qualified symbol names: by name; by file
    stem; by a suffix of its qualified name that begins at a segment; or by its
    containers being segments of its path."""
    name, path = F.col("name"), F.col("file_path")
    out = (name == symbol) | (F.col("kind") == "file") & (F.regexp_replace("name", r"\.[^.]+$", "") == symbol)
    import re

    parts = [p for p in re.split(r"::|[./]", symbol) if p]
    if len(parts) < 2:
        return out
    wanted = "::".join(parts)
    actual = X.canonical(F.coalesce("qualified_name", "name"))
    suffix = (actual == wanted) | actual.endswith(f"::{wanted}")
    hints = [p for p in parts[:-1] if p not in ROOTS]
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    stems = F.transform(segments, lambda s: F.regexp_replace(s, r"\.[^.]+$", ""))
    inside = F.lit(bool(hints))
    for h in hints:
        inside &= F.array_contains(segments, h) | F.array_contains(stems, h)
    return out | name.isin(parts[-1], symbol) & (suffix | inside)


def of_symbol(g: Graph, symbol: str) -> DataFrame:
    return g.nodes.filter(matches(symbol)).dropDuplicates(["id"]).orderBy(*det_order())


def filtered(
    g: Graph, kinds: Iterable[str] = (), languages: Iterable[str] = (), paths: Iterable[str] = (), names: Iterable[str] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Filters alone, in the total order: kinds and languages by equality, paths
    and names by substring without regard to case."""
    out = g.nodes
    if kinds := list(kinds):
        out = out.filter(F.col("kind").isin(*kinds))
    if languages := list(languages):
        out = out.filter(F.col("language").isin(*languages))
    for column, values in (("file_path", list(paths)), ("name", list(names))):
        if values:
            cond = F.lit(False)
            for v in values:
                cond |= F.contains(F.lower(column), F.lit(v.lower()))
            out = out.filter(cond)
    if include or exclude:
        out = out.filter(X.path_globs("file_path", include, exclude))
    out = out.orderBy(*det_order())
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def spanning(g: Graph, path: str, line: int) -> DataFrame:
    return g.nodes.filter((F.col("file_path") == path) & F.lit(line).between(F.col("start_line"), F.col("end_line")))


def wildcard(g: Graph, pattern: str, kinds: tuple[str, ...] = WILDCARD_KINDS) -> DataFrame:
    """Nodes whose whole qualified name matches ``*`` and ``?``."""
    return g.nodes.filter(F.col("kind").isin(*kinds) & F.col("qualified_name").rlike(X.wildcard_regex(pattern)))


def exported(g: Graph, path: str) -> DataFrame:
    return g.nodes.filter((F.col("file_path") == path) & F.col("is_exported"))


def files_under(files: DataFrame, prefix: str | None = None, pattern: str | None = None) -> DataFrame:
    """Files at or below a path, and those in which a pattern occurs anywhere."""
    out = files
    if prefix:
        p = prefix.removeprefix("./").rstrip("/")
        out = out.filter((F.col("path") == p) | F.col("path").startswith(p + "/"))
    if pattern:
        out = out.filter(F.col("path").rlike(X.glob_regex(pattern, anchored=False)))
    return out.orderBy("path")


def out_edges(g: Graph, node_id: str, kinds: Iterable[str] = (), provenance: str | None = None) -> DataFrame:
    return _edges(g, "source", node_id, kinds, provenance)


def in_edges(g: Graph, node_id: str, kinds: Iterable[str] = (), provenance: str | None = None) -> DataFrame:
    return _edges(g, "target", node_id, kinds, provenance)


def _edges(g: Graph, side: str, node_id: str, kinds: Iterable[str], provenance: str | None) -> DataFrame:
    out = g.edges.filter(F.col(side) == node_id)
    if kinds := list(kinds):
        out = out.filter(F.col("kind").isin(*kinds))
    return out if provenance is None else out.filter(F.col("provenance") == provenance)


def induced(g: Graph, ids: DataFrame, kinds: Iterable[str] = ()) -> DataFrame:
    """Edges with both ends among ``ids``."""
    edges = g.edges.filter(F.col("kind").isin(*kinds)) if (kinds := list(kinds)) else g.edges
    keys = ids.select("id").distinct()
    out = edges.join(keys.withColumnRenamed("id", "source"), "source", "left_semi")
    return out.join(keys.withColumnRenamed("id", "target"), "target", "left_semi")


def subgraph(g: Graph, predicate: Column | str) -> Graph:
    """Nodes by any predicate (a column, SQL, or a pandas UDF), with their edges."""
    nodes = g.nodes.filter(predicate)
    return Graph(nodes, induced(g, nodes), g.files, g.refs)


def pending(refs: DataFrame, paths: Iterable[str] | None = None, name: str | None = None, after: int | None = None, most: int | None = None) -> DataFrame:
    """Pending references: of some files, of a name, or a page in order of id."""
    out = refs.filter(F.col("status") == "pending")
    if paths is not None:
        out = among(out, "file_path", paths)
    if name is not None:
        out = out.filter(F.col("reference_name") == name)
    if after is not None:
        out = out.filter(F.col("ref_id") > after)
    return out if most is None else out.orderBy("ref_id").limit(most)


def stale(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files whose content differs from the given (path, content_hash)."""
    now = hashes.select("path", F.col("content_hash").alias("now"))
    return files.join(now, "path").filter(F.col("content_hash") != F.col("now")).select("path")


def code(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, source): the lines of each node, from contents (path, text)."""
    got = nodes.join(contents.select(F.col("path").alias("file_path"), "text"), "file_path")
    source = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return got.select("id", X.shown_source(source).alias("source"))
