"""Traversals: levels of joins on the driver's loop, each level distributed.

A level is a join of the frontier with the edges and an anti-join with what was
visited. Results hold each node once, at its least depth, so they do not depend
on the order of edges. Levels are cut in the shared checkpoint folder, since
executors may be lost; shallow traversals are unrolled and need no cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CALL_KINDS, CONTAINERS, HIERARCHY_KINDS, Graph
from .storage import cut, sent, stored

#: Levels that are unrolled into one plan.
UNROLLED = 3


def seed(g: Graph, ids: str | Iterable[str] | DataFrame) -> DataFrame:
    """(id) of the nodes to start from."""
    if isinstance(ids, DataFrame):
        return ids.select("id").distinct()
    ids = [ids] if isinstance(ids, str) else list(ids)
    return g.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")


def arcs(g: Graph, kinds: Iterable[str] = (), direction: str = "outgoing", where: Column | None = None) -> DataFrame:
    """(a, b): steps along edges, against them, or both ways."""
    e = g.edges.filter(F.col("kind").isin(*kinds)) if (kinds := list(kinds)) else g.edges
    e = e if where is None else e.filter(where)
    out, back = e.select(F.col("source").alias("a"), F.col("target").alias("b")), e.select(F.col("target").alias("a"), F.col("source").alias("b"))
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)


def onward(steps: DataFrame, front: DataFrame, n: int | None = None) -> DataFrame:
    """Steps (a, b) from what is in ``front`` (id), of ``n`` rows. A semi-join with few
    ids is pushed below unions and distinct rows into the scans of the tables."""
    a = front.select(F.col("id").alias("a"))
    return steps.join(a if n is None else sent(a, n), "a", "left_semi")


def levels(start: DataFrame, steps: DataFrame, most: int | None = None, limit: int | None = None, expand: Column | None = None, enough: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """(id, depth, parent): what ``steps`` reach from ``start``, at least depth.

    ``expand`` restricts which nodes are gone on from. With ``limit`` no level is
    begun once so many nodes are found, and the deepest level is cut short in
    order of id. ``enough`` may end the search after a level.
    """
    seen = start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    unrolled = most is not None and most <= UNROLLED and limit is None and expand is None
    seen = seen if unrolled else cut(seen)
    front, found, depth = seen, seen, 0
    width = total = None if unrolled else seen.count()
    while most is None or depth < most:
        depth += 1
        begin = front if expand is None else front.filter(expand | (F.col("depth") == 0))
        near = onward(steps, begin, width).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        old = found.select("id")
        new = near.join(old if unrolled else sent(old, total), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent")
        if not unrolled:
            new = cut(new)
            width = new.count()
            if not width:
                break
            if limit is not None:
                room = limit - total
                if width >= room:
                    return found.unionByName(new.orderBy("id").limit(max(room, 0)))
            total += width
        found, front = found.unionByName(new), new
        if not unrolled and depth % 8 == 0:
            found = cut(found)
        if enough is not None and enough(found):
            break
    return found


def bfs(g: Graph, start: str, most: int | None = None, kinds: Iterable[str] = (), node_kinds: Iterable[str] = (), direction: str = "outgoing", limit: int | None = 1000, include_start: bool = True) -> DataFrame:
    """(id, depth, parent). ``node_kinds`` restricts the nodes that are met, but
    for the start."""
    steps = arcs(g, kinds, direction)
    if node_kinds := list(node_kinds):
        steps = steps.join(g.nodes.filter(F.col("kind").isin(*node_kinds)).select(F.col("id").alias("b")), "b", "left_semi")
    else:
        steps = steps.join(g.nodes.select(F.col("id").alias("b")), "b", "left_semi")
    out = levels(seed(g, start), steps, most, limit)
    return out if include_start else out.filter("depth > 0")


def depth_first(g: Graph, start: str, most: int | None = None, kinds: Iterable[str] = (), direction: str = "outgoing", bound: int = 20_000_000) -> DataFrame:
    """(id, place) in depth-first order, neighbours in order of id. The order is
    sequential by nature: the steps of the reachable subgraph are brought to the driver
    as pairs of numbers, 16 bytes each, and the ids stay where they are. Raises if these
    are more than ``bound``; take :func:`bfs` for such."""
    import numpy as np
    import pyarrow as pa

    steps = arcs(g, kinds, direction)
    # numbers in order of id
    ids = stored(levels(seed(g, start), steps, most).select("id").orderBy("id").withColumn("n", F.monotonically_increasing_id()))
    near = onward(steps, ids, ids.count()).distinct().join(ids.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(ids.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").select("na", "nb")
    near = cut(near)
    if near.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} steps can be taken from {start}")
    n = np.sort(ids.select("n").toArrow()["n"].to_numpy())
    pairs = near.toArrow()
    a, b = np.searchsorted(n, pairs["na"].to_numpy()), np.searchsorted(n, pairs["nb"].to_numpy())
    del pairs
    order = np.lexsort((-b, a))  # last neighbour first, as it goes onto a stack
    b, first = b[order], np.searchsorted(a[order], np.arange(len(n) + 1))
    del a, order
    todo = [(int(np.searchsorted(n, ids.filter(F.col("id") == start).first()["n"])), 0)]
    known, out = bytearray(len(n)), []
    while todo:
        at, depth = todo.pop()
        if known[at]:
            continue
        known[at] = 1
        out.append(at)
        if most is None or depth < most:
            todo += [(x, depth + 1) for x in b[first[at] : first[at + 1]].tolist() if not known[x]]
    places = g.spark.createDataFrame(pa.table({"n": n[np.array(out)], "place": np.arange(len(out))}))
    return ids.join(places, "n").select("id", "place")


def dfs(g: Graph, start: str, most: int | None = None, kinds: Iterable[str] = (), direction: str = "outgoing") -> list[str]:
    """Ids in depth-first order, as a list; :func:`depth_first` leaves them distributed."""
    return [r["id"] for r in depth_first(g, start, most, kinds, direction).orderBy("place").collect()]


def callers(g: Graph, ids: str | Iterable[str] | DataFrame, depth: int = 1) -> DataFrame:
    """Depth 1: one row for each call site (id, source node's columns, kind, line),
    self-loops left out. Deeper: (id, depth) at least depth."""
    return _calls(g, ids, depth, "target", "source")


def callees(g: Graph, ids: str | Iterable[str] | DataFrame, depth: int = 1) -> DataFrame:
    return _calls(g, ids, depth, "source", "target")


def _calls(g: Graph, ids, depth: int, near: str, far: str) -> DataFrame:
    if depth == 1:
        e = g.edges.filter(F.col("kind").isin(*CALL_KINDS) & (F.col("source") != F.col("target")))
        if isinstance(ids, str):
            e = e.filter(F.col(near) == ids)
        else:
            e = e.join(seed(g, ids).withColumnRenamed("id", near), near, "left_semi")
        e = e.select(F.col(near).alias("of"), F.col(far).alias("id"), F.col("kind").alias("edge_kind"), F.col("line").alias("edge_line"))
        return e.join(g.nodes, "id")
    found = levels(seed(g, ids), arcs(g, CALL_KINDS, "incoming" if near == "target" else "outgoing"), depth)
    return found.filter("depth > 0").select("id", "depth")


def call_graph(g: Graph, node_id: str, depth: int = 2) -> DataFrame:
    """(id, depth): negative depths call the node, positive ones are called."""
    up = levels(seed(g, node_id), arcs(g, CALL_KINDS, "incoming"), depth).select("id", (-F.col("depth")).alias("depth"))
    down = levels(seed(g, node_id), arcs(g, CALL_KINDS), depth).filter("depth > 0").select("id", "depth")
    return up.unionByName(down).groupBy("id").agg(F.min_by("depth", F.struct(F.abs("depth"), "depth")).alias("depth"))


def hierarchy(g: Graph, node_id: str, direction: str = "both") -> DataFrame:
    """(id, depth): supertypes have positive, subtypes negative depths. ``both`` is
    the union of the two directions, ``up`` the supertypes alone."""
    up = levels(seed(g, node_id), arcs(g, HIERARCHY_KINDS)).select("id", "depth")
    if direction == "up":
        return up
    down = levels(seed(g, node_id), arcs(g, HIERARCHY_KINDS, "incoming")).select("id", (-F.col("depth")).alias("depth"))
    return down if direction == "down" else up.unionByName(down.filter("depth < 0"))


def usages(g: Graph, node_id: str) -> DataFrame:
    """One row for each incoming edge, of any kind."""
    e = g.edges.filter(F.col("target") == node_id).select(F.col("source").alias("id"), F.col("kind").alias("edge_kind"), F.col("line").alias("edge_line"))
    return e.join(g.nodes, "id")


def impact(g: Graph, node_id: str | Iterable[str], depth: int = 3) -> DataFrame:
    """(id, depth): what may break, by any of the nodes. Edges but containment count one against their
    direction; the members of a container come with it at no cost."""
    steps = arcs(g, direction="incoming", where=F.col("kind") != "contains")
    owners = g.nodes.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("a"), F.col("id").alias("b"))
    members = arcs(g, ("contains",))

    def closed(found: DataFrame, front: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
        while True:  # members of members
            own = cut(onward(owners, front, front.count()).select(F.col("a").alias("id")).distinct())
            n = own.count()
            if not n:
                return found, found.filter(F.col("depth") == at)
            more = cut(onward(members, own, n).select(F.col("b").alias("id")).distinct().join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(at)))
            if more.isEmpty():
                return found, found.filter(F.col("depth") == at)
            found, front = cut(found.unionByName(more)), more

    found = cut(seed(g, node_id).withColumn("depth", F.lit(0)))
    found, front = closed(found, found, 0)
    for at in range(1, depth + 1):
        new = onward(steps, front, front.count()).select(F.col("b").alias("id")).distinct().join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(at))
        new = cut(new)
        if new.isEmpty():
            break
        found, front = closed(found.unionByName(new), new, at)
    return found


def impact_of_all(g: Graph, ids: Iterable[str], depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """What may break by any of several nodes, as overloads of a name: (id, depth) at
    least depth, and the edges among them, each (source, target, kind) once."""
    found = impact(g, ids, depth)
    ends = found.select("id")
    edges = g.edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return found, edges.dropDuplicates(["source", "target", "kind"])


def structural(edges: DataFrame) -> DataFrame:
    """Edges with ``priority``, by which traversals that stop early take them: nesting
    first, then calls, then the rest."""
    return edges.withColumn("priority", F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2))


def path(g: Graph, start: str, end: str, kinds: Iterable[str] = ()) -> DataFrame:
    """(step, id) of a shortest path, ties by least ids; no row if there is none."""
    spark = g.spark
    if start == end:
        return spark.createDataFrame([(0, start)], "step int, id string").join(g.nodes.select("id"), "id", "left_semi").select("step", "id")
    found = levels(seed(g, start), arcs(g, kinds), enough=lambda f: not f.filter(F.col("id") == end).isEmpty())
    found = cut(found)
    # the path back is one row for each level
    at, steps = end, []
    while at is not None:
        row = found.filter(F.col("id") == at).first()
        if row is None:
            return spark.createDataFrame([], "step int, id string")
        steps.append((row["depth"], at))
        at = row["parent"]
    return spark.createDataFrame(steps[::-1], "step int, id string")


def parents(g: Graph) -> DataFrame:
    """(id, parent): the first container of each node, by id."""
    return g.edges.filter(F.col("kind") == "contains").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))


def ancestors(g: Graph, ids: str | Iterable[str] | DataFrame) -> DataFrame:
    """(of, id, depth): the containers of each node, nearest first; safe in loops."""
    up = cut(parents(g))
    at = seed(g, ids).select(F.col("id").alias("of"), "id")
    found = None
    trail = cut(at.withColumn("trail", F.array("id")))
    depth = 0
    while True:  # ends, as no trail meets a node twice
        depth += 1
        trail = trail.join(up, "id").filter(~F.array_contains("trail", F.col("parent"))).select("of", F.col("parent").alias("id"), F.array_append("trail", F.col("parent")).alias("trail"))
        trail = cut(trail)
        if trail.isEmpty():
            break
        row = trail.select("of", "id", F.lit(depth).alias("depth"))
        found = row if found is None else found.unionByName(row)
    return found if found is not None else trail.select("of", "id", F.lit(0).alias("depth")).limit(0)


def children(g: Graph, node_id: str) -> DataFrame:
    ids = g.edges.filter((F.col("kind") == "contains") & (F.col("source") == node_id)).select(F.col("target").alias("id"))
    return g.nodes.join(ids.distinct(), "id", "left_semi")


def context(g: Graph, node_id: str) -> DataFrame:
    """(role, id, edge_kind): the focal node, its ancestors and children, what
    refers to it and what it refers to, its types, and its file's imports."""
    focal = g.nodes.filter(F.col("id") == node_id)
    if focal.isEmpty():
        raise KeyError(node_id)
    none = F.lit(None).cast("string").alias("edge_kind")
    links = g.edges.filter(F.col("kind") != "contains")
    into = links.filter(F.col("target") == node_id).select(F.lit("incoming").alias("role"), F.col("source").alias("id"), F.col("kind").alias("edge_kind"))
    out = links.filter(F.col("source") == node_id).select(F.lit("outgoing").alias("role"), F.col("target").alias("id"), F.col("kind").alias("edge_kind"))
    types = links.filter((F.col("source") == node_id) & F.col("kind").isin("type_of", "returns")).select(F.lit("type").alias("role"), F.col("target").alias("id"), none).distinct()
    imports = g.nodes.filter(F.col("kind") == "import").join(focal.select("file_path"), "file_path", "left_semi").select(F.lit("import").alias("role"), "id", none)
    parts = [focal.select(F.lit("focal").alias("role"), "id", none), ancestors(g, node_id).select(F.lit("ancestor").alias("role"), "id", none), children(g, node_id).select(F.lit("child").alias("role"), "id", none), into, out, types, imports]
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return done


def affected_tests(g: Graph, changed: Iterable[str], test: Column | None = None, depth: int = 5) -> DataFrame:
    """(path, test): what depends on the changed files. Test files are met but not
    gone on from; a changed test file is in the result."""
    from ..functions import text as X
    from .aggregates import file_pairs

    pairs = cut(file_pairs(g)).select(F.col("target_file").alias("a"), F.col("source_file").alias("b"))
    test = X.is_test("id") if test is None else test
    start = seed(g, changed)
    found = levels(start.filter(~test), pairs, depth, expand=~test).filter("depth > 0").select("id")
    return found.unionByName(start.filter(test)).distinct().select(F.col("id").alias("path"), test.alias("test"))
