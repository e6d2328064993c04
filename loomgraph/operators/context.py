"""Retrieval for a task in prose: symbols, text, code, bounded by budgets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import CALL_KINDS, CALLABLE, Graph, det_order
from . import search as S
from .aggregates import blast_radius, file_pairs
from .algorithms import ordered_within, personal_rank
from .lookup import induced
from .storage import cut, stored
from .traverse import arcs, callees, callers, levels

# -- symbols in prose (patterns and common words are this library's own) --------

_SYMBOLS = (
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)+|[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+)\b",
    r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b",
    r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b",
    r"\b([A-Z]{2,})\b",
    r"\b([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)+)\b",
    r"`([^`\s]+)`",
    r"\b([A-Z][a-z]{2,})\b",
)
_COMMON = frozenset("The This That What Where When Why How Which Who Can Could Should Would Will Does Did Are Was Were Have Has Had And But For Not Use Add Fix Find Show API URL HTTP JSON".split())


def symbols(prose: str) -> list[str]:
    """What looks like a symbol in prose, in order of the patterns."""
    found = [m[1] for p in _SYMBOLS for m in re.finditer(p, prose)]
    more = [part for s in found if re.search(r"\.|::", s) for part in re.split(r"\.|::", s)]
    return [s for s in dict.fromkeys(found + more) if len(s) >= 2 and s not in _COMMON and s.lower() not in S.STOP_WORDS]


@dataclass(frozen=True)
class Options:
    limit: int = 8
    most_nodes: int = 50
    depth: int = 1
    least_score: float = 0.0
    kinds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Found:
    """Nodes (with score and root), the edges among them, and how sure it is."""

    nodes: DataFrame
    edges: DataFrame
    confidence: str


def merged(*channels: DataFrame) -> DataFrame:
    """(id, score): channels in one, the best score of each node."""
    every = channels[0].select("id", "score")
    for c in channels[1:]:
        every = every.unionByName(c.select("id", "score"))
    return every.groupBy("id").agg(F.max("score").alias("score"))


def boosted(hits: DataFrame, g: Graph, query: str, terms: list[str]) -> DataFrame:
    """(node columns, score): a node that n > 1 terms hit gains half its score for
    each; one hit alone keeps 60 %; plain words and tests keep 30 %."""
    n = hits.join(g.nodes, "id")
    place = F.lower(F.concat_ws(" ", "name", "file_path"))
    count = sum((F.contains(place, F.lit(t)).cast("int") for t in terms), F.lit(0))
    apart = [t.lower() for t in query.split() if not re.search(r"[_0-9]|^.+[A-Z]", t)]
    plain = F.lower("name").isin(*apart) if apart else F.lit(False)
    asks = "test" in query.lower() or "spec" in query.lower()
    factor = F.when(count > 1, 1 + 0.5 * count).otherwise(F.lit(0.6) if len(terms) > 1 else F.lit(1.0)) * F.when(plain, 0.3).otherwise(1.0)
    factor = factor if asks else factor * F.when(X.is_test("file_path"), 0.3).otherwise(1.0)
    core = F.when(F.col("file_path").rlike(r"(^|/)(src|lib|core|app|pkg|internal)/"), 25).otherwise(0)
    return n.withColumn("score", F.col("score") * factor + core)


def definitions_of(hits: DataFrame, g: Graph) -> DataFrame:
    """Hits on imports are replaced by what they import, if that is known."""
    to = g.edges.filter(F.col("kind").isin("imports", "exports")).groupBy(F.col("source").alias("id")).agg(F.min("target").alias("to"))
    kinds = g.nodes.filter(F.col("kind").isin("import", "export")).select("id", F.lit(True).alias("is_import"))
    got = hits.join(kinds, "id", "left").join(to, "id", "left")
    return got.select(F.when(F.col("is_import"), F.coalesce("to", "id")).otherwise(F.col("id")).alias("id"), "score").groupBy("id").agg(F.max("score").alias("score"))


def capped_by_file(nodes: DataFrame, most_nodes: int) -> DataFrame:
    """At most ``max(5, ceil(most_nodes / 5))`` of one file, roots first."""
    kind = F.when(F.col("kind").isin("class", "interface", "struct", "trait"), 2).when(F.col("kind").isin(*CALLABLE), 1).otherwise(0)
    return ordered_within(nodes, "file_path", F.desc("root"), F.desc("score"), F.desc(kind), "id", most=max(5, -(-most_nodes // 5)))


def relevant(g: Graph, query: str, options: Options = Options()) -> Found:
    """Nodes for a task in prose, with what is near them."""
    g = Graph(stored(g.nodes), g.edges, g.files, g.refs)  # every channel reads them
    terms = S.terms(query, with_stems=False)
    named = symbols(query)
    channels = [S.ranked(g.nodes, S.terms(query))] if terms else []
    if named:
        channels += [S.exact_names(g, named).select("id", (F.col("score") * 100).alias("score"))]
        low = F.lower("name")
        begins = F.lit(False)
        for s in named:
            begins |= low.startswith(s.lower())
        channels += [g.nodes.filter(begins & F.col("kind").isin("class", "interface", "struct", "trait", "function")).select("id", F.lit(15.0).alias("score"))]
    if not channels:
        empty = g.nodes.withColumn("score", F.lit(0.0)).withColumn("root", F.lit(True)).limit(0)
        return Found(empty, g.edges.limit(0), "none")
    hits = definitions_of(merged(*channels), g)
    ranked = boosted(hits, g, query, terms)
    ranked = ranked.filter(F.col("score") >= options.least_score)
    if options.kinds:
        ranked = ranked.filter(F.col("kind").isin(*options.kinds))
    roots = cut(ranked.orderBy(*det_order(F.desc("score"))).limit(options.limit))
    sure = bool(named) and not roots.filter(F.lower("name").isin(*[s.lower() for s in named])).isEmpty()
    near = levels(roots.select("id"), arcs(g, CALL_KINDS + ("extends", "implements"), "both"), options.depth, 20 * options.most_nodes)
    around = near.filter("depth > 0").join(g.nodes, "id").withColumn("score", 1.0 / (1 + F.col("depth"))).withColumn("root", F.lit(False)).drop("depth", "parent")
    every = roots.withColumn("root", F.lit(True)).unionByName(around.select(*roots.columns, "root"))
    kept = capped_by_file(every, options.most_nodes)
    w = Window.partitionBy("aside").orderBy(F.desc("root"), F.desc("score"), "id")  # of one answer
    kept = kept.withColumn("aside", X.is_test("file_path") | X.is_generated("file_path")).withColumn("_n", F.row_number().over(w))
    kept = kept.filter(~F.col("aside") | F.col("root") | (F.col("_n") <= max(1, int(0.15 * options.most_nodes)))).drop("aside", "_n")
    kept = cut(kept.orderBy(F.desc("root"), F.desc("score"), "id").limit(options.most_nodes))
    confidence = "high" if sure else "low"
    return Found(kept, induced(g, kept), confidence)


def code_blocks(found: DataFrame, contents: DataFrame, most: int = 5, size: int = 1500) -> DataFrame:
    """(id, file_path, start_line, source): of roots, then callables, then types."""
    order = F.when(F.col("root"), 0).when(F.col("kind").isin(*CALLABLE), 1).when(F.col("kind").isin("class", "interface", "struct"), 2).otherwise(3)
    top = found.orderBy(order, F.desc("score"), "id").limit(most)
    lines = F.slice(F.split("text", "\n"), F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    src = top.join(contents.select(F.col("path").alias("file_path"), "text"), "file_path")
    return src.select("id", "name", "file_path", "start_line", X.truncated_at_line(X.shown_source(F.array_join(lines, "\n")), size).alias("source"))


# -- text ---------------------------------------------------------------------


def numbered(contents: DataFrame, start: int = 1, count: int | None = None) -> DataFrame:
    """(path, line, text): lines from 1."""
    rows = contents.select("path", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")
    last = None if count is None else start + count - 1
    return rows.filter(F.col("line") >= start) if last is None else rows.filter(F.col("line").between(start, last))


def literal(contents: DataFrame, wanted: list[str], around: int = 2, most: int = 50, generated: bool = False) -> DataFrame:
    """(literal, path, line): lines that hold a literal, at most ``most`` of each.
    Texts without it are left out before they are split."""
    src = contents if generated else contents.filter(~X.is_generated("path"))
    rows = None
    for w in dict.fromkeys(wanted):
        own = src.filter(F.contains("text", F.lit(w)))
        hit = numbered(own).filter(F.contains("text", F.lit(w))).select(F.lit(w).alias("literal"), "path", "line", "text")
        hit = hit.orderBy("path", "line").limit(most)
        rows = hit if rows is None else rows.unionByName(hit)
    return rows


def windows(hits: DataFrame, around: int = 2, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(by, start, end): the lines around hits, windows that touch in one."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    each = hits.select(*by, F.greatest(F.col("line") - around, F.lit(1)).alias("start"), (F.col("line") + around).alias("end"))
    before = each.withColumn("_last", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = before.withColumn("_new", (F.col("_last").isNull() | (F.col("start") > F.col("_last") + 1)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return island.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def within_budget(rows: DataFrame, size: Column, order: list[Column], budget: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order while their sizes add up to ``budget`` at most."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_used", F.sum(size).over(w)).filter(F.col("_used") <= budget).drop("_used")


# -- views --------------------------------------------------------------------


def symbol_view(g: Graph, symbol: str, path: str | None = None, line: int | None = None) -> DataFrame:
    """(of, role, id): all nodes of the symbol, each with its distinct callers and
    callees, and its declarations and definitions."""
    own = S.exact(g, symbol, path=path, line=line, limit=64).select("id")
    own = cut(own)
    me = own.select(F.col("id").alias("of"), F.lit("self").alias("role"), "id")
    near = [callers(g, own).select("of", F.lit("caller").alias("role"), "id"), callees(g, own).select("of", F.lit("callee").alias("role"), "id")]
    pair = arcs(g, ("defines",), "both").join(own.select(F.col("id").alias("a")), "a").select(F.col("a").alias("of"), F.lit("definition").alias("role"), F.col("b").alias("id"))
    return me.unionByName(near[0]).unionByName(near[1]).unionByName(pair).distinct()


def file_view(g: Graph, contents: DataFrame, path: str, start: int = 1, count: int | None = None) -> DataFrame:
    """(line, text), lines of the file; of a configuration file only keys."""
    rows = numbered(contents.filter(F.col("path") == path), start, count)
    config = X.language_of("path").isin(*X.CONFIG_LANGUAGES)
    return rows.select("line", F.when(config, F.regexp_replace("text", r"([:=]\s*).*$", "$1")).otherwise(F.col("text")).alias("text")).orderBy("line")


def outline(g: Graph, path: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path") == path).select("start_line", "kind", "name", "id").orderBy("start_line", "id")


def manifest(g: Graph, contents: DataFrame, targets: list[dict]) -> DataFrame:
    """(target, role, id, detail): one to eight targets, each a symbol, the members
    of a symbol, or a text anchor; a target without rows says so, and a target
    that is expected to be missing says whether it is."""
    if not 1 <= len(targets) <= 8:
        raise ValueError("one to eight targets")
    out = None
    for i, t in enumerate(targets):
        if "text" in t:
            rows = literal(contents, [t["text"]]).select(F.lit("anchor").alias("role"), F.col("path").alias("id"), F.col("line").cast("string").alias("detail"))
        else:
            rows = S.exact(g, t["symbol"], path=t.get("path"), line=t.get("line")).select("id", "kind")
            if t.get("members"):
                m = g.edges.filter(F.col("kind") == "contains").join(rows.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
                rows = g.nodes.join(m, "id", "left_semi").select("id", "kind")
            rows = rows.select(F.lit("member" if t.get("members") else "symbol").alias("role"), "id", F.col("kind").alias("detail"))
        none = rows.isEmpty()
        if t.get("missing"):
            rows = g.spark.createDataFrame([("missing" if none else "unexpected", None, None)], "role string, id string, detail string")
        elif none:
            rows = g.spark.createDataFrame([("error", None, "not found")], "role string, id string, detail string")
        rows = rows.select(F.lit(i).alias("target"), "role", "id", "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def target(g: Graph, symbol: str, path: str | None = None, line: int | None = None, signature: str | None = None) -> tuple[str, DataFrame]:
    """What a relation is asked of: ``found`` with the overloads of one symbol,
    ``ambiguous`` with the candidates, or ``none``. An ambiguous symbol is not
    traversed."""
    rows = S.exact(g, symbol, path=path, line=line, limit=64)
    if signature is not None:
        rows = rows.filter(F.col("signature") == signature)
    rows = cut(rows)
    groups = rows.select("file_path", F.coalesce("qualified_name", "name").alias("q")).distinct().limit(2).count()
    return ("none" if not groups else "found" if groups == 1 else "ambiguous"), rows


def explore(g: Graph, query: str, most_files: int = 12, options: Options = Options()) -> DataFrame:
    """(path, named, mass, hits, score, symbols): the files that answer a question,
    best first: retrieval, then a walk from its roots over what was found."""
    found = relevant(g, query, options)
    rank = personal_rank(Graph(found.nodes, found.edges), found.nodes.filter("root").select("id"), rounds=25)
    terms = S.terms(query, with_stems=False)
    wanted = [s.lower() for s in symbols(query)]
    low = F.lower("name")
    role = F.when(low.isin(*wanted), 50) if wanted else F.when(F.lit(False), 50)
    role = role.when(F.col("root"), 10).otherwise(3)
    n = found.nodes.join(rank, "id")
    count = sum((F.contains(F.lower(F.concat_ws(" ", "name", "file_path")), F.lit(t)).cast("int") for t in terms), F.lit(0))
    by = n.groupBy(F.col("file_path").alias("path")).agg(
        F.max(low.isin(*wanted) if wanted else F.lit(False)).alias("named"), F.sum("rank").alias("mass"), F.max(count).alias("hits"), F.sum(role).cast("double").alias("score"),
        F.sort_array(F.collect_list(F.struct("start_line", "name", "kind"))).alias("symbols"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("size"),
    )
    from .aggregates import file_order

    return file_order(by).limit(most_files)


def affected(g: Graph, ids: DataFrame) -> DataFrame:
    return blast_radius(g, ids)


def dependents_of(g: Graph, path: str) -> DataFrame:
    return file_pairs(g).filter(F.col("target_file") == path).select(F.col("source_file").alias("path"))


# -- output -------------------------------------------------------------------


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def as_markdown(found: Found, blocks: DataFrame | None = None) -> str:
    """An answer as text; its size is bounded by the options it was made with."""
    out = [f"## Symbols ({found.confidence} confidence)", ""]
    for r in found.nodes.orderBy(F.desc("root"), F.desc("score"), "id").select("name", "kind", "file_path", "start_line").collect():
        out.append(f"- `{r['name']}` ({r['kind']}) {r['file_path']}:{r['start_line']}")
    if blocks is not None:
        for r in blocks.collect():
            out += ["", f"### {r['name']} {r['file_path']}:{r['start_line']}", "```", r["source"], "```"]
    return "\n".join(out)


def tree_rows(files: DataFrame) -> DataFrame:
    """(path, directory, depth, place): files and their directories; ``place`` sorts
    them as a tree, directories first, then by name."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))
    both = files.select("path", F.lit(False).alias("directory")).unionByName(files.select(F.explode(above).alias("path"), F.lit(True).alias("directory"))).distinct()
    mark = F.transform(parts, lambda part, i: F.concat(F.when((i == F.size(parts) - 1) & ~F.col("directory"), F.lit("1")).otherwise(F.lit("0")), part))
    return both.select("path", "directory", (F.size(parts) - 1).alias("depth"), F.array_join(mark, "/").alias("place"))


def as_tree(paths: Iterable[str]) -> str:
    """Paths as an indented tree: directories first, then by name."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("/")[:-1]:
            at = at.setdefault(part + "/", {})
        at[p.split("/")[-1]] = None

    def show(at: dict, depth: int) -> list[str]:
        lines = []
        for name in sorted(at, key=lambda k: (at[k] is None, k)):
            lines.append("  " * depth + name)
            lines += show(at[name], depth + 1) if at[name] is not None else []
        return lines

    return "\n".join(show(tree, 0))
