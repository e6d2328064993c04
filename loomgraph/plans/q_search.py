"""Queries: ranked, fuzzy and exact search, and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import search as S
from ..schema import Graph
from ..sources import tables as T
from .q_graph import graph
from .registry import query

_ORDER = "is_declaration, length(name), name, qualified_name, kind, file_path, start_line, id"


def _corpus(spark, sf):
    d = T.read(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("text").alias("docstring"))


def _bm25(terms, weights, source, key="id"):
    """Okapi BM25 in SQL over columns of ``source``."""
    cols = list(weights)
    toks = ", ".join(f"regexp_extract_all(lower(coalesce({c},'')), '[\\p{{L}}\\p{{N}}]+') AS t{i}" for i, c in enumerate(cols))
    hit = lambda i, p: f"len(list_filter(t{i}, lambda x: starts_with(x,'{p}')))"
    size = "+".join(f"len(t{i})" for i in range(len(cols)))
    n = ", ".join("+".join(hit(i, p) for i in range(len(cols))) + f" AS n{j}" for j, p in enumerate(terms))
    f = ", ".join("+".join(f"{hit(i, p)}*{weights[c]}" for i, c in enumerate(cols)) + f" AS f{j}" for j, p in enumerate(terms))
    stat = ", ".join(f"count(*) FILTER (WHERE n{j}>0) AS d{j}" for j in range(len(terms)))
    score = "+".join(f"greatest(ln((docs-d{j}+0.5)/(d{j}+0.5)),1e-6)*f{j}*2.2/(f{j}+1.2*(1-0.75+0.75*size/a))" for j in range(len(terms)))
    some = " OR ".join(f"n{j}>0" for j in range(len(terms)))
    return f"tok AS (SELECT {key}, {toks} FROM {source}), tf AS (SELECT {key}, {size} AS size, {n}, {f} FROM tok), st AS (SELECT count(*) AS docs, avg(size) AS a, {stat} FROM tf), bm AS (SELECT {key}, {score} AS score FROM tf, st WHERE {some})"


@query("t2s_ranked_text", f"{_bm25(['tion', 'ther', 'licens'], {'id': 0.0, 'name': 20.0, 'docstring': 1.0}, '(SELECT CAST(doc_id AS VARCHAR) AS id, source AS name, text AS docstring FROM documents)')} SELECT id, round(score,6) AS score FROM bm")
def _(spark, sf):
    return S.ranked(_corpus(spark, sf), ["tion", "ther", "licens"]).select("id", F.round("score", 6).alias("score"))


@query("t2s_ranked_nodes", f"{_bm25(['order', 'asia'], {'id': 0.0, 'name': 20.0, 'qualified_name': 5.0}, 'nodes')} SELECT id, round(score,6) AS score FROM bm")
def _(spark, sf):
    return S.ranked(graph(spark, sf, "imports").nodes, S.match_terms("order AND asia")).select("id", F.round("score", 6).alias("score"))


@query("t3s_substring", "SELECT id, CASE WHEN name='ASIA' THEN 1.0 WHEN lower(name) LIKE 'asia%' THEN 0.9 WHEN lower(name) LIKE '%asia%' THEN 0.8 WHEN lower(qualified_name) LIKE '%asia%' THEN 0.7 END::DOUBLE AS score FROM nodes WHERE lower(name) LIKE '%asia%' OR lower(qualified_name) LIKE '%asia%'")
def _(spark, sf):
    return S.substring(graph(spark, sf, "imports"), "ASIA").select("id", "score")


@query("t4s_j15_fuzzy", "near AS (SELECT *, levenshtein(lower(name),'order_12') AS d FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY " + _ORDER + ") AS k FROM near WHERE d<=2) SELECT id, name, round(1.0/(1+d),6) AS score FROM r WHERE k<=5")
def _(spark, sf):
    return S.fuzzy(graph(spark, sf, "imports"), "ORDER_12").select("id", "name", F.round("score", 6).alias("score"))


def _bonus(q, words, apart):
    a = f"WHEN lower(name) IN ({','.join(repr(w) for w in apart)}) THEN 60" if len(apart) > 1 else ""
    w = "WHEN " + " AND ".join(f"contains(lower(name),'{x}')" for x in words) + " THEN 15" if len(words) > 1 else ""
    return f"CASE WHEN lower(name)='{q}' THEN 80 {a} WHEN starts_with(lower(name),'{q}') THEN CAST(floor(10+30*({len(q)}/length(name))+0.5) AS INT) {w} WHEN contains(lower(name),'{q}') THEN 10 ELSE 0 END"


_KIND = "CASE kind WHEN 'function' THEN 10 WHEN 'method' THEN 10 WHEN 'class' THEN 8 WHEN 'interface' THEN 9 WHEN 'module' THEN 4 WHEN 'namespace' THEN 4 ELSE 0 END"


@query("t7s_name_bonus", f"SELECT id, CAST({_bonus('order_1', ['order'], ['order_1'])} AS BIGINT) AS one, CAST({_bonus('orderasia', ['order', 'asia'], ['order', 'asia'])} AS BIGINT) AS two FROM nodes")
def _(spark, sf):
    return graph(spark, sf, "imports").nodes.select("id", S.name_bonus("order_1").cast("long").alias("one"), S.name_bonus("Order Asia").cast("long").alias("two"))


@query("t8s_kind_bonus", f"SELECT id, CAST({_KIND} AS BIGINT) AS bonus FROM nodes")
def _(spark, sf):
    return graph(spark, sf, "imports").nodes.select("id", S.kind_bonus().cast("long").alias("bonus"))


def _in(parts, c):
    return "(" + " OR ".join(f"contains({c},'{p}')" for p in parts) + ")"


def _path(words):
    base, directory, low = "lower(string_split(file_path,'/')[-1])", "lower(CASE WHEN contains(file_path,'/') THEN regexp_replace(file_path,'/[^/]*$','') ELSE '.' END)", "lower(file_path)"
    parts = [f"CASE WHEN {_in(w, base)} THEN 10 ELSE 0 END + CASE WHEN {_in(w, directory)} THEN 5 WHEN {_in(w, low)} THEN 3 ELSE 0 END" for w in words]
    return "+".join(parts) + " - CASE WHEN contains(file_path,'/tests/') THEN 15 ELSE 0 END"


@query("t9s_path_relevance", f"SELECT id, CAST({_path([['asia'], ['core'], ['nationindex', 'nation', 'index']])} AS BIGINT) AS score FROM nodes")
def _(spark, sf):
    return graph(spark, sf, "imports").nodes.select("id", S.path_relevance("asia the core nationIndex").cast("long").alias("score"))


@query("t5s_search", f"{_bm25(['asia'], {'id': 0.0, 'name': 20.0, 'qualified_name': 5.0}, '(SELECT * FROM nodes WHERE kind IN (' + chr(39) + 'class' + chr(39) + ',' + chr(39) + 'namespace' + chr(39) + '))')}, s AS (SELECT n.*, bm.score + {_bonus('asia', ['asia'], ['asia'])} + {_KIND} + {_path([['asia']])} AS total FROM bm JOIN nodes n ON n.id=bm.id WHERE n.kind IN ('class','namespace')) SELECT id, round(total,6) AS score FROM s ORDER BY total DESC, {_ORDER} LIMIT 30")
def _(spark, sf):
    return S.search(graph(spark, sf, "imports"), "kind:class asia kind:namespace", limit=30).select("id", F.round("score", 6).alias("score"))


@query("t5s_search_fallback", f"near AS (SELECT *, levenshtein(lower(name),'order_7x') AS d FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {_ORDER}) AS k FROM near WHERE d<=2), s AS (SELECT *, 1.0/(1+d) + {_bonus('order_7x', ['order', '7x'], ['order_7x'])} + {_KIND} + {_path([['order_7x', 'order']])} AS total FROM r WHERE k<=5) SELECT id, round(total,6) AS score FROM s ORDER BY total DESC, {_ORDER} LIMIT 20")
def _(spark, sf):
    return S.search(graph(spark, sf, "imports"), "order_7x").select("id", F.round("score", 6).alias("score"))


@query("t6s_exact", f"SELECT id, name, 1.0::DOUBLE AS score FROM nodes WHERE name='ASIA' AND language='yaml' ORDER BY {_ORDER} LIMIT 20")
def _(spark, sf):
    return S.exact(graph(spark, sf, "imports"), "ASIA", languages=["yaml"]).select("id", "name", "score")


@query("t12s_exact_names", f"h AS (SELECT *, lower(name) AS q FROM nodes WHERE lower(name) IN ('order_7','asia','order_32','europe')), rare AS (SELECT q FROM h GROUP BY 1 HAVING count(*)<10), p AS (SELECT DISTINCT file_path, q AS other FROM h WHERE q IN (SELECT q FROM rare)), b AS (SELECT h.*, 1.0+CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.file_path=h.file_path AND p.other<>h.q) THEN 20.0 ELSE 0.0 END AS score FROM h) SELECT id, CAST(score AS DOUBLE) AS score FROM b")
def _(spark, sf):
    return S.exact_names(graph(spark, sf, "imports"), ["order_7", "ASIA", "order_32", "Europe"]).select("id", "score")


@query("t13s_l5_name_contains", f"SELECT id, name FROM nodes WHERE contains(lower(name),'der_1') AND NOT starts_with(lower(name),'der_1') ORDER BY length(name), {_ORDER} LIMIT 50")
def _(spark, sf):
    return S.name_contains(graph(spark, sf, "imports"), "der_1", prefixed=False).select("id", "name")


@query("t19s_tool_search", f"SELECT id, name FROM nodes WHERE lower(name)='europe' ORDER BY {_ORDER} LIMIT 20")
def _(spark, sf):
    return S.tool_search(graph(spark, sf, "imports"), "eUROPE")[1].select("id", "name")


def _contents(spark, sf):
    return T.read(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


_LINES = "lines AS (SELECT source||'/'||doc_id||'.txt' AS path, unnest(string_split(text,chr(10))) AS text, unnest(range(1, len(string_split(text,chr(10)))+1)) AS line FROM documents)"


@query("t18s_t22s_literal", f"{_LINES} SELECT 'License' AS literal, path, line FROM lines WHERE contains(text,'License') ORDER BY path, line LIMIT 50")
def _(spark, sf):
    return C.literal(_contents(spark, sf), ["License"]).select("literal", "path", F.col("line").cast("long").alias("line"))


@query("t24s_numbered_lines", f"{_LINES} SELECT path, line, text FROM lines WHERE line BETWEEN 2 AND 4")
def _(spark, sf):
    return C.numbered(_contents(spark, sf), 2, 3).select("path", F.col("line").cast("long").alias("line"), "text")


@query("t24s_outline", "SELECT start_line, kind, name, id FROM nodes WHERE file_path='asia/nation_12/suppliers'")
def _(spark, sf):
    return C.outline(graph(spark, sf, "imports"), "asia/nation_12/suppliers")


@query("t26s_bounded_lines", f"{_LINES}, s AS (SELECT path, line, sum(length(text)+1) OVER (PARTITION BY path ORDER BY line) AS used FROM lines) SELECT path, line FROM s WHERE used<=800")
def _(spark, sf):
    rows = C.within_budget(C.numbered(_contents(spark, sf)), F.char_length("text") + 1, [F.col("line")], 800, ("path",))
    return rows.select("path", F.col("line").cast("long").alias("line"))


@query("t23s_symbol_view", "o AS (SELECT id FROM nodes WHERE name='order_32' AND kind='function') SELECT id AS \"of\", 'self' AS role, id FROM o UNION SELECT source, 'callee', target FROM edges WHERE source IN (SELECT id FROM o) AND kind IN ('calls','references','imports') UNION SELECT target, 'caller', source FROM edges WHERE target IN (SELECT id FROM o) AND kind IN ('calls','references','imports')")
def _(spark, sf):
    return C.symbol_view(graph(spark, sf, "calls", "references", "imports"), "order_32")


@query("t21s_target", "SELECT id FROM nodes WHERE name='ASIA'")
def _(spark, sf):
    return C.target(graph(spark, sf, "imports"), "ASIA")[1].select("id")


@query("t25s_manifest", f"{_LINES}, a AS (SELECT 2 AS target, 'anchor' AS role, path AS id, CAST(line AS VARCHAR) AS detail FROM lines WHERE contains(text,'License') ORDER BY path, line LIMIT 50) SELECT 0 AS target, 'symbol' AS role, id, kind AS detail FROM nodes WHERE name='ASIA' UNION ALL SELECT 1, 'member', n.id, n.kind FROM edges e JOIN nodes n ON n.id=e.target JOIN nodes m ON m.id=e.source AND m.name='ASIA' WHERE e.kind='contains' UNION ALL SELECT * FROM a UNION ALL SELECT 3, 'missing', NULL, NULL UNION ALL SELECT 4, 'error', NULL, 'not found'")
def _(spark, sf):
    return C.manifest(graph(spark, sf, "contains"), _contents(spark, sf), [{"symbol": "ASIA"}, {"symbol": "ASIA", "members": True}, {"text": "License"}, {"symbol": "nowhere", "missing": True}, {"symbol": "nowhere"}])


@query("t15s_relevant")
def _(spark, sf):
    return C.relevant(graph(spark, sf), "how does order_32 reach suppliers in ASIA core").nodes.select("id", "root", F.round("score", 6).alias("score"))


@query("t16s_import_definitions", "h AS (SELECT id, CAST(start_line AS DOUBLE) AS score FROM nodes WHERE kind='namespace' OR kind='module') SELECT CASE WHEN h.id LIKE 'namespace%' THEN coalesce(e.target,h.id) ELSE h.id END AS id, max(h.score) AS score FROM h LEFT JOIN (SELECT source, min(target) AS target FROM edges WHERE kind='imports' GROUP BY 1) e ON e.source=h.id GROUP BY 1")
def _(spark, sf):
    g = graph(spark, sf, "imports")
    n = g.nodes.withColumn("kind", F.when(F.col("kind") == "namespace", "import").otherwise(F.col("kind")))
    hits = n.filter("kind in ('import', 'module')").select("id", F.col("start_line").cast("double").alias("score"))
    return C.definitions_of(hits, Graph(n, g.edges)).select("id", "score")


@query("t17s_code_blocks", "n AS (SELECT doc_id, source||'/'||doc_id||'.txt' AS file_path, text FROM documents) SELECT 'd:'||doc_id AS id, file_path, CASE WHEN length(s)<=300 THEN s WHEN contains(substr(s,1,300),chr(10)) THEN regexp_replace(substr(s,1,300), '\\n[^\\n]*\\z','') ELSE substr(s,1,300) END AS source FROM (SELECT *, array_to_string(string_split(text,chr(10))[1:3],chr(10)) AS s FROM n) ORDER BY id LIMIT 50")
def _(spark, sf):
    d = T.read(spark, sf, "documents")
    n = d.select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.lit("x").alias("name"), F.lit("function").alias("kind"), F.lit("text").alias("language"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), F.lit(True).alias("root"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("qualified_name"))
    return C.code_blocks(n, _contents(spark, sf), 50, 300).select("id", "file_path", "source")


@query("t20s_explore")
def _(spark, sf):
    return C.explore(graph(spark, sf), "order_32 callers in ASIA").select("path", "named", F.round("mass", 6).alias("mass"), "hits", "score")


@query("t28s_completeness", "SELECT count(*) AS files, count(*) FILTER (WHERE doc_id%5=0) AS failed_files, count(*) FILTER (WHERE doc_id%10=0) AS errors, count(*) FILTER (WHERE doc_id%10=5) AS warnings, count(*) FILTER (WHERE doc_id%5=0)=0 AS complete FROM documents", graph=False)
def _(spark, sf):
    from ..operators.aggregates import completeness

    bad = F.array(F.named_struct(F.lit("message"), F.lit("x"), F.lit("severity"), F.when(F.col("doc_id") % 10 == 0, "error").otherwise("warning")))
    f = T.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 5 == 0, bad).alias("errors"))
    return completeness(f)
