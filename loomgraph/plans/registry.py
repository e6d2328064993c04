"""Registered queries: (spark, sf_dir) -> DataFrame, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PATH = "lower(r_name)||'/'||lower(n_name)||'/'"
_SEG = "CASE WHEN c_mktsegment='MACHINERY' THEN 'tests' ELSE lower(c_mktsegment) END"
_PART_NAME = "replace(p_name,' ','_')"
_PART_QUALIFIED = f"replace(p_brand,'#','_')||'::'||p_type||'::'||{_PART_NAME}"


def _lang(k: str) -> str:
    return f"CASE ({k})%4 WHEN 0 THEN 'java' WHEN 1 THEN 'kotlin' WHEN 2 THEN 'python' ELSE 'go' END"


#: The tables as a graph: common table expressions that oracles begin with.
GRAPH = f"""
nodes AS (
 SELECT 'module:'||r_regionkey AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name, lower(r_name)||'/index' AS file_path, 'yaml' AS language, 1 AS start_line, 1 AS end_line, true AS is_exported, false AS is_declaration FROM region
 UNION ALL SELECT 'namespace:'||n_nationkey, 'namespace', n_name, r_name||'::'||n_name, {_PATH}||'index', 'yaml', 1, 1, true, false FROM nation JOIN region ON n_regionkey=r_regionkey
 UNION ALL SELECT 'class:'||c_custkey, 'class', c_name, r_name||'::'||n_name||'::'||c_name, {_PATH}||{_SEG.join('()')}||'/core', 'java', CAST(c_custkey%997+1 AS INT), CAST(c_custkey%997+10 AS INT), c_acctbal>=0, false FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 UNION ALL SELECT 'interface:'||s_suppkey, 'interface', s_name, r_name||'::'||n_name||'::'||s_name, {_PATH}||'suppliers', 'kotlin', CAST(s_suppkey%997+1 AS INT), CAST(s_suppkey%997+10 AS INT), s_acctbal>=0, false FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 UNION ALL SELECT 'function:'||o_orderkey, 'function', 'order_'||o_orderkey, c_name||'::order_'||o_orderkey, {_PATH}||{_SEG.join('()')}||'/core', {_lang('o_orderkey')}, CAST(o_orderkey%997+1 AS INT), CAST(o_orderkey%997+5 AS INT), o_orderstatus='O', false FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 UNION ALL SELECT 'method:'||p_partkey, 'method', {_PART_NAME}, {_PART_QUALIFIED}, 'parts/'||lower(p_brand)||'/'||lower(p_type), {_lang('p_size')}, CAST(p_partkey%997+1 AS INT), CAST(p_partkey%997+1+p_size AS INT), p_size%2=0, p_size%5=0 FROM part
), edges AS (
 SELECT 'module:'||n_regionkey AS source, 'namespace:'||n_nationkey AS target, 'contains' AS kind, CAST(NULL AS INT) AS line FROM nation
 UNION ALL SELECT 'namespace:'||c_nationkey, 'class:'||c_custkey, 'contains', NULL FROM customer
 UNION ALL SELECT 'namespace:'||s_nationkey, 'interface:'||s_suppkey, 'contains', NULL FROM supplier
 UNION ALL SELECT 'class:'||o_custkey, 'function:'||o_orderkey, 'contains', NULL FROM orders
 UNION ALL SELECT DISTINCT 'function:'||l_orderkey, 'method:'||l_partkey, 'calls', CAST(l_linenumber AS INT) FROM lineitem
 UNION ALL SELECT DISTINCT 'method:'||l_partkey, 'interface:'||l_suppkey, 'references', CAST(NULL AS INT) FROM lineitem
 UNION ALL SELECT 'method:'||p_partkey, 'method:'||CAST(floor(p_partkey/2) AS BIGINT), 'extends', NULL FROM part WHERE floor(p_partkey/2)>=1
 UNION ALL SELECT 'namespace:'||n_nationkey, 'namespace:'||((n_nationkey*n_nationkey+1)%25), 'imports', NULL FROM nation
), refs AS (
 SELECT o_orderkey AS ref_id, 'function:'||o_orderkey AS from_node_id,
  CASE WHEN o_orderkey%11=0 THEN substr(n,1,1)||substr(n,3) WHEN o_orderkey%7=0 THEN q ELSE n END AS reference_name,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'references' ELSE 'calls' END AS reference_kind, CAST(o_orderkey%997+1 AS INT) AS line, 0 AS col,
  'parts/brand_'||(o_orderkey%25+1)||'/small' AS file_path, {_lang('o_orderkey')} AS language, 'pending' AS status
 FROM orders JOIN (SELECT p_partkey, {_PART_NAME} AS n, {_PART_QUALIFIED} AS q, count(*) OVER () AS total FROM part) p ON p_partkey=o_orderkey%total WHERE o_orderkey%5=0
), files AS (
 SELECT file_path AS path, min(language) AS language, count(*) AS node_count FROM nodes GROUP BY 1
), pairs AS (
 SELECT DISTINCT a.file_path AS source_file, b.file_path AS target_file FROM edges e JOIN nodes a ON e.source=a.id JOIN nodes b ON e.target=b.id WHERE e.kind<>'contains' AND a.file_path<>b.file_path
)"""


def query(name: str, sql: str | None = None, graph: bool = True):
    """Register a query. ``sql`` begins after the graph's tables if it needs them;
    further tables may be given as ``x AS (...) SELECT``."""

    def wrap(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            more = not body.upper().startswith(("SELECT", "(SELECT"))
            begin = f"WITH RECURSIVE {GRAPH}{', ' if more else ' '}" if graph else "WITH RECURSIVE " if more else ""
            ORACLES[name] = begin + body
        return f

    return wrap
