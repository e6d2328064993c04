"""Schemas, closed sets of names, and the total order of ranked results."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}


def _struct(columns: str) -> T.StructType:
    """``name type`` pairs; a session is not needed."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


NODES = _struct(
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, "
    "start_column int, end_column int, docstring string, signature string, visibility string, is_exported boolean, is_async boolean, "
    "is_static boolean, is_abstract boolean, is_declaration boolean, decorators strings, type_parameters strings, return_type string, updated_at bigint"
)
EDGES = _struct("source string, target string, kind string, metadata map, line int, col int, provenance string")
FILES = _struct("path string, content_hash string, language string, size bigint, modified_at bigint, indexed_at bigint, node_count int").add(
    "errors", T.ArrayType(_struct("message string, file_path string, line int, column int, severity string, code string"))
)
REFS = _struct(
    "ref_id bigint, from_node_id string, reference_name string, reference_kind string, line int, col int, candidates strings, "
    "file_path string, language string, status string, name_tail string"
)

#: Kinds of nodes and edges (fixed values of the data model).
NODE_KINDS = (
    "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias "
    "namespace parameter import export route component macro"
).split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates defines".split()
CALL_KINDS = ("calls", "references", "imports")
HIERARCHY_KINDS = ("extends", "implements")
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
CALLABLE = ("function", "method")
EDGE_KEY = ("source", "target", "kind", "line", "col")


@dataclass(frozen=True)
class Graph:
    """Four tables. Operators take what they need and return DataFrames."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    refs: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_edges(self, edges: DataFrame) -> "Graph":
        return replace(self, edges=edges)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns and types; what it lacks is null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def det_order(*prefix: Column) -> list[Column]:
    """The total order of lookups; ranked results put the score before it."""
    return [
        *prefix,
        F.coalesce(F.col("is_declaration"), F.lit(False)).asc(),
        F.length("name").asc(),
        F.col("name").asc(),
        F.coalesce("qualified_name", "name").asc(),
        F.col("kind").asc(),
        F.col("file_path").asc(),
        F.col("start_line").asc(),
        F.col("start_column").asc(),
        F.col("id").asc(),
    ]


def node_id(path: Column, kind: Column, name: Column, line: Column, salt: Column | None = None) -> Column:
    """kind and the first 32 hexadecimal digits of the SHA-256 of what identifies
    a symbol; its line takes part, so a symbol that moves is another."""
    parts = [path, kind, name, line.cast("string")] + ([salt] if salt is not None else [])
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 32))


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Rows that have what a node must have; the others are left out in silence."""
    needed = ("id", "kind", "name", "file_path", "language")
    cond = F.lit(True)
    for c in needed:
        cond &= F.col(c).isNotNull() & (F.col(c) != "")
    return nodes.filter(cond)
