"""Files as tables: scanning, reading, and a small extractor of symbols."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import FILES, conform, node_id


def scan(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, text, content_hash, size, modified_at, language) of the source files
    below ``root``, without ignored directories."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    read = read.option("pathGlobFilter", pattern) if pattern else read
    top = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), top, -1)
    raw = read.load(root).select(rel.alias("path"), "content", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))
    raw = raw.filter(~X.is_ignored("path") & X.is_source("path"))  # before any content is read
    text = F.decode("content", "utf-8")
    return raw.select("path", text.alias("text"), F.sha2("content", 256).alias("content_hash"), "size", "modified_at", X.language_of("path", text).alias("language"))


def records(scanned: DataFrame) -> DataFrame:
    return conform(scanned.withColumn("indexed_at", F.unix_millis(F.current_timestamp())), FILES)


@dataclass(frozen=True)
class Rule:
    """A plug-in: what a file says. ``extract(path, text)`` gives (kind, name, line)
    nodes and (name, kind, line) references."""

    name: str
    languages: tuple[str, ...]
    extract: Callable[[str, str], tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]]


_rules: dict[str, Rule] = {}


def register(rule: Rule) -> None:
    """Add a rule, or replace the one of its name."""
    _rules[rule.name] = rule


def rules() -> list[Rule]:
    return list(_rules.values())


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _by_pattern(name: str, languages: tuple[str, ...], nodes: dict[str, str], refs: dict[str, str]) -> Rule:
    def extract(path: str, text: str):
        n = [(kind, m[1], _line(text, m.start())) for kind, p in nodes.items() for m in re.finditer(p, text, re.M)]
        r = [(m[1], kind, _line(text, m.start())) for kind, p in refs.items() for m in re.finditer(p, text, re.M)]
        return n, r

    return Rule(name, languages, extract)


# two sample packs, and definitions of the common kinds
register(_by_pattern("definitions", ("python", "javascript", "typescript", "java", "kotlin", "go"), {"class": r"^\s*(?:export\s+|public\s+|abstract\s+)*class\s+(\w+)", "function": r"^\s*(?:export\s+|async\s+|public\s+|static\s+)*(?:def|function|func|fun)\s+(?:\([^)]*\)\s*)?(\w+)", "interface": r"^\s*(?:export\s+|public\s+)*interface\s+(\w+)"}, {"calls": r"(?<!def )(?<!function )(?<!func )(?<!fun )\b(\w+)\("}))
register(_by_pattern("routes", ("python", "javascript", "typescript", "html"), {"route": r"""(?:app|router|bp)\.(?:get|post|put|delete|route)\(\s*['"]([^'"]+)['"]"""}, {"references": r"""(?:app|router)\.(?:get|post|put|delete)\(\s*['"][^'"]+['"]\s*,\s*(\w+)"""}))
register(_by_pattern("events", ("javascript", "typescript"), {}, {"emits": r"""\.emit\(\s*['"]([^'"]+)['"]""", "handles": r"""\.on\(\s*['"]([^'"]+)['"]"""}))


def extract(contents: DataFrame, chosen: list[Rule] | None = None) -> DataFrame:
    """contents: (path, language, text). (path, language, rule, what, kind, name,
    line): what is node or reference. Arrow batches; one pass for all rules."""
    use = rules() if chosen is None else chosen

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, text in b.itertuples(index=False):
                for rule in use:
                    if language in rule.languages and text:
                        nodes, refs = rule.extract(path, text)
                        out += [(path, language, rule.name, "node", k, n, i) for k, n, i in nodes]
                        out += [(path, language, rule.name, "reference", k, n, i) for n, k, i in refs]
            yield pd.DataFrame(out, columns=["path", "language", "rule", "what", "kind", "name", "line"])

    return contents.select("path", "language", "text").mapInPandas(run, "path string, language string, rule string, what string, kind string, name string, line int")


def nodes_of(extracted: DataFrame) -> DataFrame:
    from ..schema import NODES

    n = extracted.filter("what = 'node'")
    n = n.select(node_id(F.col("path"), F.col("kind"), F.col("name"), F.col("line")).alias("id"), "kind", "name", F.col("name").alias("qualified_name"), F.col("path").alias("file_path"), "language", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    return conform(n, NODES).dropDuplicates(["id"])
