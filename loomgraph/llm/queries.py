"""The queries of this subpackage: each takes (spark, sf_dir).

Every query applies its operator to its whole table. DuckDB has no XXH64, no
tokenizer and no learning, so none of them has an oracle in SQL; the tests hold
each against a brute-force version, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, packing, permutation_index, perplexity, pii, sharding, simhash, site_tree, suffix_pieces, token_counts
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op2_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pieces.digest(table(spark, sf_dir, "documents"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return permutation_index.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_perplexity": op1_perplexity,
    "op2_site_tree": op2_site_tree,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_suffix_pieces": op6_suffix_pieces,
    "op7_permutation_index": op7_permutation_index,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_language": op10_language,
}
ORACLES: dict[str, str] = {}
