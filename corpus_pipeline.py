"""A corpus pipeline: language ID, quality rules, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``; further columns, whatever their names, come along.

Defined cases, by stage: a null text is in no language and goes with the first, as
does a text without letters; nulls in other columns change nothing, and rows of null
doc_id are rows like others. Repeated rows are judged alike until near-duplicates,
of which one stays. Very long texts are read whole. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import common, language, packing, perplexity, pii, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the table teaches go: null texts, texts without
    letters, and those whose cosine with every language is below ``LEAST_SCORE``. All
    stay where ``lang`` is null throughout. Of equal cosines the smaller name counts."""
    return language.keep(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's bounds go; a null
    or malformed ``lang`` is a language of its own, and one of few texts has no bounds."""
    return perplexity.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays:
    that of the smallest doc_id, a null one last, then the first by the text's hash."""
    return simhash.keep_one(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; overlapping spans as one, by the kind of
    the first."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row for each piece; an empty text is its
    end token."""
    return packing.digest(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", quality),
    ("SimHash near-dedup", deduplicate),
    ("PII", mask_pii),
    ("packing", pack),
]

#: Hashing, learning and tokenizing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
