"""A corpus pipeline over `documents`: quality classifier, quality rules, near-duplicate groups, source mix, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, in their order, whatever further columns there are.

Defined cases of every stage: an empty table gives an empty result; a null text counts as empty, a text of any length is
taken whole; a row without a doc_id is judged by its text as any other and is never held to be a copy; rows repeated with
their doc_id share one decision and stay repeated (one of their near copies with another doc_id stays, as for single rows).
Columns named as an operator's own (rules, words, copies, ids) are handed through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoregate.llm import bpe, gam, mixing, ngram_jaccard, quality_rules
from scoregate.llm.common import Scratch
from scoregate.llm.queries import table, vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good. Without usable labels every score is 0.5 and all stay."""
    return gam.accepted(docs, table(spark, sf_dir, "labels"), cut=0.3)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null, empty or short text fails them."""
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; texts without words have no copies."""
    return ngram_jaccard.keep_one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a repeated one in as many rows; a null source is a source, a text without words is never taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their text, with the columns ids and decoded (in the place of columns of these names); a null text has
    no ids and decodes to the empty text."""
    return bpe.round_trip(docs, vocabulary(), keep_text=False)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", deduplicate),
    ("source mix", mix),
    ("BPE encoding and decoding", encode),
]

#: A trained model and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
