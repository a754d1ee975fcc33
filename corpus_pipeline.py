"""The corpus pipeline: STAGES are applied to documents in order, each to all that its predecessor kept.

For every stage: columns beside those named keep their names and values, whatever they are called; rows of equal doc_id are judged
alike where a stage says nothing else; an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, common, langid, mixing, pii, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Each row is judged by its own text; a null text or one without a letter goes.

    Where no row is labelled, all texts with a letter stay.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by doc_id) of each group of near copies; all rows of that doc_id stay.

    Null texts count as empty, and texts without words are copies of each other; null doc_ids are larger than all others.
    """
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced in their texts; null texts stay null."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none over twice; null and empty texts are not taken, null sources are one source.

    Rows of one doc_id share what they were given.
    """
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and what these decode to, in place of text; columns named so before are replaced.

    A null text has no ids.
    """
    return bpe.encode_column(docs, bpe.default_vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: Language ID is learnt, so the stages have no SQL form; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents; what each stage returns is written to the shared folder and read again.

    Of what was written only the last stage's result stays there.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        # a stage's own tables, and those of the stage before it, go once its result is written
        with common.cleaned(spark) as written:
            docs = common.settle(stage(spark, docs, sf_dir), name)
            kept = written.pop()
            written += [last] if last else []
        last = kept
    return docs
