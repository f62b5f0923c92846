"""Corpus pipeline: toxicity, near copies, benchmark passages, personal data, token ids.

Each stage takes what the one before kept, with all columns, and is judged by that
input alone.  In all stages null texts count as empty, columns other than doc_id and
text are carried along whatever their names, repeated rows are treated alike, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, jaccard, pii, toxicity
from millrace.llm.queries import table, tokenizer_path
from millrace.operators.materialize import discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7.  Learns from the labels of documents that are there; without labels of both kinds all stay, as empty texts do."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at 0.8: the one with the smallest id, null ids last; of rows equal in id and text one.  Rows without words all stay."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than one word in 20 inside a benchmark window of 13 words, or without any; rows without words stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with [KIND] in place of each span of personal data; no row goes, null texts stay null."""
    return pii.redact(docs, pii.learn(docs))


def add_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two more columns: the ids of the whole text with its end, and their number; a null text has the end alone."""
    return bpe.add_counts(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("personal data", redact), ("token ids", add_token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are left after all stages; each stage's rows are written and read again, and those of the stage before deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(before)
    return docs
