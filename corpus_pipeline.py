"""From raw documents to a training mix: low quality out, near copies out, benchmark passages out, secrets redacted, sources mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as
Parquet in the shared folder and hands the reread table to the next. All but the last
return the columns of documents. Benchmark and labels are read from sf_dir.

Defined cases, as the operators have them: rows without text, or with an empty one, go in
the first stage; a null language is judged by the model of all trusted text; rows of one
id, or without an id, are judged by their texts, and of equal ones the second stage keeps
one; a null source is a source of its own; an empty table gives an empty mix; without
labels no document with text is rejected, without a benchmark none; columns beyond those
of documents stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, mix, near_copies, quality, secrets
from lodestrata.llm.common import read, table

WEIGHTS = (1, 2, 3)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within that of trusted text of their language."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a similarity of 0.8 or more the one with the smallest id."""
    return near_copies.one_of_each(docs, k=5, least=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets redacted."""
    return secrets.redact(docs, secrets.train(docs, read(spark, sf_dir, "labels")), length_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often it takes them (mix_times)."""
    return mix.take(docs, WEIGHTS)


STAGES = [
    ("quality", good_quality),
    ("near copies", one_of_each),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("mix", mixed),
]

#: The quality and near-copy stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents in sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
