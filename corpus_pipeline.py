"""The corpus pipeline: low-quality rows go, one row of each group of similar documents stays, rows that
hold benchmark passages go, secrets are redacted, and what is left is packed into training sequences.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and is written as Parquet before
the next one reads it. All stages but the last return the columns of ``documents``.

Defined cases, in every stage: a null text counts as empty, and stays null in the rows that stay; rows with a null
id, repeated rows, and rows that share an id are rows each; columns beyond those of ``documents`` pass through
untouched, whatever their names; an empty table gives an empty one; texts may be of any length. What each stage does
with such rows is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from marginalia.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the classifier, trained on the labelled rows among them, rejects.

    An empty text is judged like any other, by the model's score of no words. Labels of ids that are not there, or
    that are labelled both ways, are left out; with labels of one kind only, or none, all rows are scored alike.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of similar documents: five-word shingles, a Jaccard coefficient of 0.8 or more.

    Rows without words are like no other and stay. Of a group the row of the smallest id stays, null last; of equals the first.
    """
    return jaccard_join.keep_one(docs, size=5, threshold=(80, 100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that are contaminated by a benchmark item. Rows without words have no hit and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in all texts. No row goes; null texts stay null."""
    return secret_scan.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. A row without text is its end token alone; rows of one id are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_redaction),
    ("packing", sequence_packing),
]

# Stages learn models, walk trees and run a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
