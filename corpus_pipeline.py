"""A corpus pipeline of five stages over ``documents``; each stage reads what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; the last adds the token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.llm import decontamination, line_dedup, ngram_join, quality_rules, sentencepiece_codec
from dealscope.llm.common import discard, kept_rows, table
from dealscope.llm.queries import PIECES, vocabulary
from dealscope.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the document rules or their host's failure rate reject go."""
    rejected = quality_rules.judge(docs).where(~F.col("kept"))
    return kept_rows(docs, rejected, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut from the texts; a document of which nothing is left goes."""
    cut = line_dedup.dedup_lines(docs).where((F.col("llm_removed") == 0) | F.col("text").rlike(line_dedup.HAS_WORD))
    cut = cut.drop("llm_lines", "llm_removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return ngram_join.first_of_each_group(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with what they decode to checked against the text."""
    both = sentencepiece_codec.encode(docs, vocabulary(PIECES), decoded=True)
    return both.withColumn("round_trip", F.col("decoded").eqNullSafe(F.translate("text", "▁", " "))).drop("decoded")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_free),
    ("sentencepiece", tokens),
]

#: the last stage encodes with a vocabulary file, which SQL cannot read
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each result written to the shared folder and read again.

    A stage's copy goes when the next one is written; the last one stays for the reader of the result.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            discard(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
