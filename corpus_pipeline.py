"""From raw documents to packed sequences: each stage is one operator over all that the one before kept.

Every stage takes an empty table, nulls in any column, empty and very long texts, repeated rows and further columns,
and returns the columns that it got (the last one: those of packing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resolvekit.llm import decontaminate, ngram_join, packing, pii, quality
from resolvekit.llm.queries import PII_KEY, tokenizer_paths
from resolvekit.llm.store import keep, unused

#: Score from which a document counts as good.
LEAST_QUALITY = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, doesn't reject.

    A null or empty text has the score of the model's constant. Repeated rows and ties are judged alike. Without labelled
    texts every score is 0.5, so nothing is left.
    """
    weights = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs.columns, "quality_score")
    return quality.score(docs, weights, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: the smallest doc_id.

    Of rows with equal doc_id and text one stays; rows without a doc_id or words all stay.
    """
    return ngram_join.drop_near_duplicates(docs, n=5, num=8, den=10)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also with other names and numbers. Null and empty texts stay; repeated rows share their fate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the text (null for a null text). Equal values get equal pseudonyms in all rows."""
    return pii.pseudonymise(docs, PII_KEY, count=None).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024 at most. A null or empty text is the end id alone; repeated rows are packed as often as they come."""
    return packing.pack(docs, *tokenizer_paths(), capacity=1024, end_id=0)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("pii", no_personal_data), ("packing", packed)]

#: Models and tokenizers have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.parquet of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
