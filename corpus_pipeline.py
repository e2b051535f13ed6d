"""A training-data pipeline over `documents`: five stages, each on all that the one before it kept.

Quality classifier, language identification, near-duplicates, benchmark decontamination, packing. Every
stage's rows are written as Parquet into the shared folder and read again as the next one's input. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontam, langid, neardup, packing, quality
from tallyfold.llm.common import staged
from tallyfold.llm.queries import fold

LEAST_QUALITY = 0.5
LEAST_COSINE = 0.01  # for what has no letter, or points away from all; langid.limits sets each language's own bound
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labels outside the held-out third.

    A score of exactly 0.5 stays. Null and empty texts have the score of the bias. Repeated rows and rows with
    null ids are judged by their text alone, so they stay or go together. Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels.where(fold(3) != 1)), LEAST_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter (null and empty ones too) and texts like no prototype go.

    Prototypes and limits come from the stage's own rows outside the held-out quarter. A cosine at its limit
    stays. Repeated rows and rows with null ids are judged by their text alone.
    """
    train = docs.where(fold(4) != 2)
    prototypes = langid.fit(train)
    return langid.keep_known(docs, prototypes, LEAST_COSINE, langid.limits(train, prototypes))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id.

    An id names one document: rows that repeat an id, with the same text or others, stay or go together, and
    a link of any of its texts is a link of the document. Rows with a null id and texts without a word are
    compared with nothing and stay.
    """
    copies = neardup.near_duplicates(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay; so do rows with a null id. Rows that repeat an id go together if
    one of their texts holds a passage.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in bins of 2,048 words.

    Rows without a word (null and empty texts) have one piece of size 0 and no bin. Repeated rows and rows
    with null ids are packed as often as they come; equal texts never share a bin.
    """
    return packing.pack(docs, packing.count_words(F.col("text")), packing.same_text(F.col("text")))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # SQL cannot express the classifiers; tests/llm compares the rows with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
