"""The corpus pipeline: reject toxic documents, cut repeated chunks and passages, keep one of each
group of near-duplicates, and pack what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.checkpoints import shared_folder
from lineagraph.llm.common import documents, prepare
from lineagraph.llm.line_dedup import line_dedup
from lineagraph.llm.packing import packed_digest
from lineagraph.llm.simhash import first_of_components
from lineagraph.llm.substring_dedup import cut_repeats, repeated_passages
from lineagraph.llm.toxicity import score, train_for

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return score(docs, train_for(spark, sf_dir, docs)).where("score < 0.5").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks that an earlier place holds."""
    return _as_documents(line_dedup(docs.select(*COLUMNS)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each SimHash component of ``op6_simhash``: links of two or fewer differing bits."""
    prepare(spark)
    return first_of_components(docs).select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that an earlier document holds."""
    return _as_documents(cut_repeats(docs.select(*COLUMNS), repeated_passages(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packed_digest(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: Trained scores, SimHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
