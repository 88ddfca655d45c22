"""A corpus pipeline of five stages over the documents table; each stage is one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes what a stage returns as Parquet to the
shared folder and reads it as the next one's docs; what the stage before it wrote goes then.

Defined results, of every stage: only the columns of documents are read, so extra columns of any name are dropped. Null ids,
languages, sources and counts travel along. A null or empty text has no good quality to show, so the classifier's
score of an empty text decides; if it stays, it is in no group of copies, loses no words, holds no benchmark item and is encoded as one
segmentation without pieces. Rows that repeat, or share an id, are judged one by one, but stay or go together as copies: they are
one node. Of a group's documents the one of the least id stays; rows with a null id all stay. Documents that lose all their words to
earlier ones go. An empty table gives an empty one. Very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm import decontaminate, gumbel_encode, near_dedup, quality, substring_dedup
from loomquery.llm.common import doc_fold, dropped, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality.score_texts(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), lambda i: doc_fold(i, 3) != 1)
    return scored.filter("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least id."""
    docs = docs.select(*COLUMNS)
    kept = near_dedup.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    same = docs.join(kept.withColumnRenamed("doc_id", "kept_id"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return same.select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; documents without one stay as they are."""
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.filter("n_words = 0 or n_removed < n_words").withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item, or a long part of one, occurs go."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, with their scores, and whether all of them decode to the text."""
    return gumbel_encode.encode(docs.select("doc_id", "text", "lang", "source"), check=True).drop("text")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("decontaminate", decontaminate_stage), ("encode", encode_stage)]

#: The classifier and the sampler have no SQL form; tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, earlier = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if earlier is not None:
            dropped(earlier)
        earlier = docs
    return docs
