"""Shared pieces of the corpus operators: table access, folds, joins with aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, shared_dir, written  # noqa: F401

#: A word is a maximal run of characters other than space and the ASCII controls 9 to 13.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def met(rows: DataFrame, one: DataFrame, *keys: str) -> DataFrame:
    """`rows` joined with `one`, an aggregate with a row for each value of the integer columns `keys`.

    A join on the keys themselves would take over the aggregate's partitions, in which a hot key is one task. On the keys'
    complements each side is dealt for the join alone, so adaptive execution can split what is hot, or send a small
    aggregate to where the rows are.
    """
    names = []
    for key in keys:
        names.append(free_name(rows, "not_"))
        rows, one = (df.withColumn(names[-1], F.bitwise_not(key)) for df in (rows, one))
    return rows.join(one.drop(*keys), names).drop(*names)


def ascii_lower(c):
    """Lower-case A to Z only, as the contracts of the corpus queries ask."""
    return F.translate(c, UPPER, LOWER)


def doc_fold(doc_id, folds: int):
    """crc32 of the id's decimal text modulo `folds`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever extra columns it carries."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
