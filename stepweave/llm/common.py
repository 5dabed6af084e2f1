"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text, as Java and Python regular expressions read it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, for a query of this package."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch where texts go to Python, unless the session has a number of its own."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(rows))


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder, so that a lost executor loses nothing.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set a local session (tests) gets a temporary one;
    a cluster has to name one that its machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """For a join: a broadcast where the rows, of a few longs each, are counted to be few; otherwise Spark shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows


def words(text: Column) -> Column:
    """Array of the words of a text; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def has_word(text: Column) -> Column:
    """Whether a text has a word; false for null."""
    return F.coalesce(F.rlike(text, F.lit(WORD)), F.lit(False))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def plain(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; whatever else the table holds can't clash with them."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in wanted.items()))
