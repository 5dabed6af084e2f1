"""Aggregate products: funnels, journeys, twins, coverage, partitions by content, plurality of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import content_key


def content_partition(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(content_key, members, first_id)``: rows by equal content (blanks and case aside); blank texts are left out."""
    rows = df.where(F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0).select(F.col(id_col).alias("id"), content_key(F.col(text_col)).alias("content_key"))
    return rows.groupBy("content_key").agg(F.count("*").alias("members"), F.min("id").alias("first_id"))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(stage, in_count, out_count, fell_off)`` from the tables of consecutive stages."""
    counts = None
    for k, (name, df) in enumerate(stages):
        row = df.agg(F.count("*").alias("out_count")).select(F.lit(k).alias("at"), F.lit(name).alias("stage"), "out_count")
        counts = row if counts is None else counts.unionByName(row)
    before = F.lag("out_count").over(Window.orderBy("at"))  # one row a stage
    return counts.select("stage", F.coalesce(before, "out_count").alias("in_count"), "out_count", F.greatest(F.lit(0), F.coalesce(before, "out_count") - F.col("out_count")).alias("fell_off"))


def coverage(df: DataFrame, flag: Column, by: str) -> DataFrame:
    """``(by, total, covered, percent)``: whole percent of rows for which the flag holds."""
    covered = F.count(F.when(flag, 1))
    return df.groupBy(by).agg(F.count("*").alias("total"), covered.alias("covered"), F.floor(covered * 100 / F.count("*")).cast("long").alias("percent"))


def journey(items: DataFrame, facts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """One row an item: for each fact table the number of its rows of that key. Facts are counted before they join."""
    out = items
    for name, df in facts:
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])
    return out


def stratified(df: DataFrame, group: str, score: str, tie: str, per_group: int, total: int) -> DataFrame:
    """The best ``total`` rows of which no group has more than ``per_group``."""
    best = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("group_rank", F.row_number().over(best)).where(F.col("group_rank") <= per_group).orderBy(F.desc(score), tie).limit(total)


def set_algebra(df: DataFrame, item: str, element: str) -> DataFrame:
    """``(element, owners, in_all)``: in how many items an element is, and whether it is in all."""
    n = df.agg(F.countDistinct(item).alias("items"))
    return df.groupBy(element).agg(F.countDistinct(item).alias("owners")).crossJoin(n).select(element, "owners", (F.col("owners") == F.col("items")).alias("in_all"))  # one row


def steward_names(df: DataFrame, name: str, pattern: str, steward: str) -> DataFrame:
    """Rows whose name holds a pattern (case aside), with the steward assigned."""
    return df.where(F.contains(F.lower(name), F.lit(pattern.lower()))).withColumn("steward", F.lit(steward))
