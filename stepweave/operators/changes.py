"""Comparisons of two runs: changed rows, error status, freshness, first-wins and latest-run choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_hash(text: Column) -> Column:
    """Hash of a definition, blind to case and blanks."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def change_data(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, change)``: new, changed, unchanged or deleted, by a full outer join on the key."""
    a, b = before.select(F.col(key).alias("a"), F.col(digest).alias("da")), now.select(F.col(key).alias("b"), F.col(digest).alias("db"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("da").eqNullSafe(F.col("db")), "unchanged").otherwise("changed")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), change.alias("change"))


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` replaced or joined by those of ``changes`` with the same key; null is a key like others.

    Several changes of one key raise, as it is open which of them counts.
    """
    twice = changes.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several changes of {twice[0][0]!r}")
    known = changes.select(F.col(key).alias("_key"))
    return current.join(known, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(changes)


def error_status(current: DataFrame, previous: DataFrame, passed_before: DataFrame, key: str) -> DataFrame:
    """``(key, status)``: known (failed before too), regressed (passed before), new, or resolved (no more)."""
    seen = current.select(key).distinct().withColumn("now", F.lit(True))
    old = previous.select(key).distinct().withColumn("failed", F.lit(True))
    good = passed_before.select(key).distinct().withColumn("passed", F.lit(True))
    status = F.when(F.col("now").isNull(), "resolved").when(F.col("failed"), "known").when(F.col("passed"), "regressed").otherwise("new")
    return seen.join(old, key, "full_outer").join(good, key, "left").select(key, status.alias("status"))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def latest_run(df: DataFrame, run_column: str) -> DataFrame:
    """Rows of the greatest run."""
    return df.join(df.agg(F.max(run_column).alias(run_column)), run_column, "left_semi")


def occurrence_names(df: DataFrame, keys: list[str], name: str, order: list) -> DataFrame:
    """Repeated names within a key numbered from the second on: ``name``, ``name#2``, ...; case doesn't tell names apart."""
    nth = F.row_number().over(Window.partitionBy(*keys, F.upper(name)).orderBy(*order))
    return df.withColumn("occurrence", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), nth)))


def freshness(now: DataFrame, previous: DataFrame, key: str, logic: str, run_at: str) -> DataFrame:
    """``(key, logic_last_changed_at)``: carried from the previous run where the logic is equal, else this run's time.

    Of several previous rows of a key the last changed counts.
    """
    latest = F.max_by(F.struct(F.col(logic).alias("_l"), F.col("logic_last_changed_at").alias("_at")), F.struct("logic_last_changed_at", logic))
    old = previous.groupBy(F.col(key).alias("_k")).agg(latest.alias("_p")).select("_k", "_p.*")
    same = F.col(logic).eqNullSafe(F.col("_l")) & F.col("_k").isNotNull()
    return now.join(old, F.col(key) == F.col("_k"), "left").select(key, F.when(same, F.col("_at")).otherwise(F.lit(run_at)).alias("logic_last_changed_at"))
