"""Checks of declared table contracts. Each returns its violations as rows; a clean table gives none."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "integer": T.IntegerType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Contract:
    """A table's declared shape and rules. ``columns``: (name, type, nullable)."""

    name: str
    columns: tuple[tuple[str, str, bool], ...]
    unique: tuple[tuple[str, ...], ...] = ()
    allowed: dict[str, tuple] = field(default_factory=dict)
    write_mode: str = "overwrite"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, TYPES[kind], nullable) for name, kind, nullable in self.columns])

    def missing_columns(self, df: DataFrame) -> list[str]:
        """Declared columns that a table lacks; case doesn't matter."""
        have = {c.lower() for c in df.columns}
        return [name for name, _, _ in self.columns if name.lower() not in have]


def unique_violations(df: DataFrame, keys: list[str], fold_case: bool = False) -> DataFrame:
    """``(keys..., n)`` of keys that more than one row has."""
    columns = [F.upper(F.col(k)).alias(k) if fold_case and dict(df.dtypes)[k] == "string" else F.col(k) for k in keys]
    return df.select(*columns).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def allowed_violations(df: DataFrame, column: str, values: list) -> DataFrame:
    """``(value, n)`` of values outside the allowed set; null never violates."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def reference_violations(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """``(value, n)`` of values that the target column lacks; null never violates."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(target.select(F.col(target_column).alias("value")), "value", "left_anti")


def count_equals(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``(left_count, right_count, equal)``."""
    return left.agg(F.count("*").alias("left_count")).crossJoin(right.agg(F.count("*").alias("right_count"))).withColumn("equal", F.col("left_count") == F.col("right_count"))  # one row each


def check(df: DataFrame, contract: Contract) -> list[Row]:
    """All violations of one table, as ``(contract, rule, detail)`` rows, five samples a rule at most."""
    found = [Row(contract=contract.name, rule="column", detail=c) for c in contract.missing_columns(df)]
    if found:
        return found
    for keys in contract.unique:
        found += [Row(contract=contract.name, rule="unique", detail=str(r.asDict())) for r in unique_violations(df, list(keys)).orderBy(*keys).limit(5).collect()]
    for column, values in contract.allowed.items():
        found += [Row(contract=contract.name, rule="allowed", detail=str(r.asDict())) for r in allowed_violations(df, column, list(values)).orderBy("value").limit(5).collect()]
    return found
