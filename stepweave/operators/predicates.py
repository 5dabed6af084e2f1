"""Predicates by what they mean, decision trees compared by that, and definitions compared line by line."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a difference between two definitions, and between two whole ones. Fixed values.
STEP_LINES, WHOLE_LINES = 14, 60


def _stripped(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def _value(v: Column) -> Column:
    return F.upper(_stripped(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), "'\""))


def _column(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "?").otherwise(F.upper(_stripped(F.substring_index(c, ".", -1), "\\[\\]\"'")))


def canonical(facts: DataFrame) -> DataFrame:
    """``facts`` and their meaning ``fact``: ``(op, pair, key, values)``.

    ``facts`` has ``op``, ``column``, ``columns``, ``values`` and ``operands`` (the last three arrays of strings). Values are
    a set without quotes and case; operands stand in where values are null. A predicate between two columns without values
    is a ``pair``, whichever side it names first. Otherwise the key is the column, or the first of several, and the other
    columns count as values. ``MATCHES`` is ``EQ``.
    """
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    cols = F.when(F.size(some(F.col("columns"))) > 0, F.col("columns")).when(F.coalesce("column", F.lit("")) != "", F.array("column")).otherwise(some(F.lit(None).cast("array<string>")))
    op = F.upper(F.when(F.coalesce("op", F.lit("")) == "", "?").otherwise(F.col("op")))
    rows = facts.withColumn("_cols", F.transform(cols, _column)).withColumn("_first", F.coalesce(F.nullif("column", F.lit("")), F.get(cols, F.lit(0))))
    rows = rows.withColumn("_values", F.array_sort(F.array_distinct(F.transform(some(F.coalesce("values", "operands")), _value))))
    pair = (F.size(F.array_distinct("_cols")) >= 2) & (F.size("_values") == 0)
    principal = _column(F.col("_first"))
    others = F.filter("_cols", lambda c: c != principal)
    fact = F.struct(
        F.when(op == "MATCHES", "EQ").otherwise(op).alias("op"), pair.alias("pair"),
        F.when(pair, F.array_join(F.array_sort(F.array_distinct("_cols")), "<->")).otherwise(principal).alias("key"),
        F.when(pair, F.col("_values")).otherwise(F.array_sort(F.array_union("_values", others))).alias("values"),
    )
    return rows.withColumn("fact", fact).drop("_cols", "_first", "_values")


def tree_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(owner, kind, op, key, values)``: ``missing`` and ``extra`` predicates, and those that should read as an
    ``alternative`` or a ``requirement``.

    Both sides are facts as of ``canonical`` with ``owner``, ``pos`` and ``or_group`` (empty: a requirement); of facts that
    mean the same the last by ``pos`` says how they are grouped. No rows: the trees agree.
    """

    def side(facts: DataFrame, name: str) -> DataFrame:
        grouped = F.max_by(F.coalesce("or_group", F.lit("")), "pos") != ""
        return canonical(facts).groupBy("owner", "fact").agg(grouped.alias(name))

    both = side(expected, "_want").join(side(found, "_have"), ["owner", "fact"], "full")
    kind = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra")
    kind = kind.when(F.col("_want") & ~F.col("_have"), "alternative").when(F.col("_have") & ~F.col("_want"), "requirement")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("owner", "kind", "fact.op", "fact.key", "fact.values")


def line_diff(pairs: DataFrame, left: str, right: str, most: int = STEP_LINES, named: tuple[str, str] | None = None) -> DataFrame:
    """``pairs`` and their ``diff``: a unified difference of two texts' lines with one line around it.

    ``most`` lines of it, and how many more there are; ``named`` puts a head with two names before it (counted too). Null
    texts are empty, equal ones have an empty difference. A task holds the lines of one pair at a time.
    """
    first, second = named or ("", "")

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str:
            lines = list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), first, second, lineterm="", n=1))
            lines = lines if named else lines[2:]
            rest = [f"... ({len(lines) - most} more diff lines)"] if len(lines) > most else []
            return "\n".join(lines[:most] + rest)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return pairs.withColumn("diff", diff(F.col(left), F.col(right)))
