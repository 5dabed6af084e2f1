"""The closed set of questions over a catalog: census, exact names, cards and gates; each result says how whole it is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.plans.graph import small_side
from stepweave.plans.ordering import numbered

from stepweave.functions.text import mentions
from stepweave.plans.graph import calculated_by, reachable, uses_table


@dataclass(frozen=True)
class ResultSet:
    """Rows with the question they answer; ``complete`` if they are all that there is of ``universe``."""

    ref: str
    op: str
    rows: DataFrame
    complete: bool
    universe: str
    note: str = ""


@dataclass
class Registry:
    """Results by reference: R1, R2, ...; each is also a temporary view of that name for SQL."""

    found: dict[str, ResultSet] = field(default_factory=dict)

    def add(self, op: str, rows: DataFrame, complete: bool, universe: str, note: str = "") -> ResultSet:
        ref = f"R{len(self.found) + 1}"
        rows.createOrReplaceTempView(ref)
        self.found[ref] = ResultSet(ref, op, rows, complete, universe, note)
        return self.found[ref]


def census(df: DataFrame, columns: list[str], phrase: str | None = None) -> tuple[DataFrame, list[str]]:
    """All rows, or those that mention a phrase as a whole in any of ``columns``; and the words left out.

    A phrase of several words that no row mentions falls back to its words of two letters or more that some row
    mentions: rows must mention each of those. Words that none mentions are reported.
    """
    if not phrase or not phrase.split():
        return df, []

    def hit(token: str):
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(mentions(F.col(c), token), F.lit(False))
        return out

    words = [w for w in dict.fromkeys(phrase.split()) if len(w) >= 2]
    seen = df.agg(F.coalesce(F.max(hit(phrase)), F.lit(False)), *(F.coalesce(F.max(hit(w)), F.lit(False)) for w in words)).first()  # one row
    if seen[0] or len(phrase.split()) == 1:
        return df.where(hit(phrase)), []
    out = df
    live = [w for w, found in zip(words, seen[1:], strict=True) if found]
    for w in live:
        out = out.where(hit(w))
    return (out if live else df.limit(0)), [w for w, found in zip(words, seen[1:], strict=True) if not found]


def metric_cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(metric_id, name, transform_count, calculation, table_count, source_tables)``: one row a metric."""
    names = nodes.select(F.col("node_id").alias("_id"), F.col("name").alias("_name"))
    steps = calculated_by(nodes, edges).join(names, F.col("step_id") == F.col("_id"))
    steps = steps.groupBy("metric_id").agg(F.count("*").alias("transform_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "_name"))), lambda s: s["_name"]), " -> ").alias("calculation"))
    tables = uses_table(nodes, edges).join(names, F.col("table_id") == F.col("_id"))
    tables = tables.groupBy("metric_id").agg(F.countDistinct("table_id").alias("table_count"), F.array_join(F.array_sort(F.collect_set("_name")), ", ").alias("source_tables"))
    metrics = nodes.where("layer = 'canonical'").select(F.col("node_id").alias("metric_id"), "name")
    out = metrics.join(steps, "metric_id", "left").join(tables, "metric_id", "left")
    return out.na.fill(0, ["transform_count", "table_count"]).na.fill("", ["calculation", "source_tables"])


def readiness(checks: list[tuple[str, DataFrame, str, float, bool]]) -> DataFrame:
    """``(name, value, threshold, blocking, passed)`` from ``(name, rows, condition, threshold, blocking)``; no rows count as 0."""
    out = None
    for name, rows, condition, threshold, blocking in checks:
        value = F.coalesce(F.avg(F.when(F.coalesce(F.expr(condition), F.lit(False)), 1.0).otherwise(0.0)), F.lit(0.0))
        row = rows.agg(value.alias("value")).select(F.lit(name).alias("name"), "value", F.lit(float(threshold)).alias("threshold"), F.lit(blocking).alias("blocking"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.col("value") >= F.col("threshold"))


def replan(changed: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """``(kind, id)``: jobs to run again and tables they touch, from ``changed(table)``, ``reads(table, job)``, ``writes(job, table)``."""
    t, j = (lambda c: F.struct(F.lit("table").alias("kind"), F.col(c).cast("string").alias("id"))), (lambda c: F.struct(F.lit("job").alias("kind"), F.col(c).cast("string").alias("id")))
    edges = reads.select(t("table").alias("source_id"), j("job").alias("target_id")).unionByName(writes.select(j("job").alias("source_id"), t("table").alias("target_id")))
    walk = reachable(changed.select(t("table").alias("root")), edges)
    return walk.select("node_id.kind", "node_id.id").distinct()


def ungrounded_numbers(claims: DataFrame, evidence: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, number)``: numbers that a key's claims state and none of its evidence holds."""
    numbers = lambda df: df.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[0-9]+"), F.lit(0))).alias("number")).distinct()
    return numbers(claims).join(numbers(evidence), [key, "number"], "left_anti")


def keyword_scores(df: DataFrame, text: str, terms: list[str], tie: str, k: int) -> DataFrame:
    """The ``k`` rows that hold the most of the terms (case aside), with ``score``; rows that hold none are left out."""
    score = sum((F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), tie).limit(k)


def join_evidence(df: DataFrame, left: str, right: str) -> DataFrame:
    """``(a, b, evidence)``: unordered pairs of different values and how often they meet."""
    pair = df.where(F.col(left) != F.col(right)).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("evidence"))


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, n, median)``: the exact median of each group, null without a value.

    Values are numbered in order over range partitions and only the middle ones of a group are read, so that no group,
    however large, is held by one task.
    """
    counts = df.groupBy(by).agg(F.count(value).alias("n"))
    placed = numbered(df.where(F.col(value).isNotNull()).select(by, value), [by], [F.col(value)])
    middle = placed.join(small_side(counts.select(F.col(by).alias("_by"), "n")), F.col(by).eqNullSafe(F.col("_by")))
    middle = middle.where(F.col("place").isin(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    found = middle.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("median"))
    return counts.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "median")


def first_in_row(df: DataFrame, item: str, order: str, field: str) -> DataFrame:
    """Each row beside the first of its item: ``(item, order, same_as_first)``."""
    first = F.first(F.struct(F.col(field))).over(Window.partitionBy(item).orderBy(order))
    return df.select(item, order, F.col(field).eqNullSafe(first[field]).alias("same_as_first"))
