"""Records around the graph: dictionaries, grounding of references, plans, audits and documents for search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_dictionaries(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of all dictionaries, columns by name; of a key (case aside) the earliest source's smallest row stays."""
    columns = list(dict.fromkeys(c for df in sources for c in df.columns))
    ranked = [df.withColumn("_priority", F.lit(k)) for k, df in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    best = F.min_by(F.struct(*columns), F.struct("_priority", *columns))
    return rows.groupBy(F.upper(key).alias("_key")).agg(best.alias("row")).select("row.*")


def schema_collisions(df: DataFrame, name: str, schema: str) -> DataFrame:
    """``(name, schemas)``: folded names that stand in more than one schema, and these in order, comma-separated."""
    found = F.array_sort(F.collect_set(F.upper(F.col(schema).cast("string"))))
    return df.groupBy(F.upper(name).alias("name")).agg(found.alias("s")).where(F.size("s") > 1).select("name", F.array_join("s", ",").alias("schemas"))


def dictionary_coverage(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``(total, covered, fraction)`` of the distinct references that the dictionary knows; no references count as 0."""
    rows = refs.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return rows.agg(F.count("*").alias("total"), F.count("_hit").alias("covered"), F.coalesce(F.count("_hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("fraction"))


def grounded_fraction(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``(fraction)`` of the distinct references that the dictionary knows; where there is nothing to ground it is 1."""
    found = dictionary_coverage(refs, known, key)
    return found.select(F.when(F.col("total") == 0, 1.0).otherwise(F.col("fraction")).alias("fraction"))


def leaf_grounding(refs: DataFrame, known: DataFrame, owner: str, leaf: str) -> DataFrame:
    """``(owner, leaves, missing, verdict)``: distinct leaves of each owner and how many of them no dictionary holds."""
    rows = refs.select(owner, leaf).where(F.col(leaf).isNotNull()).distinct().join(known.select(leaf).distinct().withColumn("_hit", F.lit(1)), leaf, "left")
    counted = rows.groupBy(owner).agg(F.count("*").alias("leaves"), (F.count("*") - F.count("_hit")).alias("missing"))
    return counted.withColumn("verdict", F.when(F.col("missing") == 0, "grounded").otherwise("fallout"))


def generation_plan(items: DataFrame, records: DataFrame, key: str, content: str, status: str) -> DataFrame:
    """``(key, plan)``: reuse what succeeded for the same content, retry what was rejected and generate the rest."""
    done = records.where(F.col(status) == "ok").select(key, content).distinct().withColumn("_done", F.lit(1))
    refused = records.where(F.col(status) == "rejected").select(key).distinct().withColumn("_refused", F.lit(1))
    plan = F.when(F.col("_done").isNotNull(), "reuse").when(F.col("_refused").isNotNull(), "retry").otherwise("generate")
    return items.select(key, content).join(done, [key, content], "left").join(refused, key, "left").select(key, plan.alias("plan"))


def staleness(df: DataFrame, key: str, stamp: str, now: str, days: int) -> DataFrame:
    """``(key, age_days, state)``: stale past ``days``; what is missing or no time is unknown, not stale."""
    age = F.datediff(F.lit(now).cast("date"), F.try_to_timestamp(F.col(stamp)).cast("date"))
    return df.select(key, age.alias("age_days")).withColumn("state", F.when(F.col("age_days").isNull(), "unknown").when(F.col("age_days") > days, "stale").otherwise("fresh"))


def projection_edges(refs: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``(step, qualifier, column_name, n, minted, outcome, target)``: one row a distinct reference; of ``n`` at most one is minted.

    ``refs(step, qualifier, column_name)`` resolve through ``tables(step, alias, table)`` to the one table of
    ``columns(table, column_name)`` that holds the column; names fold. What isn't minted is dropped for the outcome's
    reason: no_column_name, unresolved_qualifier, no_dictionary_column, ambiguous, or duplicate (another qualifier of
    the step was minted for the same target). A step's references meet only the tables of that step.
    """
    r = refs.select("step", F.upper("qualifier").alias("qualifier"), F.upper("column_name").alias("column_name")).groupBy("step", "qualifier", "column_name").agg(F.count("*").alias("n"))
    t = tables.select(F.col("step").alias("_step"), F.upper("alias").alias("_alias"), F.upper("table").alias("_table")).distinct()
    c = columns.select(F.upper("table").alias("_holder"), F.upper("column_name").alias("_column")).distinct()
    seen = r.join(t, (r.step == t["_step"]) & (r.qualifier.isNull() | (r.qualifier == t["_alias"])), "left")
    seen = seen.join(c, (F.col("_table") == F.col("_holder")) & (F.col("column_name") == F.col("_column")), "left")
    hits = F.countDistinct("_holder")
    rows = seen.groupBy("step", "qualifier", "column_name", "n").agg(F.count("_table").alias("_tables"), hits.alias("_hits"), F.min("_holder").alias("_one"))
    rows = rows.withColumn("target", F.when(F.col("_hits") == 1, F.concat_ws(".", "_one", "column_name")))
    first = F.row_number().over(Window.partitionBy("step", "target").orderBy("qualifier"))
    reason = F.when(F.coalesce(F.col("column_name"), F.lit("")) == "", "no_column_name").when(F.col("qualifier").isNotNull() & (F.col("_tables") == 0), "unresolved_qualifier")
    reason = reason.when(F.col("_hits") == 0, "no_dictionary_column").when(F.col("_hits") > 1, "ambiguous").when(F.col("_k") > 1, "duplicate").otherwise("minted")
    rows = rows.withColumn("_k", F.when(F.col("target").isNotNull(), first)).withColumn("outcome", reason)
    return rows.select("step", "qualifier", "column_name", "n", (F.col("outcome") == "minted").cast("int").alias("minted"), "outcome", "target")


def fact_diff(expected: DataFrame, found: DataFrame, fact: str, grouped: str) -> DataFrame:
    """``(fact, difference)``: facts missing, extra, or held in an or-group on one side only; equal ones are left out."""
    one = lambda df, name: df.groupBy(fact).agg(F.max(F.coalesce(F.col(grouped), F.lit(False))).alias(name))
    both = one(expected, "_want").join(one(found, "_got"), fact, "full")
    kind = F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_want") != F.col("_got"), "grouping")
    return both.select(fact, kind.alias("difference")).where("difference IS NOT NULL")


def cover_gaps(sources: DataFrame, good: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """``(key, problem)``: sources with no outcome or with two, and outcomes of no source; none if every source has one."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    rows = flag(sources, "_s").join(flag(good, "_g"), key, "full").join(flag(bad, "_b"), key, "full")
    problem = F.when(F.col("_s").isNull(), "unknown").when(F.col("_g").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_g").isNull() & F.col("_b").isNull(), "neither")
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def undeclared(df: DataFrame, kind: str, contract: DataFrame) -> DataFrame:
    """``(kind, n)``: kinds that stand in the rows and in no contract (null is never declared)."""
    return df.groupBy(kind).agg(F.count("*").alias("n")).join(contract.select(kind).distinct(), kind, "left_anti")


def fallout_reasons(df: DataFrame, stage: str, run: str, code: str) -> DataFrame:
    """``(stage, code, n)``: the codes of each stage's latest run."""
    counted = df.groupBy(stage, run, code).agg(F.count("*").alias("n"))  # few rows a stage before the window
    return counted.withColumn("_last", F.max(run).over(Window.partitionBy(stage))).where(F.col(run) == F.col("_last")).select(stage, code, "n")


def column_usage(filters: DataFrame, selects: DataFrame, column: str, ref: str) -> DataFrame:
    """``(relation, column, ref)``: who filters on a column and who selects it, each once."""
    rows = filters.select(F.lit("filters").alias("relation"), column, ref).unionByName(selects.select(F.lit("selects").alias("relation"), column, ref))
    return rows.distinct()


def catalog_documents(df: DataFrame, key: str, parts: list[Column]) -> DataFrame:
    """``(key, document)``: the parts that aren't blank, joined by bars; rows of blank parts alone are left out."""
    text = F.concat_ws(" | ", *(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts))
    return df.select(key, text.alias("document")).where("document <> ''")


def report_matches(reports: DataFrame, links: DataFrame, cards: DataFrame, report: str, metric: str, description: str) -> DataFrame:
    """``(report, metric, outcome)``: matched if a report has exactly one metric and that a description; else why not."""
    one = links.groupBy(report).agg(F.countDistinct(metric).alias("_n"), F.min(metric).alias(metric))
    told = cards.where(F.length(F.trim(F.coalesce(F.col(description), F.lit("")))) > 0).select(metric).distinct().withColumn("_told", F.lit(1))
    rows = reports.select(report).join(one, report, "left").join(told, metric, "left")
    outcome = F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, "no_link").when(F.col("_n") > 1, "many_links").when(F.col("_told").isNull(), "no_description").otherwise("matched")
    rows = rows.withColumn("outcome", outcome)
    return rows.select(report, F.when(F.col("outcome") == "matched", F.col(metric)).alias(metric), "outcome")
