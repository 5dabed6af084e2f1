"""Filters, scopes and joins over the nodes and edges of the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import mentions


def named(df: DataFrame, columns: list[str], reference: str) -> DataFrame:
    """Rows one of whose names equals a reference, case aside; brackets, hashes and blanks around it don't count."""
    wanted = reference.strip().strip("#[]").upper()
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.upper(c) == wanted, F.lit(False)) for c in columns))
    return df.where(hit)


def exact_else_token(df: DataFrame, name: str, phrase: str) -> DataFrame:
    """Rows named just so (case aside), if there are any; otherwise those whose name holds every word of the phrase."""
    words = reduce(lambda a, b: a & b, (mentions(F.col(name), w) for w in phrase.split()), F.lit(True))
    rows = df.withColumn("_equal", F.lower(name) == phrase.lower()).where(F.col("_equal") | words)
    any_equal = rows.agg(F.coalesce(F.max("_equal"), F.lit(False)).alias("_any"))
    return rows.crossJoin(any_equal).where(F.col("_equal") | ~F.col("_any")).drop("_equal", "_any")  # one row


def of_owner(nodes: DataFrame, layer: str, owner: str) -> DataFrame:
    """Nodes whose id starts with ``layer:owner:``; a prefix that reaches the scan."""
    return nodes.where(F.col("node_id").startswith(f"{layer}:{owner}:"))


def cards(nodes: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``(node_id, columns...)`` of the nodes that are listed."""
    return nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi").select("node_id", *columns)


def permitted(nodes: DataFrame, surfaced: DataFrame, said: str) -> DataFrame:
    """Nodes that a session has shown before, or whose id stands in what the user said, case aside."""
    told = F.contains(F.lit(said.lower()), F.lower("node_id"))
    shown = surfaced.select("node_id", F.lit(True).alias("_shown")).distinct()
    return nodes.join(shown, "node_id", "left").where(told | F.col("_shown").isNotNull()).drop("_shown")


def node_tables(nodes: DataFrame, layer: str, schema: str) -> DataFrame:
    """Nodes of one layer with their JSON ``properties`` as columns; what is missing is empty text, or null for other types."""
    rows = nodes.where(F.col("layer") == layer).select("node_id", "name", F.from_json("properties", schema).alias("p")).select("node_id", "name", "p.*")
    return rows.na.fill("", [c for c, t in rows.dtypes if t == "string" and c not in ("node_id", "name")])


def edge_tables(edges: DataFrame, declared: list[str], left_out: list[str] = ()) -> dict[str, DataFrame]:
    """One table for each declared type; types neither declared nor left out raise, so that no edge is lost silently."""
    unknown = edges.where(~F.col("edge_type").isin([*declared, *left_out])).select("edge_type").distinct().limit(5).collect()
    if unknown:
        raise KeyError(f"undeclared edge types: {sorted(r.edge_type for r in unknown)}")
    return {kind: edges.where(F.col("edge_type") == kind).select("source_id", "target_id") for kind in declared}


def table_records(tables: DataFrame, edges: DataFrame, columns: DataFrame) -> DataFrame:
    """``(node_id, name, columns)``: each table with the sorted names of its columns, tables without any included."""
    names = edges.join(columns.select(F.col("node_id").alias("target_id"), F.col("name").alias("_column")), "target_id").select("source_id", "_column")
    found = names.groupBy(F.col("source_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("_column")), ", ").alias("columns"))
    return tables.select("node_id", "name").join(found, "node_id", "left").na.fill("", ["columns"])


def linked(nodes: DataFrame, edges: DataFrame, kinds: list[str], backwards: bool = False) -> DataFrame:
    """``(from_id, edge_type, node_id, name)``: the nodes that edges of some types lead to, or come from."""
    here, there = ("target_id", "source_id") if backwards else ("source_id", "target_id")
    rows = edges.where(F.col("edge_type").isin(kinds)).select(F.col(here).alias("from_id"), "edge_type", F.col(there).alias("node_id"))
    return rows.join(nodes.select("node_id", "name"), "node_id").select("from_id", "edge_type", "node_id", "name")


def updated(current: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """The rows with a column's new value where there is one, else the old; of several new values the least counts."""
    new = changes.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_new"))
    return current.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def comparable_texts(items: DataFrame, steps: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(node_id, text)``: a step's fragment, else a metric's calculation."""
    a, b = steps.select("node_id", F.col("fragment").alias("_f")), metrics.select("node_id", F.col("calculation").alias("_c"))
    return items.select("node_id").join(a, "node_id", "left").join(b, "node_id", "left").select("node_id", F.coalesce("_f", "_c").alias("text"))


def with_contained(found: DataFrame, catalog: DataFrame, key: str, name: str, phrase: str) -> DataFrame:
    """``(key, how)``: what a search found, and rows whose name holds the phrase that it missed."""
    near = found.select(key, F.lit("meaning").alias("how"))
    held = catalog.where(F.contains(F.lower(name), F.lit(phrase.lower()))).select(key).join(near.select(key), key, "left_anti")
    return near.unionByName(held.withColumn("how", F.lit("name")))


def missing_roots(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Direct edges ``(source_id, target_id)`` that a closure ``(root, node_id)`` lacks; a right closure lacks none."""
    return edges.select("source_id", "target_id").distinct().join(closure, (F.col("source_id") == F.col("root")) & (F.col("target_id") == F.col("node_id")), "left_anti")


def or_groups(leaves: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``(path, or_root)``: the outermost or-root above each leaf, by slash-separated paths; null without one."""
    steps = F.split(path, "/")
    ups = leaves.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("_up"))
    hit = ups.join(roots.select(F.col(path).alias("_up")).distinct(), "_up").groupBy(path).agg(F.min_by("_up", F.length("_up")).alias("or_root"))
    return leaves.select(path).join(hit, path, "left")


def step_order(steps: DataFrame, depends: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(step, depth, place)``: each step after all it depends on (``depends(step, on)``), ties by step.

    The depth is that of the longest chain below a step; steps of a cycle, or above one, come last with a null depth.
    """
    from stepweave.plans.graph import settled
    from stepweave.plans.ordering import numbered

    edges = depends.select("step", "on").where("step <> on").distinct()
    left, done = settled(steps.select("step").distinct()), None
    for depth in range(max_rounds):
        waiting = edges.join(left.select(F.col("step").alias("on")), "on", "left_semi").select("step").distinct()
        ready = settled(left.join(waiting, "step", "left_anti").withColumn("depth", F.lit(depth)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = settled(left.join(ready, "step", "left_anti"))
    rest = left.withColumn("depth", F.lit(None).cast("int"))
    out = rest if done is None else done.unionByName(rest)
    return numbered(out, [], [F.col("depth").asc_nulls_last(), F.col("step")]).select("step", "depth", "place")


def fuzzy_matches(keys: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """``(key, name, score)``: for each key its best name, by the share of its words that the name holds; ties by name.

    A word is held if it equals a word of the name, or, both of three letters or more, one lies in the other. Words meet
    before their rows do: a word that lies in others is looked up by one run of three letters, the one that fewest of them
    have, so that common runs join nothing.
    """

    def worded(df: DataFrame, column: str, word: str) -> DataFrame:
        split = F.array_distinct(F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != ""))
        return df.select(column).distinct().select(column, F.explode(split).alias(word))

    def runs(words: DataFrame) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda k: F.substr(F.col("w"), k, F.lit(3)))
        return words.where(F.length("w") >= 3).select("w", F.explode(F.array_distinct(cut)).alias("run"))

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        """``(short, long)``: words and those that they lie in."""
        held = runs(long)
        often = held.groupBy("run").agg(F.count("*").alias("often"))
        rare = runs(short).join(often, "run").groupBy(F.col("w").alias("short")).agg(F.min_by("run", F.struct("often", "run")).alias("run"))
        return rare.join(held.withColumnRenamed("w", "long"), "run").where(F.contains("long", F.col("short"))).select("short", "long")

    of_keys, of_names = worded(keys, "key", "_k"), worded(names, "name", "_n")
    k, n = of_keys.select(F.col("_k").alias("w")).distinct(), of_names.select(F.col("_n").alias("w")).distinct()
    pairs = k.join(n, "w", "left_semi").select(F.col("w").alias("_k"), F.col("w").alias("_n"))
    pairs = pairs.unionByName(inside(k, n).select(F.col("short").alias("_k"), F.col("long").alias("_n"))).unionByName(inside(n, k).select(F.col("long").alias("_k"), F.col("short").alias("_n"))).distinct()
    held = of_keys.join(pairs, "_k").join(of_names, "_n").groupBy("key", "name").agg(F.countDistinct("_k").alias("_held"))
    total = F.size(F.array_distinct(F.filter(F.split(F.lower("key"), "[^a-z0-9]+"), lambda w: w != "")))
    scored = held.withColumn("score", F.col("_held") / total).where(F.col("score") >= least)
    return scored.groupBy("key").agg(F.max("score").alias("score"), F.min_by("name", F.struct(-F.col("score"), "name")).alias("name")).select("key", "name", "score")


def kind_of(word: Column, known: list[str]) -> Column:
    """A kind's name in lower case, if it is known as it stands or else without a plural s; null if neither."""
    said = F.lower(F.trim(word))
    one = F.regexp_replace(said, "s$", "")
    return F.when(said.isin(known), said).when(one.isin(known), one)


def physical_leaves(steps: DataFrame, owner: str, tables: str) -> DataFrame:
    """``(owner, leaf)``: distinct tables that an owner's steps read, temporary ones (``#``) left out."""
    rows = steps.select(owner, F.explode(tables).alias("leaf")).where(F.col("leaf").isNotNull() & ~F.col("leaf").startswith("#"))
    return rows.select(owner, F.upper("leaf").alias("leaf")).distinct()


def lexical_hits(names: DataFrame, name: str, question: str) -> DataFrame:
    """Rows whose name is a word of the question: identifiers of four characters or more, case aside."""
    words = F.transform(F.regexp_extract_all(F.lit(question), F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)), lambda w: F.lower(w))
    return names.where(F.array_contains(words, F.lower(name)))
