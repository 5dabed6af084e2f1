"""Comparisons of definitions: twins, alignment of steps, fields, sets, terms and resolution of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.plans.graph import settled


def twins(df: DataFrame, name: str, content: str) -> DataFrame:
    """``(group_key, member_count, versions, verdict)``: items of one name, case aside; identical if their content is one."""
    versions = F.countDistinct(F.coalesce(F.col(content).cast("string"), F.lit("")))
    out = df.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("group_key")).agg(F.count("*").alias("member_count"), versions.alias("versions"))
    return out.where("member_count > 1").withColumn("verdict", F.when(F.col("versions") == 1, "identical").otherwise("divergent"))


def mined_terms(df: DataFrame, owner: str, name: str, fragment: str, least_owners: int = 2) -> DataFrame:
    """``(term, fragment, owners, reach)``: names that several owners use, split by what they mean; ``reach`` is the name's."""
    rows = df.select(F.lower(name).alias("term"), F.col(fragment).alias("fragment"), F.col(owner).alias("owner")).where("term IS NOT NULL AND owner IS NOT NULL")
    reach = rows.groupBy("term").agg(F.countDistinct("owner").alias("reach")).where(F.col("reach") >= least_owners)
    return rows.groupBy("term", "fragment").agg(F.countDistinct("owner").alias("owners")).join(reach, "term")


def field_diff(df: DataFrame, item: str, field: str) -> DataFrame:
    """``(item, members, values, all_equal)``: equal only if there is one value and no row lacks it."""
    found = df.groupBy(item).agg(F.count("*").alias("members"), F.countDistinct(field).alias("values"), F.count(field).alias("_given"))
    return found.select(item, "members", "values", ((F.col("values") == 1) & (F.col("_given") == F.col("members"))).alias("all_equal"))


def set_sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., side)``: distinct rows of both, on side a, b or both."""
    both = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s"))).groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return both.select(*keys, F.when(F.col("_s") == 1, "a").when(F.col("_s") == 2, "b").otherwise("both").alias("side"))


def resolve(refs: DataFrame, targets: DataFrame, group: str, name: str) -> DataFrame:
    """``refs`` with ``target`` and ``how``: qualified, bare (if that name is one target's), ambiguous or unresolved.

    ``targets`` has ``group``, ``name`` and ``target``; of several targets of a name, qualified or not, the least counts,
    which ``ambiguous`` says of a bare one. Every reference comes out once.
    """
    full = targets.groupBy(F.col(group).alias("_g"), F.col(name).alias("_n")).agg(F.min("target").alias("_full"))
    bare = targets.groupBy(F.col(name).alias("_b")).agg(F.min("target").alias("_one"), F.countDistinct("target").alias("_many"))
    out = refs.join(full, (F.col(group) == F.col("_g")) & (F.col(name) == F.col("_n")), "left").join(bare, F.col(name) == F.col("_b"), "left")
    how = F.when(F.col("_full").isNotNull(), "qualified").when(F.col("_many") == 1, "bare").when(F.col("_many") > 1, "ambiguous").otherwise("unresolved")
    target = F.coalesce("_full", "_one")
    return out.select(*(F.col(c) for c in refs.columns), target.alias("target"), how.alias("how"))


def candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: pairs of steps of ``(a, t_a)`` and ``(b, t_b)``, with distinct tables, that can overlap by ``least`` or more.

    Tables go by how few steps read them. What a pair shares lies in both first parts, or past the end of the one that ends
    first, so that the rest of one of them bounds it. A null among the tables counts like any other.
    """
    flat = [x.select(s, F.size(f"t_{s}").alias("n"), F.explode(f"t_{s}").alias("table")) for x, s in ((a, "a"), (b, "b"))]
    often = flat[0].select("table").unionByName(flat[1].select("table")).groupBy(F.col("table").alias("_t")).agg(F.count("*").alias("often"))

    def rare(rows: DataFrame, s: str) -> DataFrame:
        ranked = rows.join(often, F.col("table").eqNullSafe(F.col("_t"))).withColumn("_r", F.row_number().over(Window.partitionBy(s).orderBy("often", "table")))
        rest = (F.ceil(F.col("n") * least - 1e-9) - 1).cast("int")
        return ranked.where(F.col("_r") <= F.col("n") - rest).select(s, F.col("table").alias(f"table_{s}"), F.col("n").alias(f"n_{s}"), rest.alias(f"rest_{s}"))

    near = F.col("table_a").eqNullSafe(F.col("table_b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    met = rare(flat[0], "a").join(rare(flat[1], "b"), near).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("k"), F.max(F.greatest("rest_a", "rest_b")).alias("rest"))
    return met.where((F.col("k") + F.col("rest")) * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9).select("a", "b")


def align_steps(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """``(a, b, matched_by)``: steps of two decompositions aligned one to one; null where a step has no partner.

    Both sides have ``(step, name, content, tables)``, ``step`` unique and not null. Steps pair by name (case aside),
    then, among those left, by content, then by the overlap of their tables (Jaccard, ``least`` or more), best first,
    ties by step. Equal names and contents pair in order of step. Two sets at ``least`` or more share one of the rarest
    tables of each (all but ``least`` of them, rounded up, and one more), so steps are joined on those and tables that
    nearly all read make no pairs. How many of those a pair shares bounds its overlap, for past the end of the shorter one's
    nothing but the rest can be shared: only pairs that can still reach ``least`` are measured whole. Best first is
    reached by rounds that take all pairs that are the best of both their steps.
    """
    matched = None
    left, right = a.select("step", "name", "content", "tables"), b.select("step", "name", "content", "tables")
    for how, key in (("name", F.lower("name")), ("content", F.col("content"))):
        nth = F.row_number().over(Window.partitionBy("_k").orderBy("step"))
        sides = [x.where(key.isNotNull()).withColumn("_k", key).withColumn("_i", nth).select("_k", "_i", F.col("step").alias(s)) for x, s in ((left, "a"), (right, "b"))]
        pairs = settled(sides[0].join(sides[1], ["_k", "_i"]).select("a", "b", F.lit(how).alias("matched_by")))
        matched = pairs if matched is None else matched.unionByName(pairs)
        left, right = (x.join(pairs.select(F.col(s).alias("step")), "step", "left_anti") for x, s in ((left, "a"), (right, "b")))
    sets = [x.select(F.col("step").alias(s), F.array_distinct("tables").alias(f"t_{s}")).where(F.size(f"t_{s}") > 0) for x, s in ((left, "a"), (right, "b"))]
    pairs = candidates(sets[0], sets[1], least).join(sets[0], "a").join(sets[1], "b")
    n = F.size(F.array_intersect("t_a", "t_b"))
    score = n / (F.size("t_a") + F.size("t_b") - n)
    open_pairs = settled(pairs.withColumn("score", score).where(F.col("score") >= least).select("a", "b", "score"))
    while not open_pairs.isEmpty():
        rank = lambda s: F.row_number().over(Window.partitionBy(s).orderBy(F.desc("score"), "a", "b"))
        best = settled(open_pairs.withColumn("_ra", rank("a")).withColumn("_rb", rank("b")).where("_ra = 1 AND _rb = 1").select("a", "b"))
        matched = matched.unionByName(best.withColumn("matched_by", F.lit("tables")))
        open_pairs = settled(open_pairs.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti").select("a", "b", "score"))
    alone_a = a.select(F.col("step").alias("a")).join(matched.select("a"), "a", "left_anti").select("a", F.lit(None).cast(b.schema["step"].dataType).alias("b"), F.lit("none").alias("matched_by"))
    alone_b = b.select(F.col("step").alias("b")).join(matched.select("b"), "b", "left_anti").select(F.lit(None).cast(a.schema["step"].dataType).alias("a"), "b", F.lit("none").alias("matched_by"))
    return matched.unionByName(alone_a).unionByName(alone_b)
