"""Descriptions against the one source they describe, and what is left of them without the lines that it doesn't bear.

Evidence comes once to each description, by owner. Everything after that happens inside the row, with arrays of lines: a
text meets its evidence by a join of one row with one row, however many lines it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Figures and quotes that have to be grounded, words that claim a filter, words that say nothing, the parts
# of a statement that decide, claims that nothing is filtered, and lines of a dictionary that a step is given.
NUMBER, QUOTED = r"\d{2,}", r"'([^']{1,40})'"
CLAIM = r"(?i)\b(exclud\w*|includes? only|only includ\w*|filters?\b|requir\w+|must have|limited to|restrict\w*)\b"
STOPWORDS = (
    "encounters includes include included excludes exclude excluded filters filter filtered records results patients patient orders information department departments emergency hospital associated "
    "between during where which their those based table tables step steps only that this with from have been were each every there measurements medications details specific specified certain various"
)
DECIDING = r"(?is)\b(?:WHERE|HAVING|ON|AND|WHEN)\b(.{0,240})"
NO_FILTER = r"(?i)\b(?:without|no|not)\b[^.\n]{0,60}?\bfilter"
DICTIONARY_LINES = 30
#: What is between words, and the characters of a name by which it is looked up in the words of fragments.
NO_WORD, RUN = r"[^\p{L}\p{N}_]+", 6

_FOUND = "array<struct<kind:string,value:string>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group))


def text_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def _violations(text: Column, ground: Column, low: Column, conditions: Column) -> Column:
    """All that a text says and its evidence doesn't: figures, then quotes, then claims of a filter, line by line."""
    tag = lambda found, kind: F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    numbers = F.filter(F.array_distinct(_all(text, NUMBER)), lambda n: ~F.contains(ground, n))
    probe = lambda q: F.coalesce(F.get(_all(q, NUMBER), F.lit(0)), q)
    quotes = F.filter(F.array_distinct(_all(text, QUOTED, 1)), lambda q: ~F.contains(low, F.lower(probe(q))))
    stop = F.array(*map(F.lit, STOPWORDS.split()))

    def judged(line: Column) -> Column:
        terms = F.filter(_all(F.lower(line), "[a-z]{5,}"), lambda w: ~F.array_contains(stop, w))
        present = F.filter(terms, lambda w: F.contains(low, w))
        decided = F.exists(present, lambda w: F.contains(conditions, w))
        literal = F.exists(_all(line, NUMBER), lambda n: F.contains(ground, n))
        kind = F.when((F.size(terms) == 0) | literal | decided, F.lit(None)).when(F.size(present) == 0, "ungrounded_claim").otherwise("selected_not_filtered")
        return F.struct(kind.alias("kind"), line.alias("value"))

    claims = F.filter(text_lines(text), lambda x: F.startswith(x, F.lit("- ")) & F.rlike(x, F.lit(f"(?U){CLAIM}")))
    claims = F.filter(F.transform(claims, judged), lambda c: c["kind"].isNotNull())
    return F.concat(tag(numbers, "ungrounded_number"), tag(quotes, "ungrounded_quote"), claims).cast(_FOUND)


def _evidence(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``texts`` with their evidence as ``_ground``, its lower case, and its deciding part as ``_conditions``."""
    rows = texts.join(evidence.select("owner", "fragment", "dict_lines", "dialect"), "owner", "left")
    fragment = F.coalesce("fragment", F.lit(""))
    ground = F.concat(fragment, F.lit("\n"), F.coalesce(F.array_join("dict_lines", "\n"), F.lit("")))
    rows = rows.withColumn("_ground", ground).withColumn("_low", F.lower("_ground"))
    deciding = F.lower(F.array_join(_all(fragment, DECIDING, 1), " "))
    return rows.withColumn("_conditions", F.when(F.coalesce("dialect", F.lit("sql")) == "sql", deciding).otherwise(F.col("_low")))


def enforced(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(owner, text, violations)``: each description as it may stand, and the ``(kind, value)`` held against it.

    ``texts`` is ``(owner, text)``, ``evidence`` ``(owner, fragment, dict_lines, dialect)``, one row an owner. Figures of
    two digits and quotes have to stand in the evidence. A line ``- ...`` that claims a filter needs one of its telling
    words where the statement decides (anywhere in the evidence for a ``dialect`` other than sql), or a grounded figure.
    Lines whose claim fails go, the others stay in order; if what is left still fails, or is nothing, the text is empty:
    rather nothing than what is made up. A line that ends in a quote mark, or holds a backslash, a dash between blanks or
    both kinds of quotes, is not cut out alone; the whole text goes. Null texts are empty.
    """
    rows = _evidence(texts.select("owner", F.coalesce("text", F.lit("")).alias("text")), evidence)
    judge = lambda text: _violations(text, F.col("_ground"), F.col("_low"), F.col("_conditions"))
    rows = rows.withColumn("violations", judge(F.col("text")))
    claims = F.filter("violations", lambda v: v["kind"].isin("ungrounded_claim", "selected_not_filtered"))
    whole = lambda v: F.rlike(v, F.lit(r"""["']$|\\| — """)) | (F.contains(v, F.lit("'")) & F.contains(v, F.lit('"')))
    bad = F.filter(F.transform(claims, lambda v: v["value"]), lambda v: ~whole(v))
    raw = F.split("text", "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    kept = F.filter(raw, lambda x: ~F.array_contains(F.col("_bad"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    rows = rows.withColumn("_bad", bad).withColumn("_kept", F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", ""))
    rest = F.when(F.size(judge(F.col("_kept"))) == 0, F.col("_kept")).otherwise("")
    return rows.select("owner", F.when(F.size("violations") == 0, F.col("text")).otherwise(rest).alias("text"), "violations")


def scope_violations(texts: DataFrame) -> DataFrame:
    """``(owner, line_no, line)``: lines that say nothing is filtered, of ``(owner, text, decisions)`` with decisions; from 1."""
    rows = texts.where("decisions > 0").select("owner", F.posexplode(text_lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    return rows.where(F.rlike("line", F.lit(NO_FILTER))).select("owner", (F.col("pos") + 1).alias("line_no"), "line")


def _names_within(steps: DataFrame, names: DataFrame) -> DataFrame:
    """``(step_id, low)``: which lower-case ``names`` (``low``, distinct) may stand in a step's fragment, each once.

    A text that holds a name has a word that holds the name's longest word; a word that holds another has its rarest run of
    ``RUN`` characters. Words of both sides meet by that run, once however many texts have them. A name of one word surely
    stands there; names of several, or of none, still have to be looked for.
    """
    words = lambda c: F.filter(F.split(c, NO_WORD), lambda w: w != "")
    longest = F.array_max(F.transform(words(F.col("low")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))
    names = names.withColumn("key", F.coalesce(longest, F.lit("")))
    keys = names.select("key").distinct().withColumn("size", F.least(F.length("key"), F.lit(RUN)))
    each = keys.withColumn("run", F.explode(runs(F.col("key"), F.col("size"))))
    often = each.groupBy("run").agg(F.count("*").alias("often"))
    rarest = each.join(often, "run").groupBy("key").agg(F.min(F.struct("often", "run"))["run"].alias("run"))
    held = steps.select("step_id", F.explode(F.array_distinct(F.concat(words(F.col("_low")), F.array(F.lit(""))))).alias("word"))
    parts = held.select("word").distinct().join(F.broadcast(keys.select("size").distinct()), (F.length("word") >= F.col("size")) & ((F.col("size") == 0) == (F.col("word") == "")))
    met = parts.select("word", F.explode(runs(F.col("word"), F.col("size"))).alias("run")).join(rarest, "run").where(F.contains("word", "key")).select("word", "key").distinct()
    return held.join(met.join(names, "key").select("word", "low"), "word").select("step_id", "low").distinct()


def dictionary_lines(steps: DataFrame, reads: DataFrame, columns: DataFrame, described: DataFrame, most: int = DICTIONARY_LINES) -> DataFrame:
    """``(step_id, lines)``: what the dictionary says of the tables a step reads, and of those columns that it names.

    ``steps`` is ``(step_id, fragment)``, ``reads`` ``(step_id, table_id)``, ``columns`` ``(table_id, column_id)``,
    ``described`` ``(node_id, name, description)``. Tables go by id, each followed by its columns by id; what has no
    description has no line. ``most`` lines of a step at the most; steps without any are left out. Names are found in the
    fragments first, so that a step meets those columns alone which it names.
    """
    told = described.where(F.trim(F.coalesce("description", F.lit(""))) != "").select("node_id", "name", F.trim("description").alias("said"))
    own = reads.select("step_id", "table_id").distinct()
    tables = own.join(told, own.table_id == told.node_id).select("step_id", "table_id", F.lit("").alias("column_id"), F.concat(F.lit("- "), "name", F.lit(": "), "said").alias("line"))
    known = columns.select("table_id", "column_id").distinct().join(told, F.col("column_id") == F.col("node_id")).select("table_id", "column_id", "name", "said", F.lower("name").alias("low"))
    low = steps.select("step_id", F.lower("fragment").alias("_low"))
    within = _names_within(low, known.select("low").distinct()).join(low, "step_id").where(F.contains("_low", "low")).select("step_id", "low")
    named = own.join(within, "step_id").join(known, ["table_id", "low"])
    lines = tables.unionByName(named.select("step_id", "table_id", "column_id", F.concat(F.lit("  - "), "name", F.lit(": "), "said").alias("line")))
    order = Window.partitionBy("step_id").orderBy("table_id", "column_id", "line")
    lines = lines.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return lines.groupBy("step_id").agg(F.array_sort(F.collect_list(F.struct("k", "line")))["line"].alias("lines"))
