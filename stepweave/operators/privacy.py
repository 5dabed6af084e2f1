"""Literals in texts that should not leave: where they stand, as findings, and out of the texts.

Every rule is looked for in the text as it is, and a match is a span (0-based code points, end not included). Spans of
earlier rules keep later ones off: of spans that overlap only the first by rule order stays. Matches leave their text as
narrow rows with all they need (literal, masked context), so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Column names that hold ids or names; the rules in the order in which they claim spans, as (rule, what
# stands before the literal, the literal, what follows); then placeholder, severity and disposition of each rule.
ID_COLUMN = r"[\w\[\]]*(?:_ID|CSN|MRN|_NBR)[\w\[\]]*"
NAME_COLUMN = r"[\w\[\]]*(?:NAME|PROVIDER|PHYSICIAN)[\w\[\]]*"
RULES = (
    ("contact_literal", r"", r"\b\d{3}-\d{2}-\d{4}\b", r""),
    ("contact_literal", r"", r"\b[\w.+-]+@[\w-]+\.\w{2,}\b", r""),
    ("contact_literal", r"", r"\b\(?\d{3}\)?[-. ]\d{3}[-.]\d{4}\b", r""),
    ("id_literal", rf"(?i)\b{ID_COLUMN}\s*(?:=|!=|<>)\s*'?", r"\d{5,}", r"'?"),
    ("name_literal", rf"(?i)\b{NAME_COLUMN}\s*(?:=|<>|!=|LIKE)\s*", r"'[^']+'", r""),
    ("date_literal", r"", r"'\d{4}-\d{1,2}-\d{1,2}(?:[ T][\d:.]+)?'", r""),
    ("date_literal", r"", r"'\d{1,2}/\d{1,2}/\d{2,4}'", r""),
    ("id_literal", rf"(?i)\b{ID_COLUMN}\s*(?:=|!=|<>)\s*" + '"', r"\d{5,}", '"'),
    ("name_literal", rf"(?i)\b{NAME_COLUMN}\s*(?:=|<>|!=)\s*", r'"[^"]+"', r""),
    ("date_literal", r"", r'"\d{4}-\d{1,2}-\d{1,2}(?:[ T][\d:.]+)?"', r""),
    ("date_literal", r"", r'"\d{1,2}/\d{1,2}/\d{2,4}"', r""),
    ("threshold_literal", r"(?i)\b[\w\[\]\.]+\s*(?:>=|<=|>|<)\s*", r"\d+(?:\.\d+)?", r"\b"),
)
ID_LIST = ("id_literal", rf"(?i)\b{ID_COLUMN}\s+IN\s*\(", r"[^)]*", r"\)")
LIST_MEMBER = ("id_literal", "", r"\d{5,}", "")
PLACEHOLDERS = {"contact_literal": "<CONTACT>", "id_literal": "<ID>", "name_literal": "<NAME>", "date_literal": "<DATE>", "threshold_literal": "<VALUE>"}
SEVERITY = {"contact_literal": "high", "id_literal": "high", "name_literal": "high", "date_literal": "medium", "threshold_literal": "low"}
DISPOSITION = {"contact_literal": "redact", "id_literal": "redact", "name_literal": "redact", "date_literal": "redact", "threshold_literal": "open"}
CONTEXT = 30
# Ours: what every match of a rule, or of an id list, holds and is quick to look for.
SIGNS = (r"\d-\d\d-\d", r"@", r"\d{3}[-.]\d{4}", r"(?i)(?:=|<>)\s*'?\d{5}", r"(?i)(?:=|<>|LIKE)\s*'", r"'\d", r"'\d", r'(?:=|<>)\s*"\d{5}', r'(?:=|<>)\s*"', r'"\d', r'"\d', r"[<>]=?\s*\d")
LIST_SIGN = r"(?i)\sIN\s*\("


def _of(rule: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), rule)


def spans(text: Column, rule: tuple[str, str, str, str], sign: str | None = None, flags: str = "U") -> Column:
    """``array<struct<start, end>>``: the literals of all matches of a rule, from left to right, 0-based.

    Texts without ``sign``, a pattern that every match holds, are not searched any further. ``flags``: empty for texts of
    ASCII alone, which are searched faster; ``U`` knows the letters of all scripts.
    """
    _, before, literal, after = rule
    # From the end of one literal to the end of the next one.
    pattern = F.lit(rf"(?s{flags})\G.*?{before}({literal})(?={after})" if after else rf"(?s{flags})\G.*?{before}({literal})")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    whole, found = (F.transform(F.regexp_extract_all(text, pattern, F.lit(k)), F.length) for k in range(2))
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + m["w"]
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct((end - m["f"]).alias("start"), end.alias("end"))).alias("spans"))

    likely = F.rlike(text, F.lit((f"(?{flags})" if flags else "") + (sign or before + literal)))
    return F.when(likely, F.aggregate(F.arrays_zip(whole.alias("w"), found.alias("f")), start, step)["spans"]).otherwise(empty)


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def _candidates(text: Column, flags: str) -> Column:
    """All spans with their place in the order of the rules; every member of an id list comes before them."""

    def tagged(found: Column, order: int, rule: str) -> Column:
        return F.transform(found, lambda s: F.struct(F.lit(order).alias("prio"), s["start"].alias("start"), s["end"].alias("end"), F.lit(rule).alias("rule")))

    def members(held: Column) -> Column:
        inside = spans(_part(text, held["start"], held["end"]), LIST_MEMBER, flags=flags)
        return F.transform(inside, lambda s: F.struct((held["start"] + s["start"]).alias("start"), (held["start"] + s["end"]).alias("end")))

    lists = F.flatten(F.transform(spans(text, ID_LIST, LIST_SIGN, flags), members))
    rules = (tagged(spans(text, r, sign, flags), k, r[0]) for k, (r, sign) in enumerate(zip(RULES, SIGNS, strict=True), start=1))
    return F.concat(tagged(lists, 0, ID_LIST[0]), *rules)


def scan(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, rule, prio, start, end, matched_text, masked_context)``: every span that a rule claims, repeats included.

    Null texts have none; rows that repeat both id and text count once. The context has thirty characters on either side,
    line ends as blanks, and a placeholder for the literal.
    """
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")
    every = F.when(F.octet_length(text) == F.length(text), _candidates(text, "")).otherwise(_candidates(text, "U"))
    found = rows.select("id", "text", F.xxhash64("text").alias("th"), F.explode(every).alias("s")).select("id", "text", "th", "s.*")
    left, right = _part(F.col("text"), F.greatest(F.lit(0), F.col("start") - CONTEXT), F.col("start")), F.substr("text", F.col("end") + 1, F.lit(CONTEXT))
    around = F.replace(F.concat(left, _of(F.col("rule"), PLACEHOLDERS), right), F.lit("\n"), F.lit(" "))
    shown = F.regexp_replace(around, r"(?U)^\s+|\s+$", "").alias("masked_context")
    found = found.select("id", "th", "prio", "start", "end", "rule", _part(F.col("text"), F.col("start"), F.col("end")).alias("matched_text"), shown)
    # Runs of spans that overlap, each a few spans long, are settled on their own.
    order = Window.partitionBy("id", "th").orderBy("start", "end")
    apart = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = found.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("prio", "start", "end", "rule", "matched_text", "masked_context")
    runs = runs.groupBy("id", "th", "run").agg(F.sort_array(F.collect_list(span)).alias("spans"))

    def claim(held: Column, s: Column) -> Column:
        taken = F.exists(held, lambda h: (h["start"] < s["end"]) & (s["start"] < h["end"]))
        return F.when(taken, held).otherwise(F.array_append(held, s))

    kept = F.aggregate(F.slice("spans", 2, F.size("spans")), F.slice("spans", 1, 1), claim)
    return runs.select("id", F.explode(kept).alias("s")).select("id", "s.rule", "s.prio", "s.start", "s.end", "s.matched_text", "s.masked_context")


def finding_id(owner: Column, rule: Column, matched: Column) -> Column:
    """Sixteen hex digits that name a finding in every run; a null owner is the empty one."""
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (owner, rule, matched))
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def findings(spans_found: DataFrame) -> DataFrame:
    """``(finding_id, id, rule, matched_text, masked_context, severity, disposition)``: a literal of an owner and a rule is
    one finding, however often it stands; its context is that of the first by rule order and place."""
    first = F.min(F.struct("prio", "start", "masked_context"))
    one = spans_found.groupBy("id", "rule", "matched_text").agg(first.alias("first"))
    rule = F.col("rule")
    return one.select(
        finding_id(F.col("id"), rule, F.col("matched_text")).alias("finding_id"), "id", "rule", "matched_text", F.col("first.masked_context").alias("masked_context"),
        _of(rule, SEVERITY).alias("severity"), _of(rule, DISPOSITION).alias("disposition"),
    )


def with_dispositions(found: DataFrame, earlier: DataFrame) -> DataFrame:
    """Findings with what a steward has said before: ``earlier`` has ``(finding_id, disposition)``; empty says nothing."""
    said = earlier.where("disposition <> ''").groupBy("finding_id").agg(F.max("disposition").alias("_said"))
    return found.join(said, "finding_id", "left").withColumn("disposition", F.coalesce("_said", "disposition")).drop("_said")


def redacted(rows: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with every literal to be redacted replaced wherever it stands, the longest first (ties by rule, text).

    ``found`` has ``(id, rule, matched_text, disposition)``. Findings meet their owner's rows once, as one array.
    """
    order = F.struct((-F.length("matched_text")).alias("o"), "rule", "matched_text")
    held = found.where("disposition = 'redact'").groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_set(order)).alias("_found"))
    masked = F.aggregate("_found", F.col(f"`{text_col}`"), lambda t, f: F.replace(t, f["matched_text"], _of(f["rule"], PLACEHOLDERS)))
    out = rows.join(held, F.col(f"`{id_col}`") == F.col("_id"), "left")
    return out.withColumn(text_col, F.when(F.col("_found").isNull(), F.col(f"`{text_col}`")).otherwise(masked)).drop("_id", "_found")


def redacted_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes ``(node_id, layer, metric_id, sql_fragment, expression_sql, ...)``: fragments of transformations and expressions
    of decisions lose what their metric's findings redact; other layers stay as they are."""
    out = nodes
    for layer, field in (("transformation", "sql_fragment"), ("decision", "expression_sql")):
        out = redacted(out.withColumn("_own", F.when(F.col("layer") == layer, F.col("metric_id"))), found, "_own", field)
    return out.select(nodes.columns)


def redacted_measures(nodes: DataFrame) -> DataFrame:
    """Measures are scanned by node and redacted at once, by the rules' own dispositions; other layers stay as they are."""
    measures = nodes.where("layer = 'measure'")
    found = findings(scan(measures, "node_id", "dax_expression"))
    return redacted(measures, found, "node_id", "dax_expression").select(nodes.columns).unionByName(nodes.where("layer <> 'measure' OR layer IS NULL"))
