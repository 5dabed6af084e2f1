"""Expressions over names and texts: folding, mentions, identities, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def content_key(text: Column) -> Column:
    """Sixteen hex digits of a text's hash, blind to case and to how blanks run."""
    return F.left(F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))), 256), F.lit(16))


def mentions(text: Column, token: str) -> Column:
    """Whether a token stands in a text as a whole; letters and figures around it deny it, an underscore doesn't."""
    safe = "".join(c if c.isalnum() else "\\" + c for c in token)
    return F.rlike(F.lower(text), F.lit(f"(^|[^a-z0-9]){safe.lower()}($|[^a-z0-9])"))


def mentions_all(text: Column, phrase: str) -> Column:
    """Whether every word of a phrase stands in a text as a whole word, in any order."""
    out = F.lit(True)
    for token in phrase.split():
        out = out & mentions(text, token)
    return out


def object_identity(sql: Column) -> Column:
    """``(schema, name, kind)`` from the CREATE or ALTER header of a definition; the default schema is dbo."""
    head = r"(?is)\b(?:create(?:\s+or\s+alter)?|alter)\s+(procedure|proc|view)\s+(?:\[?(\w+)\]?\s*\.\s*)?\[?(\w+)\]?"
    kind = F.lower(F.regexp_extract(sql, head, 1))
    schema, name = F.regexp_extract(sql, head, 2), F.regexp_extract(sql, head, 3)
    found = F.struct(F.when(schema == "", "dbo").otherwise(schema).alias("schema"), name.alias("name"), F.when(kind == "view", "view").otherwise("procedure").alias("kind"))
    return F.when(name != "", found)


def plain_whitespace(sql: Column) -> Column:
    """Marks and odd blanks become plain ones, runs one blank; lines are trimmed and empty ones dropped."""
    text = F.regexp_replace(sql, "[\ufeff\u200b]", "")
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?|\u000b|\u000c", "\n"), "[ \t\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " ?\n[ \n]*", "\n"), "^[ \n]+|[ \n]+$", "")


# What a parse error says, all words of a row together, in the order in which it is looked for.
ERROR_WORDS = (
    ("no_query", ("no select",)), ("no_query", ("no sql queries found",)),
    ("complex_sql", ("error tokenizing",)), ("complex_sql", ("unexpected token",)), ("complex_sql", ("invalid expression",)),
    ("all_queries_failed", ("none of", "parsed successfully")), ("parse_failure", ("failed to parse sql",)), ("extraction_failure", ("scriptdom",)),
)


def error_category(message: Column) -> Column:
    """The category of a parse error; ``unknown`` if its message says nothing of the kind, or is null."""
    said, out = F.lower(F.coalesce(message, F.lit(""))), None
    for category, words in ERROR_WORDS:
        held = F.lit(True)
        for word in words:
            held = held & F.contains(said, F.lit(word))
        out = F.when(held, category) if out is None else out.when(held, category)
    return out.otherwise("unknown")


def exec_target(sql: Column) -> Column:
    """``(database, schema, name)`` that an EXEC names, brackets or not; what isn't named is empty; null without one."""
    named = F.regexp_extract(sql, r"(?iU)\bexec(?:ute)?\s+((?:\[?\w+\]?\s*\.\s*){0,2}\[?\w+\]?)", 1)
    parts = F.reverse(F.split(F.regexp_replace(named, r"[\[\]\s]", ""), "[.]"))
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    return F.when(named != "", F.struct(part(2).alias("database"), part(1).alias("schema"), part(0).alias("name")))


def column_refs(expression: Column) -> Column:
    """Distinct ``table.column`` of the references ``'table'[column]`` and ``table[column]`` of a measure, sorted."""
    whole = F.regexp_extract_all(expression, F.lit(r"'[^']+'\[[^\]]+\]|\b\w+\[[^\]]+\]"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(whole, lambda m: F.replace(F.replace(F.replace(m, F.lit("'"), F.lit("")), F.lit("["), F.lit(".")), F.lit("]"), F.lit("")))))


def table_refs(sql: Column, keywords: tuple[str, ...] = ("select", "where", "openjson")) -> Column:
    """Rough table names after FROM and JOIN, upper case and sorted; keywords and temporary tables left out."""
    names = F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:from|join)\s+([#\w.\[\]]+)"), F.lit(1)), lambda m: F.upper(F.regexp_replace(m, r"[\[\]]", "")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda m: (m != "") & ~m.startswith("#") & ~F.lower(m).isin(*keywords))))


def sanitised(token: Column, most: int = 120) -> Column:
    """A search token: quotes are blanks, blanks run together, ``most`` characters at the most."""
    return F.substr(F.trim(F.regexp_replace(token, "[\"'`\\s]+", " ")), F.lit(1), F.lit(most))


def titled(name: Column) -> Column:
    """A name for people: underscores and hyphens are blanks, words capitalised."""
    return F.initcap(F.trim(F.regexp_replace(name, "[_-]+", " ")))


def anonymised(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A text with ordered replacements ``(kind, from, to)``: whole words case aside, whole numbers, or literally."""
    for kind, old, new in rules:
        safe = "".join(c if c.isalnum() else "\\" + c for c in old)
        if kind == "word":
            text = F.regexp_replace(text, rf"(?i)\b{safe}\b", new)
        elif kind == "number":
            text = F.regexp_replace(text, rf"(?<![0-9]){safe}(?![0-9])", new)
        else:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def leaks(df: DataFrame, id_col: str, text_col: str, terms: list[str], around: int = 30) -> DataFrame:
    """``(id, term, context)``: forbidden terms left in texts, case aside, at their first place with what stands around it."""
    listed = F.array(*(F.lit(t.lower()) for t in terms)).cast("array<string>")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), F.explode(F.filter(listed, lambda t: F.contains(F.lower(text_col), t))).alias("term"))
    at = F.instr(F.lower("_t"), F.col("term"))
    start = F.greatest(F.lit(1), at - around)
    return rows.select("id", "term", F.substr("_t", start, at - start + F.length("term") + around).alias("context"))


def date_token(token: Column, today: str) -> Column:
    """Dates by token: ``T`` today, ``MB`` and ``ME`` begin and end of the month, ``YB`` and ``YE`` of the year; ``-n`` after it
    takes off days, months and years. Other tokens are read as dates, and what is none is today."""
    day = F.lit(today).cast("date")
    form = r"^\s*(T|MB|ME|YB|YE)\s*(?:-\s*([0-9]{1,9})\s*)?$"
    head = F.regexp_extract(F.upper(token), form, 1)
    back = -F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.upper(token), form, 2), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    month, year = F.add_months(day, back), F.year(day) + back
    base = F.when(head == "T", F.date_add(day, back)).when(head == "MB", F.trunc(month, "month")).when(head == "ME", F.last_day(month))
    base = base.when(head == "YB", F.make_date(year, F.lit(1), F.lit(1))).when(head == "YE", F.make_date(year, F.lit(12), F.lit(31)))
    return F.coalesce(base, F.try_to_timestamp(token).cast("date"), day)


# What an answer says that found nothing.
REFUSALS = ("wasn't able to find", "couldn't find", "not found", "hasn't been", "i'm happy to help", "don't have information", "not available", "no documented", "i don't have")


def says_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases, case aside; false for null."""
    return F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p)), F.lit(False))


def refuses(answer: Column) -> Column:
    return says_any(answer, REFUSALS)


def match_key(name: Column) -> Column:
    """What of an object's name a report is matched by: without its schema, ``_PBI`` at the end, ``V_`` or ``USP_`` and the
    company at the start, in lower case with blanks for underscores. Null for other names, and if nothing is left."""
    bare = F.element_at(F.split(F.trim(name), "[.]"), -1)
    core = F.regexp_replace(F.regexp_replace(bare, "(?i)_PBI$", ""), "(?i)^(V|USP)_", "")
    key = F.trim(F.regexp_replace(F.lower(F.regexp_replace(core, "^[^_]*_", "")), r"[_\s]+", " "))
    return F.when(F.rlike(bare, F.lit("(?i)_PBI$")) & (key != ""), key)


def report_key(name: Column) -> Column:
    """A report's name to match by: ids in brackets go, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"(?i)\[[0-9a-f-]+\]\s*", "")), r"\s+", " "))


def decoded(payload: Column) -> Column:
    """The text of a Base64 payload; null for what is none."""
    return F.try_to_binary(payload, F.lit("base64")).cast("string")


# Sources of a partition that are no SQL, in the order in which they are looked for.
NON_SQL_SOURCES = (
    "Snowflake.Databases", "Folder.Files", "Excel.Workbook", "SharePoint.Files", "SharePoint.Tables", "Web.Contents", "ActiveDirectory.Domains",
    "Table.FromRows", "Table.Combine", "Table.NestedJoin", "DateTime.LocalNow", "DateTime.FixedLocalNow", "List.Dates", "#table",
)


def partition_fallout(content: Column) -> Column:
    """Why a table's definition gives no SQL source: calculated_table, no_partition, directlake_entity,
    ``non_sql_source:<function>`` or unrecognized_shape."""
    kind = F.regexp_extract(content, r"partition\s+[^\n]+=\s*(m|entity)\b", 1)
    out = F.when(F.rlike(content, F.lit(r"partition\s+[^\n]+=\s*calculated\b")), "calculated_table").when(kind == "", "no_partition").when(kind == "entity", "directlake_entity")
    known = F.get(F.filter(F.array(*map(F.lit, NON_SQL_SOURCES)), lambda f: F.contains(content, f)), F.lit(0))
    return out.when(known.isNotNull(), F.concat(F.lit("non_sql_source:"), known)).otherwise("unrecognized_shape")
