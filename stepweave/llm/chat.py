"""Chat formatting in Spark expressions only.

A conversation is its blocks one after the other; a block is ``<|role|>``, the texts of adjacent turns of that role with
``<|+|>`` between them, and ``<|end|>``. Inside roles and texts ``\\``, ``<`` and ``|`` are written ``\\e``, ``\\l`` and
``\\p``, so that no text holds a mark, and a role that is a mark's name (``end``, ``+``) is written ``\\m`` and the name, so that
no block's head is a mark: reading back gives every turn as it was, whatever its role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import plain

OPEN, CLOSE, SEAM, END = "<|", "|>", "<|+|>", "<|end|>"
#: Roles that would read as a mark, and what stands before them.
NAMES, NAMED = ("end", "+"), "\\m"
CODES = (("\\", "\\e"), ("<", "\\l"), ("|", "\\p"))


def escape(text: Column) -> Column:
    for raw, code in CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.when(role.isin(*NAMES), F.concat(F.lit(NAMED), role)).otherwise(escape(role))


def unescape_role(role: Column) -> Column:
    named = F.startswith(role, F.lit(NAMED))
    return F.when(named, F.substr(role, F.lit(len(NAMED) + 1))).otherwise(unescape(role))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row a conversation.

    Turns are sorted by number (null first; equal numbers by role, then text, as they were before escaping) and adjacent
    turns of one role become one block. ``loss_spans`` has ``(start, length)`` in code points of each text of the role
    ``learn`` in ``formatted``, without marks. Null roles and texts are empty. Rows with a null conversation are one
    conversation, as in a GROUP BY. An empty table gives an empty result. Repeated rows are turns of their own.
    """
    rows = plain(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))

    # A turn with the marks before it; adjacent turns of a role share a block.
    def marked(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)
        head = F.when(i == 0, F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE))).when(before["role"] == t["role"], F.lit(SEAM)).otherwise(F.concat(F.lit(END + OPEN), t["role"], F.lit(CLOSE)))
        return F.struct(head.alias("head"), t["text"].alias("text"), (t["role"] == escape_role(F.lit(learn))).alias("learn"))

    chats = chats.select("conv_id", F.transform("turns", marked).alias("parts"))
    formatted = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        text_at = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(text_at.alias("start"), F.length(p["text"]).cast("long").alias("length")))
        return F.struct((text_at + F.length(p["text"])).cast("long").alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return chats.select("conv_id", formatted.alias("formatted"), F.aggregate("parts", start, walk)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, as they were before formatting."""

    def block_turns(block: Column) -> Column:
        close = F.instr(block, CLOSE)
        role = unescape_role(F.substr(block, F.lit(len(OPEN) + 1), close - len(OPEN) - 1))
        texts = F.split(F.substr(block, close + len(CLOSE)), r"<\|\+\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, block_turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the output and unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
