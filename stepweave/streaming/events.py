"""Turn and feedback events: one JSON object a line, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN = "event_at string, user_id string, conversation_id string, turn_index int, question string, tools_used array<string>, basis string, answered boolean, verdict string, comment string"


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events with a ``kind``: turn, feedback (it has a verdict), or malformed; nothing is dropped."""
    event = F.from_json(F.col(column), TURN, {"mode": "PERMISSIVE"})
    rows = lines.select(event.alias("e"), F.col(column).alias("raw")).select("e.*", "raw")
    bad = F.col("event_at").isNull() | F.col("conversation_id").isNull()
    kind = F.when(bad, "malformed").when(F.col("verdict").isNotNull(), "feedback").otherwise("turn")
    return rows.withColumn("kind", kind)


def new_events(events: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("conversation_id", "turn_index", "event_at"), order: tuple[str, ...] = ()) -> DataFrame:
    """Events whose key is not stored yet; of those that share a key the first by ``order``, then by all columns.

    Null parts of a key are equal to each other, so an event without a turn comes in once.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *(c for c in events.columns if c not in order)))
    first = events.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    known = stored.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return first.join(known, same, "left_anti")


def usage_rows(events: DataFrame) -> DataFrame:
    """``(user_id, event_type, n, last_at)``: how often each user did what, and when last."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


def windowed_counts(events: DataFrame, time_col: str, kind_col: str, value_col: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and kind; on a stream, windows close ``late`` after their end."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    out = timed.groupBy(F.window(time_col, width).alias("w"), F.col(kind_col).alias("kind")).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "kind", "n", "total")
