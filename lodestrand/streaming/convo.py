"""Conversation state on a stream: turns that arrive late or in pieces, counted per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_turns(turns: DataFrame, conv: str = "conv_id", at: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(conv, messages, assistant_turns, first_question, chars) so far; with an event time column ``at``, per hour with a watermark.

    The first question is that of the least turn number, whatever the order of arrival. Use output mode
    ``update`` or ``complete``, or with event time also ``append``.
    """
    keys = [conv]
    if at:
        turns = turns.withWatermark(at, delay)
        keys = [F.window(at, "1 hour").alias("hour"), conv]
    return turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("first_question"), F.sum(F.length("text")).alias("chars"),
    )
