"""Conversations as ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged_queries(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, query) of every user turn: the first question, and behind it the refinement where it isn't the first."""
    users = turns.where("role = 'user'")
    order = Window.partitionBy(conv).orderBy(turn)
    first = F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nth = F.row_number().over(order)
    text = F.when(nth == 1, F.col("text")).otherwise(F.concat(F.lit("Original question: "), first, F.lit("\nRefinement: "), F.col("text")))
    return users.select(conv, turn, text.alias("query"))


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Adds ``history_len``, ``history_chars`` (both of the messages before) and ``turn_count`` (assistant turns so far)."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.select(
        "*", F.count(F.lit(1)).over(before).alias("history_len"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("history_chars"),
        F.count_if(F.col("role") == "assistant").over(so_far).alias("turn_count"),
    )


def histories(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Adds ``history``: all earlier messages in order as (role, text)."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(before))


def token_budget(turns: DataFrame, conv: str = "conv_id", limit: int = 480_000) -> DataFrame:
    """(conv, chars, tokens, over): characters, a quarter of them as tokens, and whether they pass the limit."""
    total = turns.groupBy(conv).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return total.select(conv, "chars", F.floor(F.col("chars") / 4).cast("bigint").alias("tokens"), (F.col("chars") > limit).alias("over"))
