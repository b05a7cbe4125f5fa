"""Ordered unions: the first of equal rows stays, earlier sources come first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.text import result_key


def first_per_key(rows: DataFrame, per: list[str], distinct: list[str], order: list[str], cap: int | None = None) -> DataFrame:
    """Of rows equal in ``distinct`` the first by ``order``; with ``cap`` the first so many of each ``per``. Adds ``rank``."""
    one = F.row_number().over(Window.partitionBy(*per, *distinct).orderBy(*order))
    rows = rows.withColumn("_r", one).where("_r = 1").drop("_r")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return rows if cap is None else rows.where(F.col("rank") <= cap)


def merge_results(results: DataFrame, per: list[str], order: list[str], cap: int) -> DataFrame:
    """Web results of several sources: one for each url (or title and snippet), in order, ``cap`` at most."""
    keyed = results.withColumn("result_key", result_key(F.col("title"), F.col("snippet"), F.col("url")))
    return first_per_key(keyed, per, ["result_key"], order, cap)


def fan_out_cap(max_results: int) -> int:
    return max(4, min(max_results, 6))


def normalise_results(results: DataFrame, per: list[str], order: list[str], cap: int) -> DataFrame:
    """Trimmed title, snippet and url; rows without a url are dropped; the first ``cap`` stay."""
    rows = results.select(*per, *order, *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "snippet", "url")]).where("url <> ''")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= cap)


def merge_flows(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, ord, category, direction, ...): flows of both, each (category, direction) once, the first table's first."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_c", F.lower("category")).withColumn("_d", F.trim("direction"))
    return first_per_key(both, [key], ["_c", "_d"], ["_s", "ord"]).withColumn("ord", F.col("rank") - 1).drop("_s", "_c", "_d", "rank")


def add_codes(base: DataFrame, extra: DataFrame, focal: DataFrame, key: str) -> DataFrame:
    """(key, role, code): the base's codes and those of ``extra`` that it lacks; a sending mention counts as receiving; the focal country is never added."""
    more = extra.withColumn("role", F.when(F.col("role") == "sending", "receiving").otherwise(F.col("role")))
    more = more.join(focal.select(key, F.col("focal").alias("code")), [key, "code"], "left_anti").join(base.select(key, "code"), [key, "code"], "left_anti")
    one = F.row_number().over(Window.partitionBy(key, "code").orderBy("role"))
    more = more.select(key, "role", "code").distinct().withColumn("_r", one).where("_r = 1").drop("_r")
    return base.select(key, "role", "code").unionByName(more)


def role_union(systems: DataFrame, focal: DataFrame, key: str) -> DataFrame:
    """(key, codes): all codes of an analysis, the focal one included."""
    rows = systems.select(key, "code").unionByName(focal.select(key, F.col("focal").alias("code")))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))
