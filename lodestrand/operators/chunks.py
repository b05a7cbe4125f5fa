"""Markdown documents to passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import text as T


def windows(words: Column, size: int = 250, overlap: int = 50) -> Column:
    """Array of word arrays: windows of ``size`` that share ``overlap``, up to the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    n, step = F.size(words), size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def sections(text: Column, level: str = "#{1,3}") -> Column:
    """Array of (heading, body) in order: before the first heading ``HEADER``; heading lines start with one to three #."""
    heading = rf"(?m)^{level}\s+(.+)$"
    parts = F.struct(F.split(text, heading).alias("bodies"), F.regexp_extract_all(text, F.lit(heading), F.lit(1)).alias("names"))
    name = lambda v, i: F.when(i == 0, "HEADER").otherwise(F.trim(F.get(v["names"], i - 1)))
    return T.let(parts, lambda v: F.transform(v["bodies"], lambda b, i: F.struct(name(v, i).alias("heading"), b.alias("body"))))



def chunk(docs: DataFrame, key: str, text_col: str = "text", size: int = 250, overlap: int = 50, least: int = 30) -> DataFrame:
    """Adds ``section``, ``chunk_index`` and ``text`` of every passage; other columns are kept.

    Text behind a references heading, sections with a reference heading or under ``least`` words, short
    last windows, and passages that read like a bibliography are left out; the index counts what stays.
    """
    cleaned = F.regexp_replace(F.regexp_replace(F.col(text_col), r"<!--\s*image\s*-->", ""), r"\|\s*#\s*\|.*?\n", "")
    rows = docs.withColumn("_s", F.explode(F.transform(sections(T.truncate_at_references(cleaned)), lambda s, i: F.struct(i.alias("at"), s["heading"].alias("heading"), T.squeeze(s["body"]).alias("body")))))
    rows = rows.where((F.col("_s.body") != "") & ~T.is_reference_heading(F.col("_s.heading")))
    rows = rows.withColumn("_w", F.split("_s.body", " ")).where(F.size("_w") >= least)
    rows = rows.select("*", F.posexplode(windows(F.col("_w"), size, overlap)).alias("_at", "_words")).where(F.size("_words") >= least)
    rows = rows.withColumn("_text", F.array_join("_words", " ")).where(~T.is_reference_text(F.col("_text")))
    index = F.row_number().over(Window.partitionBy(key).orderBy("_s.at", "_at")) - 1
    rows = rows.withColumn("chunk_index", index).withColumn("section", F.col("_s.heading"))
    return rows.drop(text_col).withColumnRenamed("_text", text_col).drop("_s", "_w", "_at", "_words")


def fingerprint(rows: DataFrame, order: list[str], columns: list[str], groups: int = 65_536) -> DataFrame:
    """One row: ``rows``, and ``fingerprint``, a SHA-256 over the named columns of all rows, whatever their order in the table.

    Hashed in two levels: rows fall into ``groups`` by the first digits of the MD5 of their key, the hashes
    of a group are sorted and hashed, then those of the groups; ``groups`` is a power of 16.
    """
    digits = len(f"{groups - 1:x}")
    part = F.substring(F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order])), 1, digits)
    line = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*order, *columns]]), 256)
    lows = rows.select(part.alias("g"), line.alias("h")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return lows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))
