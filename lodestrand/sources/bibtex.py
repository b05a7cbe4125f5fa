"""BibTeX in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import squeeze

KINDS = ("article", "incollection", "inproceedings", "book")
#: A value in braces, with braces inside up to three deep.
_VALUE = r"\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, raw): every entry of the files under ``path``; a byte order mark is dropped."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return split_entries(text, "file", "value")


def split_entries(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), r"(?m)^(?=@\w+\s*\{)"), lambda x: x.startswith("@"))
    return texts.select(key, F.posexplode(parts).alias("ord", "raw"))


def field(raw: Column, name: str) -> Column:
    """The value of a field with single spaces; null without. Braces inside may be nested three deep."""
    pattern = rf"(?is)[\s,{{]{name}\s*=\s*{_VALUE}"
    return F.when(raw.rlike(pattern), squeeze(F.regexp_extract(raw, pattern, 1)))


def parse(entries: DataFrame, defaults: bool = True, separators: str = ",") -> DataFrame:
    """Papers: key, title, authors, year, journal, doi, keywords, cited_by, and kind and raw.

    With ``defaults`` missing strings are empty and missing numbers 0, else null. Only articles, parts of
    collections and proceedings, and books. Keywords are split at the ``separators`` given.
    """
    raw = F.col("raw")
    bare = lambda c: F.regexp_replace(c, "[{}]", "")
    fill = (lambda c, v: F.coalesce(c, F.lit(v))) if defaults else (lambda c, v: c)
    year = F.regexp_extract(F.coalesce(field(raw, "year"), F.regexp_extract(raw, r"(?i)[\s,]year\s*=\s*(\d+)", 1)), r"^(\d+)$", 1).try_cast("int")
    cited = F.regexp_extract(F.coalesce(field(raw, "annote"), F.lit("")), r"Cited by:\s*(\d+)", 1).try_cast("int")
    words = F.transform(F.split(F.lower(F.coalesce(field(raw, "keywords"), F.lit(""))), rf"\s*[{separators}]\s*"), lambda w: F.trim(w))
    rows = entries.where(F.lower(F.regexp_extract(raw, r"^@(\w+)", 1)).isin(*KINDS))
    return rows.select(
        *[c for c in entries.columns if c != "raw"], F.trim(F.regexp_extract(raw, r"^@\w+\s*\{\s*([^,\s]+)", 1)).alias("key"), fill(bare(field(raw, "title")), "").alias("title"),
        fill(bare(field(raw, "author")), "").alias("authors"), fill(year, 0).alias("year"), fill(F.replace(bare(field(raw, "journal")), F.lit("\\&"), F.lit("&")), "").alias("journal"),
        fill(field(raw, "doi"), "").alias("doi"), F.array_distinct(F.filter(words, lambda w: w != "")).alias("keywords"), fill(cited, 0).alias("cited_by"),
        F.lower(F.regexp_extract(raw, r"^@(\w+)", 1)).alias("kind"), "raw",
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)([&%#_])", r"\\$1")


def render(papers: DataFrame) -> DataFrame:
    """(key, raw): entries with the fields that aren't empty; abstracts are cut to 2000 characters."""
    line = lambda name, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), c.cast("string"), F.lit("}")))
    fields = [line("title", F.col("title")), line("author", F.col("authors")), line("year", F.nullif("year", F.lit(0))), line("journal", escape(F.col("journal"))), line("doi", F.col("doi")), line("keywords", F.array_join("keywords", ", "))]
    if "abstract" in papers.columns:
        fields.append(line("abstract", F.substring("abstract", 1, 2000)))
    kind = F.col("kind") if "kind" in papers.columns else F.lit("article")
    return papers.select("key", F.concat(F.lit("@"), kind, F.lit("{"), "key", F.lit(",\n"), F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit("\n}")).alias("raw"))


def with_keywords(raw: Column, keywords: Column) -> Column:
    """An entry with its keywords field replaced, inserted before the end, or deleted where ``keywords`` is null."""
    pattern = rf"(?is),?\s*keywords\s*=\s*{_VALUE}"
    without = F.regexp_replace(raw, pattern, "")
    added = F.regexp_replace(F.rtrim(F.regexp_replace(without, r",?\s*\}\s*$", "")), r"$(?!\n)", "")
    return F.when(keywords.isNull(), without).otherwise(F.concat(added, F.lit(",\n  keywords = {"), keywords, F.lit("}\n}")))


def write_subset(entries: DataFrame, keys: DataFrame, path: str) -> None:
    """The entries of some keys, in order, as text with blank lines between."""
    key = F.trim(F.regexp_extract("raw", r"^@\w+\s*\{\s*([^,\s]+)", 1))
    entries.withColumn("key", key).join(keys, "key", "left_semi").orderBy("ord").select(F.trim("raw").alias("value")).write.option("lineSep", "\n\n").text(path)
