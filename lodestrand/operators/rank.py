"""Ranking of papers and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paper_score(terms: Column, title: Column, keywords: Column, fulltext: Column, cited_by: Column) -> Column:
    """3 for a term in, or around, a keyword, 2 for a term in the title, up to 3 for full-text similarity, up to 2 for citations."""
    in_keywords = F.size(F.filter(terms, lambda t: F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(k, t) | F.contains(t, k))))
    in_title = F.size(F.filter(terms, lambda t: F.contains(F.lower(F.coalesce(title, F.lit(""))), t)))
    text = F.least(F.lit(3.0), F.coalesce(fulltext, F.lit(0.0)) * 3.0)
    cites = F.when(cited_by > 0, F.least(F.lit(2.0), F.log10(cited_by + 1))).otherwise(0.0)
    return F.round(in_keywords * 3.0 + in_title * 2.0 + text + cites, 9)


def recommend(papers: DataFrame, queries: DataFrame, k: int = 5, fulltext: DataFrame | None = None, query_id: str = "query_id", terms: str = "terms") -> DataFrame:
    """The k best papers of every query (query_id, terms) with positive score: by score, citations, year, then key.

    Queries are few and meet all papers in one scan, as an array that is broadcast (up to 1,000 queries).
    fulltext: (query_id, key, score).
    """
    few = queries.where(F.size(terms) > 0).limit(1001)
    if few.count() > 1000:
        raise ValueError("more than 1,000 queries at once")
    packed = few.agg(F.collect_list(F.struct(query_id, terms)).alias("_q"))
    rows = papers.join(F.broadcast(packed)).select("*", F.inline("_q")).drop("_q")
    if fulltext is not None:
        rows = rows.join(fulltext.select(query_id, "key", F.col("score").alias("_ft")), [query_id, "key"], "left")
    else:
        rows = rows.withColumn("_ft", F.lit(None).cast("double"))
    rows = rows.withColumn("score", paper_score(F.col(terms), F.col("title"), F.col("keywords"), F.col("_ft"), F.col("cited_by"))).where("score > 0")
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col("cited_by").desc(), F.col("year").desc(), "key")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_ft", terms)


def database_summary(papers: DataFrame) -> DataFrame:
    """One row: total_papers, with_keywords, year_min, year_max (0 without years), total_citations."""
    year = F.when(F.col("year") > 0, F.col("year"))
    return papers.agg(
        F.count(F.lit(1)).alias("total_papers"), F.count_if(F.size("keywords") > 0).alias("with_keywords"), F.coalesce(F.min(year), F.lit(0)).alias("year_min"),
        F.coalesce(F.max(year), F.lit(0)).alias("year_max"), F.coalesce(F.sum("cited_by"), F.lit(0)).alias("total_citations"),
    )


def select_examples(examples: DataFrame, context: str, k: int = 2) -> DataFrame:
    """(…, score, rank): 2 for a keyword in the context, 1.5 for a domain phrase in it; equal scores in the order of ``ord``. A blank context takes the first ones."""
    low = F.lit(context.lower())
    hits = F.size(F.filter("keywords", lambda w: F.contains(low, F.lower(w))))
    domains = F.size(F.filter(F.split("domain", ", "), lambda d: F.contains(low, F.lower(d))))
    score = F.lit(0.0) if not context.strip() else hits * 2.0 + domains * 1.5
    top = examples.withColumn("score", score).orderBy(F.col("score").desc(), "ord").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "ord")))
