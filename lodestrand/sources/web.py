"""Search results from provider replies and result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.merge import first_per_key


def json_sources(replies: DataFrame, key: str, json_col: str, cap: int) -> DataFrame:
    """(key, ord, title, snippet, url): every object with a url at any depth, in the order of the text, each url once.

    The reply is walked by levels as a VARIANT: each level explodes the values of the one before. Eight
    levels are walked.
    """
    level = replies.select(key, F.try_parse_json(json_col).alias("v"), F.array().cast("array<int>").alias("at")).where("v is not null")
    found = None
    for _ in range(8):
        url = F.trim(F.try_variant_get("v", "$.url", "string"))
        grab = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names], F.lit(""))
        hit = level.where(F.schema_of_variant("v").startswith("OBJECT")).select(key, "at", F.trim(grab("title")).alias("title"), F.trim(grab("snippet", "excerpt", "description")).alias("snippet"), url.alias("url")).where("url <> ''")
        found = hit if found is None else found.unionByName(hit)
        deeper = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        level = _explode(deeper, key)
    ranked = first_per_key(found, [key], ["url"], ["at"], cap)
    return ranked.select(key, (F.col("rank") - 1).alias("ord"), "title", "snippet", "url")


def _explode(level: DataFrame, key: str) -> DataFrame:
    say = f"select t.`{key}`, e.value as v, concat(t.at, array(e.pos)) as at from {{level}} t, lateral variant_explode(t.v) e"
    return level.sparkSession.sql(say, level=level)


_CITED = "content array<struct<type:string,citations:array<struct<title:string,cited_text:string,url:string>>,content:array<struct<title:string,page_age:string,url:string>>>>"


def cited_sources(replies: DataFrame, key: str, json_col: str, cap: int) -> DataFrame:
    """(key, ord, title, snippet, url): citations of text blocks; only where a reply has none, the results of its search blocks with their age as snippet."""
    blocks = replies.select(key, F.from_json(json_col, _CITED).alias("o")).select(key, F.posexplode("o.content").alias("b", "x"))
    first = blocks.where("x.type = 'text'").select(key, "b", F.posexplode("x.citations").alias("i", "c")).select(key, "b", "i", F.trim("c.title").alias("title"), F.trim(F.coalesce("c.cited_text", F.lit(""))).alias("snippet"), F.trim("c.url").alias("url"))
    second = blocks.where("x.type <> 'text'").select(key, "b", F.posexplode("x.content").alias("i", "c"))
    age = F.when(F.coalesce("c.page_age", F.lit("")) != "", F.concat(F.lit("(page age: "), "c.page_age", F.lit(")"))).otherwise("")
    second = second.select(key, "b", "i", F.trim("c.title").alias("title"), age.alias("snippet"), F.trim("c.url").alias("url"))
    first, second = first.where("url <> ''"), second.where("url <> ''")
    rows = first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
    ranked = first_per_key(rows, [key], ["url"], ["b", "i"], cap)
    return ranked.select(key, (F.col("rank") - 1).alias("ord"), "title", "snippet", "url")


def grounding_sources(replies: DataFrame, key: str, json_col: str, cap: int) -> DataFrame:
    """(key, ord, title, snippet, url): web chunks of grounding metadata, or plain lists of citation urls; a missing title is the url."""
    schema = "grounding_chunks array<struct<web:struct<title:string,uri:string>>>, citations array<string>"
    o = replies.select(key, F.from_json(json_col, schema).alias("o"))
    rows = o.select(key, F.posexplode(F.concat(
        F.coalesce(F.transform("o.grounding_chunks", lambda c: F.struct(c["web"]["title"].alias("title"), c["web"]["uri"].alias("url"))), F.array().cast("array<struct<title:string,url:string>>")),
        F.coalesce(F.transform("o.citations", lambda u: F.struct(F.lit(None).cast("string").alias("title"), u.alias("url"))), F.array().cast("array<struct<title:string,url:string>>")),
    )).alias("i", "x")).select(key, "i", F.coalesce(F.nullif(F.trim("x.title"), F.lit("")), F.trim("x.url")).alias("title"), F.lit("").alias("snippet"), F.trim("x.url").alias("url")).where("url <> ''")
    return first_per_key(rows, [key], ["url"], ["i"], cap).select(key, (F.col("rank") - 1).alias("ord"), "title", "snippet", "url")


def html_results(pages: DataFrame, key: str, html_col: str) -> DataFrame:
    """(key, ord, title, snippet, url): links of class result-link with the snippet cell of the same number; redirects are followed in the url itself."""
    tags = lambda p, g: F.regexp_extract_all(html_col, F.lit(p), F.lit(g))
    link = r"(?is)<a\b(?=[^>]*class=['\"][^'\"]*result-link)[^>]*href=['\"]([^'\"]*)['\"][^>]*>(.*?)</a>"
    cell = r"(?is)<td\b[^>]*class=['\"][^'\"]*result-snippet[^'\"]*['\"][^>]*>(.*?)</td>"
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " "))
    rows = pages.select(key, F.posexplode(F.arrays_zip(tags(link, 1).alias("u"), tags(link, 2).alias("t"))).alias("ord", "x"), tags(cell, 1).alias("s"))
    return rows.select(key, "ord", plain(F.col("x.t")).alias("title"), plain(F.coalesce(F.get("s", F.col("ord")), F.lit(""))).alias("snippet"), redirect_target(F.replace("x.u", F.lit("&amp;"), F.lit("&"))).alias("url"))


def redirect_target(url: Column) -> Column:
    """The decoded ``uddg`` parameter of a redirect, else the url with a scheme."""
    target = F.regexp_extract(url, r"[?&]uddg=([^&#]*)", 1)
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(target != "", F.try_url_decode(target)).otherwise(full)


def links(pages: DataFrame, key: str, html_col: str) -> DataFrame:
    """(key, ord, href, text): every anchor of a page."""
    pattern = r"(?is)<a\b[^>]*?href=['\"]([^'\"]*)['\"][^>]*>(.*?)</a>"
    got = lambda g: F.regexp_extract_all(html_col, F.lit(pattern), F.lit(g))
    rows = pages.select(key, F.posexplode(F.arrays_zip(got(1).alias("h"), got(2).alias("t"))).alias("ord", "x"))
    return rows.select(key, "ord", F.col("x.h").alias("href"), F.trim(F.regexp_replace("x.t", "<[^>]+>", "")).alias("text"))
