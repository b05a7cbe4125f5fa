"""Audits and reports over tables of papers, files and licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import text as T


def matched(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return rows.join(links, key, "left_semi")


def unmatched(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return rows.join(links, key, "left_anti")


def duplicate_keys(rows: DataFrame, key: Column, item: str) -> DataFrame:
    """(key, n, items): keys, blank ones left out, that several rows have, with up to five of these."""
    keyed = rows.select(key.alias("_key"), F.col(item).alias("_item")).where("_key <> ''")
    at = F.row_number().over(Window.partitionBy("_key").orderBy("_item"))
    counted = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = keyed.withColumn("_r", at).where("_r <= 5").groupBy("_key").agg(F.array_sort(F.collect_list("_item")).alias("items"))
    return counted.join(few, "_key").withColumnRenamed("_key", "key")


def duplicate_members(rows: DataFrame, key: Column, item: str) -> DataFrame:
    """(key, n, item): every row whose key, not a blank one, several rows have, with their number."""
    keyed = rows.select(key.alias("key"), F.col(item)).where("key <> ''")
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(counted, "key").select("key", "n", item)


def outcomes(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def inventory(rows: DataFrame, by: str, item: str, samples: int = 5) -> DataFrame:
    """(by, n, samples), most frequent first, then by name: a count and the first items of each value."""
    value = F.coalesce(F.nullif(F.trim(F.col(by).cast("string")), F.lit("")), F.lit("(none)"))
    named = rows.select(value.alias(by), item)
    at = F.row_number().over(Window.partitionBy(by).orderBy(item))
    few = named.withColumn("_r", at).where(F.col("_r") <= samples).groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("samples"))
    return named.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(few, by).orderBy(F.desc("n"), by)


def licence_audit(decisions: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """(issue, n): papers to ship without a cached record, with another licence there, not as published version, and by class of licence."""
    rows = decisions.join(cache.select(key, F.lower("license").alias("_l"), F.lower("version").alias("_v")), key, "left").where(F.lower("ship") == "yes")
    lic = F.lower("license")
    group = F.when(lic.isin(*T.PERMISSIVE), "strict").when(F.contains(lic, F.lit("-nc")), "noncommercial").otherwise("other")
    issues = F.array_compact(F.array(
        F.when(F.col("_l").isNull() & F.col("_v").isNull(), "missing cache"), F.when(F.col("_l") != lic, "license mismatch"),
        F.when(F.col("_v").isNotNull() & (F.col("_v") != "publishedversion"), "not published version"), F.concat(F.lit("class "), group),
    ))
    return rows.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def best_source(files: DataFrame, cached: DataFrame, bib: DataFrame, scanned: DataFrame, file: str = "file_name") -> DataFrame:
    """(file, doi, doi_source): from the cache, else the bibliography, else a scan, else not_found."""
    pick = lambda d, n: d.select(file, F.nullif(F.trim("doi"), F.lit("")).alias(n))
    rows = files.select(file).join(pick(cached, "c"), file, "left").join(pick(bib, "b"), file, "left").join(pick(scanned, "s"), file, "left")
    source = F.when(F.col("c").isNotNull(), "cache").when(F.col("b").isNotNull(), "bib").when(F.col("s").isNotNull(), "pdf_scan").otherwise("not_found")
    return rows.select(file, F.coalesce("c", "b", "s").alias("doi"), source.alias("doi_source"))


def patch(rows: DataFrame, patches: DataFrame, name: str = "file_name", value: str = "doi", head: int = 60) -> DataFrame:
    """Adds ``patched`` and the new value: a patch of the same base name, else the only one whose first ``head`` characters of the file key are the same."""
    base = lambda c: F.regexp_extract(F.col(c), r"([^/\\]+)$", 1)
    short = lambda c: F.substring(T.file_key(base(c)), 1, head)
    p = patches.select(base(name).alias("_b"), short(name).alias("_h"), F.col(value).alias("_v"))
    exact = p.groupBy("_b").agg(F.max("_v").alias("_e"))
    near = p.groupBy("_h").agg(F.max("_v").alias("_n"), F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    out = rows.withColumn("_b", base(name)).withColumn("_h", short(name)).join(exact, "_b", "left").join(near, "_h", "left")
    return out.withColumn("patched", F.col("_e").isNotNull() | F.col("_n").isNotNull()).withColumn(value, F.coalesce("_e", "_n", value)).drop("_b", "_h", "_e", "_n")


def keyword_diff(ours: Column, theirs: Column) -> Column:
    """struct(missing, extra, coverage): sets compared; coverage is the share of ``theirs`` that is in ``ours``, 1 if there are none."""
    share = F.when(F.size(theirs) > 0, F.size(F.array_intersect(ours, theirs)) / F.size(theirs)).otherwise(1.0)
    return F.struct(F.array_sort(F.array_except(theirs, ours)).alias("missing"), F.array_sort(F.array_except(ours, theirs)).alias("extra"), F.round(share, 6).alias("coverage"))


def coverage_issues(papers: DataFrame, wanted: DataFrame, files: DataFrame, key: str = "key", least: float = 0.8) -> DataFrame:
    """(key, issue): each paper once: not_in_bib, no_file, no_keywords, keywords_lost, partial, ok, in this order of precedence."""
    rows = wanted.select(key, F.col("keywords").alias("w")).join(papers.select(key, F.col("keywords").alias("k")), key, "full")
    rows = rows.join(files.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    shared = F.size(F.array_intersect("k", "w"))
    issue = (
        F.when(F.col("k").isNull(), "not_in_bib").when(F.col("_f").isNull(), "no_file").when(F.col("w").isNull(), "not_requested").when(F.size("k") == 0, "no_keywords")
        .when(F.size("w") == 0, "ok").when(shared == 0, "keywords_lost").when(shared / F.size("w") < least, "partial").otherwise("ok")
    )
    return rows.select(key, issue.alias("issue"))


def apply_directives(papers: DataFrame, directives: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``outcome`` and the new ``keywords`` text: NA or blank deletes, else replaces or inserts; no directive, or the same text, is a noop."""
    d = directives.groupBy(key).agg(F.max_by("keywords", "ord").alias("_new")).withColumn("_d", F.lit(True))
    drop = F.upper(F.trim(F.coalesce("_new", F.lit("")))).isin("", "NA")
    had = F.coalesce(F.trim("keywords"), F.lit("")) != ""
    outcome = F.when(F.col("_d").isNull() | (drop & ~had) | (F.col("keywords") == F.col("_new")), "noop").when(drop, "deleted").when(had, "replaced").otherwise("inserted")
    new = F.when(F.col("_d").isNull(), F.col("keywords")).when(drop, None).otherwise(F.col("_new"))
    return papers.join(d, key, "left").withColumn("outcome", outcome).withColumn("keywords", new).drop("_new", "_d")


def unused_directives(papers: DataFrame, directives: DataFrame, key: str = "key") -> DataFrame:
    return directives.join(papers, key, "left_anti")


def recovery_flags(entries: DataFrame, deleted: DataFrame, replaced: DataFrame, candidates: DataFrame, taken: DataFrame, key: str = "key") -> DataFrame:
    """(key, flag): entries that were neither deleted nor replaced: empty without a strong candidate, COLLISION if its row is taken by another entry, else RECOVERABLE."""
    kept = entries.select(key).join(deleted, key, "left_anti").join(replaced, key, "left_anti")
    best = candidates.where("rank = 1 and (surname_hit and overlap >= 0.5)").select(key, "file_name")
    rows = kept.join(best, key, "left").join(taken.select("file_name", F.col(key).alias("_by")), "file_name", "left")
    flag = F.when(F.col("file_name").isNull(), "empty").when(F.col("_by").isNotNull() & (F.col("_by") != F.col(key)), "COLLISION").otherwise("RECOVERABLE")
    return rows.groupBy(key).agg(F.max(flag).alias("flag"))


def ship_report(decisions: DataFrame) -> DataFrame:
    """Rows in the order of a report: to ship first, then by file name without case."""
    return decisions.orderBy((F.col("ship") != "Yes").cast("int"), F.lower("file_name"))


def ship_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("category", "ship").agg(F.count(F.lit(1)).alias("n"))


def metadata_table(papers: DataFrame, markdown: DataFrame, key: str = "key") -> DataFrame:
    """Every paper with the abstract of its first markdown file and where it comes from: extracted, not_found or no_markdown."""
    first = markdown.groupBy(key).agg(F.min_by(F.struct("file_name", "abstract"), "file_name").alias("m"))
    rows = papers.join(first, key, "left")
    status = F.when(F.col("m").isNull(), "no_markdown").when(F.coalesce(F.trim("m.abstract"), F.lit("")) == "", "not_found").otherwise("extracted")
    return rows.withColumn("abstract_status", status).withColumn("abstract", F.col("m.abstract")).drop("m")


def oa_report(papers: DataFrame, responses: DataFrame, previous: DataFrame, key: str = "key") -> DataFrame:
    """(category, key, doi, redistribution, change): a class from the responses, and how it differs from the previous label."""
    rows = papers.join(responses.select("doi", "ok", "oa_status", "license", "version"), "doi", "left").join(previous.select(key, F.col("redistribution").alias("_old")), key, "left")
    rows = rows.withColumn("redistribution", T.redistribution_class(F.col("ok"), F.col("oa_status"), F.col("license"), F.col("version")))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("redistribution"), F.concat("_old", F.lit(" -> "), "redistribution")).otherwise("")
    return rows.select("category", key, "doi", "redistribution", change.alias("change")).orderBy("category", key)


def page(rows: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    return rows.orderBy(*order).offset(start).limit(count)


def title_overlap(a: Column, b: Column) -> Column:
    """Share of the second text's words of four letters or more that the first has; 0 without any."""
    words = lambda c: F.array_distinct(F.filter(F.split(T.match_form(c), " "), lambda w: F.length(w) >= 4))
    return F.when(F.size(words(b)) > 0, F.round(F.size(F.array_intersect(words(a), words(b))) / F.size(words(b)), 6)).otherwise(0.0)
