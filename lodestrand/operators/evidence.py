"""Citations for the lines of a text, from shared words.

Lines and passages meet by a join on their words, never as all pairs; overlap counts come from the
join, and thresholds are applied to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import lexicon as L
from lodestrand.functions import text as T

# Headings of a report, those whose lines get no citation, and where a report's own evidence begins.
HEADINGS = ("COUPLING CLASSIFICATION", "SYSTEMS IDENTIFICATION", "FLOWS ANALYSIS", "AGENTS", "CAUSES", "EFFECTS", "RESEARCH GAPS")
SKIPPED = (*HEADINGS, "PERICOUPLING DATABASE", "METACOUPLING FRAMEWORK", "SUPPORTING EVIDENCE", "RECOMMENDED LITERATURE", "Note:")
STRICT = ("CAUSES", "EFFECTS", "RESEARCH GAPS")


def _starts(text: Column, words: tuple[str, ...]) -> Column:
    return T.any_of(text.startswith(w) for w in words)


def lines_of(reports: DataFrame, key: str, text_col: str, stops: tuple[str, ...]) -> DataFrame:
    """(key, line_no, line, section, open): lines in order with the last heading; ``open`` is false for lines that are never annotated."""
    rows = reports.select(key, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("_s", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    heading = F.coalesce(*[F.when(F.col("_s").startswith(h), F.lit(h)) for h in HEADINGS])
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.max(T.any_of(F.contains(F.col("_s"), F.lit(x)) for x in stops)).over(so_far)
    plain = (F.col("_s") != "") & ~_starts(F.col("_s"), (*SKIPPED, *(("WEB SOURCES",) if "WEB SOURCES" in stops else ())))
    plain &= ~F.col("_s").rlike(r"^[=\- ]+$") & ~(F.col("_s").startswith("[") & F.col("_s").endswith("]"))
    plain &= ~(F.col("_s").endswith(":") & (F.size(F.split("_s", r"\s+")) <= 3))
    return rows.select(key, "line_no", "line", F.col("_s").alias("stripped"), F.coalesce(F.last(heading, True).over(so_far), F.lit("")).alias("section"), (plain & ~stopped).alias("open"))


def _appended(lines: DataFrame, cites: DataFrame, key: str, mark: str, existing: Column) -> DataFrame:
    """One row a report: its lines with new marks at their ends, and how many were added."""
    found = cites.groupBy(key, "line_no").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    rows = lines.join(found, [key, "line_no"], "left")
    new = F.array_except(F.coalesce("ns", F.array().cast("array<int>")), existing)
    tail = F.array_join(F.transform(new, lambda n: F.concat(F.lit(f" [{mark}"), n.cast("string"), F.lit("]"))), "")
    rows = rows.select(key, "line_no", F.concat("line", tail).alias("line"), F.size(new).alias("added"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key).agg(whole.alias("text"), F.sum("added").alias("added"))


def line_citations(lines: DataFrame, passages: DataFrame, key: str, min_overlap: int = 3, min_ratio: float = 0.20) -> DataFrame:
    """(key, line_no, n): passages that support a line, at most 2 or 3.

    passages: (key, n, text, score). A line needs ``min_overlap`` shared words and ``min_ratio`` of its specific
    words shared; sections on causes, effects and gaps need 4 words, 0.35 and two specific words. Of more, those
    with most specific words, ratio, words and score win, then the larger number.
    """
    strict = F.col("section").isin(*STRICT)
    words = lines.where("open").select(key, "line_no", "section", T.tokens(F.col("stripped")).alias("w")).withColumn("w", F.array_distinct("w")).where(F.size("w") >= 3)
    words = words.withColumn("base", F.size(T.specific(F.col("w"))))
    own = words.select(key, "line_no", "section", "base", F.size("w").alias("size"), F.explode("w").alias("word"))
    theirs = passages.select(key, "n", "score", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    is_specific = (~F.col("word").isin(*L.GENERIC_TOKENS)).cast("int")
    met = own.join(theirs, [key, "word"]).groupBy(key, "line_no", "section", "base", "size", "n", "score").agg(F.count(F.lit(1)).alias("shared"), F.sum(is_specific).alias("specific"))
    ratio = F.when(F.col("base") > 0, F.col("specific") / F.col("base")).otherwise(F.col("shared") / F.col("size"))
    met = met.withColumn("ratio", ratio).where(
        (F.col("shared") >= F.when(strict, max(4, min_overlap)).otherwise(max(3, min_overlap)))
        & (F.col("ratio") >= F.when(strict, max(0.35, min_ratio)).otherwise(max(0.20, min_ratio)))
        & ((F.col("base") == 0) | (F.col("specific") >= F.when(strict, 2).otherwise(1)))
    )
    best = Window.partitionBy(key, "line_no").orderBy(*[F.col(c).desc() for c in ("specific", "ratio", "shared", "score", "n")])
    return met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.when(strict, 2).otherwise(3)).select(key, "line_no", F.col("n").cast("int").alias("n"))


def annotate(reports: DataFrame, passages: DataFrame, key: str, text_col: str = "text", **limits) -> DataFrame:
    """(key, text, added): every report with citations [N] behind the lines that passages support."""
    lines = lines_of(reports, key, text_col, ("SUPPORTING EVIDENCE FROM LITERATURE",))
    have = F.transform(T.all_matches(F.col("line"), r"\[(\d+)\]", 1), lambda x: x.try_cast("int"))
    return _appended(lines, line_citations(lines, passages, key, **limits), key, "", have)


def annotate_web(reports: DataFrame, snippets: DataFrame, key: str, text_col: str = "text", min_overlap: int = 3, min_ratio: float = 0.25) -> DataFrame:
    """As :func:`annotate` with marks [WN] for all snippets (key, n, title, snippet) that share enough words."""
    lines = lines_of(reports, key, text_col, ("SUPPORTING EVIDENCE FROM LITERATURE", "WEB SOURCES"))
    words = lines.where("open").select(key, "line_no", T.web_tokens(F.col("stripped")).alias("w")).where(F.size("w") >= 3)
    own = words.select(key, "line_no", F.size("w").alias("size"), F.explode("w").alias("word"))
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    theirs = snippets.select(key, "n", F.explode(T.web_tokens(both)).alias("word"))
    met = own.join(theirs, [key, "word"]).groupBy(key, "line_no", "size", "n").agg(F.count(F.lit(1)).alias("shared"))
    cites = met.where((F.col("shared") >= min_overlap) & (F.col("shared") / F.col("size") >= min_ratio)).select(key, "line_no", F.col("n").cast("int").alias("n"))
    have = F.transform(T.all_matches(F.col("line"), r"\[W(\d+)\]", 1), lambda x: x.try_cast("int"))
    return _appended(lines, cites, key, "W", have)


def cited_references(answers: DataFrame, passages: DataFrame, key: str, text_col: str = "text", paper: str = "paper_key") -> DataFrame:
    """(key, ref_no, paper, score): papers of the passages an answer cites, by first citation, with the best score of all their passages."""
    from lodestrand.functions.citations import cited_ids

    cited = answers.select(key, F.posexplode(cited_ids(F.col(text_col))).alias("at", "n"))
    of = cited.join(passages.select(key, F.col("n").cast("bigint").alias("n"), paper), [key, "n"]).groupBy(key, paper).agg(F.min("at").alias("at"))
    best = passages.groupBy(key, paper).agg(F.max("score").alias("score"))
    ref = F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("ref_no")
    return of.join(best, [key, paper]).select(key, ref, paper, "score")
