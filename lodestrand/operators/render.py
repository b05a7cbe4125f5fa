"""Rows to text blocks: every block is an ordered string aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as T

RULE = "=" * 70


def ordered_text(rows: DataFrame, key: list[str], order: str, line: str, by: str = "\n") -> DataFrame:
    """(key, text): the lines of a key in order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), by)
    return rows.groupBy(*key).agg(whole.alias("text"))


def titled(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"{RULE}\n  {title}\n{RULE}\n\n"), body, F.lit(f"\n{RULE}"))


def evidence_block(ranked: DataFrame, key: str, anchor: str | None = None, backend: str = "tfidf") -> DataFrame:
    """(key, text): passages (rank, paper_title, authors, year, section, score, text) with confidence and excerpt."""
    about = F.col(anchor) if anchor else F.lit("")
    say = F.concat_ws(
        "\n", F.format_string("  [%d] %s", "rank", "paper_title"), F.format_string("      %s (%d)", T.short_authors(F.col("authors")), "year"),
        F.concat(F.lit("      Section: "), "section"), F.format_string("      Confidence: %s (score: %.3f)", T.confidence(F.col("score"), backend), "score"),
        F.lit("      ---"), F.concat(F.lit('      "'), T.excerpt(F.col("text"), about), F.lit('"\n')),
    )
    rows = ordered_text(ranked.withColumn("line", say), [key], "rank", "line")
    return rows.select(key, titled("SUPPORTING EVIDENCE FROM LITERATURE", F.col("text")).alias("text"))


def recommendations_block(ranked: DataFrame, key: str) -> DataFrame:
    """(key, text): recommended papers by rank."""
    say = F.concat_ws(
        "\n", F.format_string("  [%d] %s", "rank", "title"), F.format_string("      %s (%d)", T.short_authors(F.col("authors"), 80), "year"), F.concat(F.lit("      "), "journal"),
        F.when(F.col("doi") != "", F.concat(F.lit("      DOI: "), "doi")), F.when(F.col("cited_by") > 0, F.concat(F.lit("      Cited by: "), F.col("cited_by").cast("string"))), F.lit(""),
    )
    rows = ordered_text(ranked.withColumn("line", say), [key], "rank", "line")
    return rows.select(key, titled("RECOMMENDED LITERATURE", F.col("text")).alias("text"))


def references_block(refs: DataFrame, key: str, backend: str = "embeddings") -> DataFrame:
    """(key, text): cited papers (ref_no, title, authors, year, score, paper_key)."""
    say = F.concat_ws(
        "\n", F.format_string("\n  [%d] %s", "ref_no", "title"), F.format_string("      %s (%d)", T.short_authors(F.col("authors")), "year"),
        F.when(F.col("score").isNotNull(), F.format_string("      Confidence: %s (score: %.3f)", T.confidence(F.col("score"), backend), "score")), F.concat(F.lit("      key: "), "paper_key"),
    )
    rows = ordered_text(refs.withColumn("line", say), [key], "ref_no", "line")
    return rows.select(key, F.concat(F.lit(f"{RULE}\n  REFERENCES (cited in this answer)\n{RULE}\n"), "text").alias("text"))


def web_block(results: DataFrame, key: str) -> DataFrame:
    """(key, text): web sources (n, title, snippet, url), snippets cut to 140 characters."""
    snippet = F.trim(F.regexp_replace(F.coalesce("snippet", F.lit("")), "\n", " "))
    short = F.when(F.length(snippet) > 140, F.concat(F.rtrim(F.substring(snippet, 1, 137)), F.lit("..."))).otherwise(snippet)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("(no title)"))
    say = F.concat_ws("\n", F.format_string("\n  [w%d] %s", "n", title), F.when(F.trim("url") != "", F.concat(F.lit("       "), F.trim("url"))), F.when(short != "", F.concat(F.lit("       "), short)))
    rows = ordered_text(results.withColumn("line", say), [key], "n", "line")
    return rows.select(key, F.concat(F.lit(f"{RULE}\n  WEB SOURCES (background context, not used for citations)\n{RULE}\n"), "text").alias("text"))


def literature_xml(ranked: DataFrame, queries: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """(key, text): passages as XML for a prompt; a self-closing element where there are none."""
    line = F.format_string('  <passage id="%d" paper="%s" section="%s" score="%.2f">%s</passage>', "rank", T.xml_attribute(F.col("paper_key")), T.xml_attribute(F.col("section")), "score", T.xml_text(F.substring("text", 1, most)))
    body = ordered_text(ranked.withColumn("line", line), [key], "rank", "line")
    whole = F.when(F.col("text").isNull(), "<retrieved_literature/>").otherwise(F.concat(F.lit("<retrieved_literature>\n"), "text", F.lit("\n</retrieved_literature>")))
    return queries.select(key).join(body, key, "left").select(key, whole.alias("text"))


def layered_prompt(*layers: Column) -> Column:
    """Layers in order with blank lines between; nulls and blanks are left out."""
    return F.array_join(F.filter(F.array(*layers), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")


def user_message(question: Column, passages: Column, refine: bool = False) -> Column:
    """The passages before an initial question, behind a refinement."""
    return layered_prompt(question, passages) if refine else layered_prompt(passages, question)


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def record_block(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): a record in long form as a numbered report."""
    kinds = {"classification": 0, "systems": 1, "flows": 2, "agents": 3, "causes": 4, "effects": 5, "interactions": 6, "gaps": 7}
    place = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    couplings = F.array(*map(F.lit, ("intracoupling", "pericoupling", "telecoupling")))
    section = F.when(F.col("kind") == "classification", 1).when(F.col("coupling").isNotNull(), F.array_position(couplings, F.col("coupling")).cast("int") + 1).when(F.col("kind") == "interactions", 5).otherwise(6)
    field_no = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("role", "level", "category", "name", "direction", "description"))), F.col("field")), F.lit(0)), F.lit(9)).cast("int")
    rows = items.withColumn("section", section).withColumn("part", F.element_at(place, F.col("kind"))).withColumn("field_no", field_no)
    line = F.when(F.col("kind").isin("classification", "interactions", "gaps"), F.concat(F.lit("  - "), "value")).otherwise(F.concat(F.lit("    "), _title(F.col("field")), F.lit(": "), "value"))
    rows = rows.select(key, "section", "part", "ord", "field_no", line.alias("line"))
    names = ("Coupling Classification", "Intracoupling Analysis", "Pericoupling Analysis", "Telecoupling Analysis", "Cross-coupling Interactions", "Research Gaps and Suggestions")
    head = F.concat(F.col("section").cast("string"), F.lit(". "), F.element_at(F.array(*map(F.lit, names)), F.col("section")))
    parts = ("Systems Identification", "Flows Analysis", "Agents", "Causes", "Effects")
    sub = F.concat(F.lit("  "), F.col("section").cast("string"), F.lit("."), F.col("part").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, parts)), F.col("part")))
    heads = rows.select(key, "section").distinct().select(key, "section", F.lit(-1).alias("part"), F.lit(-1).alias("ord"), F.lit(-1).alias("field_no"), head.alias("line"))
    subs = rows.where("section between 2 and 4").select(key, "section", "part").distinct().select(key, "section", "part", F.lit(-1).alias("ord"), F.lit(-1).alias("field_no"), sub.alias("line"))
    every = rows.unionByName(heads).unionByName(subs).withColumn("at", F.struct("section", "part", "ord", "field_no", "line"))
    return ordered_text(every, [key], "at", "line")


def comparison(summaries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line): one line of counts for every record."""
    say = F.format_string("%s: %d systems, %d flows, %d agents, %d gaps", F.array_join("couplings", ", "), "n_systems", "n_flows", "n_agents", "n_gaps")
    return summaries.select(key, say.alias("line"))


def signals_block(systems: DataFrame, flows: DataFrame, focal: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): validated web signals: focal country, systems, flows."""
    some = lambda p: F.format_string(f"{p} %s (%s, %.2f) [%s]", "code", "kind", "confidence", F.array_join("evidence", ", "))
    rows = focal.select(key, F.lit(0).alias("a"), F.lit(0).alias("ord"), F.concat(F.lit("Focal country: "), "focal").alias("line"))
    rows = rows.unionByName(systems.select(key, F.when(F.col("role") == "receiving", 1).otherwise(2).alias("a"), "ord", F.when(F.col("role") == "receiving", some("- Receiving:")).otherwise(some("- Spillover:")).alias("line")))
    rows = rows.unionByName(flows.select(key, F.lit(3).alias("a"), "ord", F.format_string("- Flow: [%s] %s → %s (%s, %.2f) [%s]", "category", "source", "target", "kind", "confidence", F.array_join("evidence", ", ")).alias("line")))
    return ordered_text(rows.withColumn("at", F.struct("a", "ord", "line")), [key], "at", "line")


def supplement_block(mentions: DataFrame, flows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): additional places and flows with their passages."""
    cites = F.concat(F.lit("["), F.array_join("ids", "] ["), F.lit("]"))
    rows = mentions.select(key, F.concat(F.lit("0"), "role").alias("a"), "ord", F.concat(F.lit("- "), F.initcap("role"), F.lit(": "), "name", F.lit(" "), cites).alias("line"))
    rows = rows.unionByName(flows.select(key, F.lit("1").alias("a"), "ord", F.concat(F.lit("- ["), F.initcap("category"), F.lit("] "), "direction", F.lit(": "), "description", F.lit(" "), cites).alias("line")))
    return ordered_text(rows.withColumn("at", F.struct("a", "ord", "line")), [key], "at", "line")


def adjacency_hint(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): pair lines (name_a, name_b, pair_type) for a prompt."""
    line = F.concat(F.lit("- "), "name_a", F.lit(" and "), "name_b", F.lit(": "), "pair_type")
    return ordered_text(pairs.withColumn("line", line), [key], "line", "line")


def map_notice(reason: Column) -> Column:
    """What is said instead of a map."""
    return (
        F.when(reason == "unsupported_scope", "A map was not drawn: the study is about places below the regions that can be mapped.")
        .when(reason == "no_focal", "A map was not drawn: no focal country was found.")
        .when(reason == "no_boundaries", "A map was not drawn: the boundary data are missing.")
        .when(reason.isNotNull(), F.concat(F.lit("A map was not drawn: "), reason))
    )


def map_plan(unsupported: Column, structured: Column, region: Column, country: Column) -> Column:
    """Which map is drawn: notice, structured_region, structured_country, region, country or none."""
    return (
        F.when(unsupported, "notice").when(structured & region.isNotNull(), "structured_region").when(structured & country.isNotNull(), "structured_country")
        .when(region.isNotNull(), "region").when(country.isNotNull(), "country").otherwise("none")
    )
