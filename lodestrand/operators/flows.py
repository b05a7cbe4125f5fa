"""Directed flows between places, resolved from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import lexicon as L
from lodestrand.functions import text as T
from lodestrand.operators import gazetteer as G
from lodestrand.sources.scratch import cut

ARROW = r"\s*(?:↔|<->|<=>|→|->|=>)\s*"


def ends(flows: DataFrame) -> DataFrame:
    """Adds ``source_text``, ``target_text`` and ``both_ways``; flows without direction, or that stay within a place, are dropped."""
    d = F.col("direction")
    between = r"(?i)between\s+(.+?)\s+and\s+(.+)"
    parts = F.split(d, ARROW)
    linked = d.rlike(ARROW)
    rows = flows.where(d.isNotNull() & (d != "") & ~(~linked & ~d.rlike(between) & d.rlike(r"(?i)\bwithin\b")))
    pick = lambda i: F.when(d.rlike(between), F.regexp_extract(d, between, i + 1)).when(F.size(parts) >= 2, F.get(parts, F.lit(i)))
    strip = lambda c: F.trim(F.regexp_replace(c, r"(?i)^\s*bidirectional\s*\(?|\)\s*$", ""))
    return rows.select("*", strip(pick(0)).alias("source_text"), strip(pick(1)).alias("target_text"), (d.rlike("(?i)bidirectional|↔|<->|<=>") | d.rlike(between)).alias("both_ways"))


def is_certain_list(text: Column, soft: bool = False) -> Column:
    """Whether wording is firm enough to take countries from a list; ``soft`` allows likely ones."""
    low = F.lower(text)
    hard = T.any_of(F.contains(low, F.lit(x)) for x in L.HARD_HEDGES)
    return ~hard if soft else ~hard & ~T.any_of(F.contains(low, F.lit(x)) for x in L.SOFT_HEDGES)


def listed_codes(texts: DataFrame, key: list[str], text_col: str, gazetteer: DataFrame, soft: bool = False) -> DataFrame:
    """(key, code): countries of a list such as ``Mexico, China and Japan``.

    None if the wording is uncertain, or if more than one word is left beside the countries and words
    that often stand in such lists.
    """
    clean = F.trim(F.regexp_replace(text_col, r"\[[^\]]+\]", ""))
    rows = texts.select(*key, clean.alias("_t")).where(F.col("_t").isNotNull() & (F.col("_t") != "") & is_certain_list(F.col("_t"), soft))
    parts = F.transform(F.split("_t", r"[,;/]+|\band\b|\bor\b"), lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\([^)]*\)", "")), "[.:]+$", ""))
    pieces = rows.select(*key, F.posexplode(parts).alias("_n", "_p")).where("_p <> ''")
    found = G.resolve(pieces, [*key, "_n"], "_p", gazetteer).where("code is not null").join(pieces, [*key, "_n"])
    per = found.groupBy(*key).agg(F.collect_set("code").alias("_codes"), F.collect_set(F.lower("_p")).alias("_used"))
    per = rows.join(per, key)
    rest = F.aggregate("_used", F.lower("_t"), lambda acc, p: F.replace(acc, p, F.lit(" ")))
    rest = F.regexp_replace(F.regexp_replace(rest, r"\([^)]*\)", " "), rf"\b(?:{L.LIST_WORDS})\b", " ")
    left = F.filter(F.split(rest, "[^a-z]+"), lambda w: F.length(w) > 2)
    return per.where(F.size(left) <= 1).select(*key, F.explode("_codes").alias("code"))


def role_codes(systems: DataFrame, key: str, gazetteer: DataFrame) -> DataFrame:
    """(key, role, code) of the countries that systems (key, role, name, geographic_scope, system_scope) name.

    Focal countries also count as sending, those with an adjacent scope also as adjacent; likely markets
    of receiving systems count as receiving.
    """
    texts = systems.select(key, "role", "system_scope", F.explode(F.array("name", "geographic_scope")).alias("t")).where("t <> ''").distinct()
    firm = _listed(texts, key, gazetteer, False)
    market = T.any_of(F.contains(F.lower(F.col("t")), F.lit(w)) for w in L.MARKET_WORDS)
    likely = _listed(texts.where((F.col("role") == "receiving") & market), key, gazetteer, True)
    rows = firm.unionByName(likely)
    more = rows.where("system_scope = 'adjacent'").withColumn("role", F.lit("adjacent")).unionByName(rows.where("role = 'focal'").withColumn("role", F.lit("sending")))
    return rows.unionByName(more).select(key, "role", "code").distinct()


def _listed(texts: DataFrame, key: str, gazetteer: DataFrame, soft: bool) -> DataFrame:
    rows = texts.withColumn("system_scope", F.coalesce("system_scope", F.lit("")))
    return listed_codes(rows, [key, "role", "system_scope", "t"], "t", gazetteer, soft).select(key, "role", "system_scope", "code")


def resolve_flows(flows: DataFrame, systems: DataFrame, focal: DataFrame, gazetteer: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, category, source, target, both_ways, description): flows between countries, each (category, source, target) once.

    flows: (key, ord, category, direction, description); focal: (key, focal). An end is a certain list of
    countries, else a country in the text, else the countries of the role it refers to. A target that isn't
    found is the receiving countries; a source that isn't found is the receiving countries where the
    target is the focal one, else the focal one.
    """
    rows = cut(ends(flows).join(focal, key))  # read by every way of resolving an end
    roles = cut(role_codes(systems, key, gazetteer))
    receiving = roles.where("role = 'receiving'").select(key, "code")
    sides = {}
    for side in ("source", "target"):
        t = f"{side}_text"
        texts = rows.where(F.coalesce(F.col(t), F.lit("")) != "").select(key, "ord", t)
        listed = listed_codes(texts, [key, "ord"], t, gazetteer).withColumn("_p", F.lit(0))
        plain = G.resolve(texts.withColumn(t, F.regexp_replace(t, r"\([^)]*\)", "")), [key, "ord"], t, gazetteer).where("code is not null").withColumn("_p", F.lit(1))
        refer = F.array(*[F.when(T.any_of(F.contains(F.lower(F.col(t)), F.lit(w)) for w in words.split("|")), F.lit(role)) for role, words in L.ROLE_REFERENCES])
        by_role = texts.select(key, "ord", F.explode(F.array_compact(refer)).alias("role")).join(roles, [key, "role"]).select(key, "ord", "code").withColumn("_p", F.lit(2))
        every = listed.unionByName(plain).unionByName(by_role)
        every = cut(every)
        best = every.groupBy(key, "ord").agg(F.min("_p").alias("_m"))
        sides[side] = every.join(best, [key, "ord"]).where("_p = _m").groupBy(key, "ord").agg(F.array_sort(F.collect_set("code")).alias(side))
    got = receiving.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("_receiving"))
    rows = rows.join(sides["source"], [key, "ord"], "left").join(sides["target"], [key, "ord"], "left").join(got, key, "left")
    empty = F.array().cast("array<string>")
    some = F.coalesce("_receiving", empty)
    rows = rows.withColumn("target", F.coalesce("target", F.when(F.size(some) > 0, some)))
    partners = F.array_except(some, F.coalesce("target", empty))
    inbound = F.coalesce(F.array_contains("target", F.col("focal")), F.lit(False)) & (F.size(partners) > 0)
    rows = rows.withColumn("source", F.coalesce("source", F.when(inbound, partners).otherwise(F.array("focal")))).where("target is not null")
    others = F.array_except(some, F.col("source"))
    rows = rows.withColumn("target", F.when((F.col("source") == F.col("target")) & (F.size(others) > 0), others).otherwise(F.col("target")))
    pairs = rows.withColumn("source", F.explode("source")).withColumn("target", F.explode("target")).where("source <> target")
    first = F.row_number().over(Window.partitionBy(key, "category", "source", "target").orderBy("ord"))
    return pairs.withColumn("_r", first).where("_r = 1").select(key, "ord", "category", "source", "target", "both_ways", "description")


def direction_label(source_name: Column, target_name: Column, both_ways: Column) -> Column:
    return F.when(both_ways, F.concat(F.lit("Bidirectional ("), source_name, F.lit(" ↔ "), target_name, F.lit(")"))).otherwise(F.concat(source_name, F.lit(" → "), target_name))


def slots(flows: DataFrame, order: list[str], source: str = "source", target: str = "target", per: list[str] | None = None) -> DataFrame:
    """Adds ``slot``, the number of earlier arrows between the same two ends, and the arrow's curvature ``rad``."""
    pair = [F.least(source, target), F.greatest(source, target)]
    slot = F.row_number().over(Window.partitionBy(*(per or []), *pair).orderBy(*order)) - 1
    sign = F.when(F.col(source) <= F.col(target), 1).otherwise(-1)
    return flows.withColumn("slot", slot).withColumn("rad", F.round(sign * (0.15 + 0.1 * F.col("slot")), 6))


def filter_ends(flows: DataFrame, mentioned: DataFrame, senders: DataFrame) -> DataFrame:
    """Flows whose target is mentioned and whose source may send (tables of ``code``); an end that is null passes."""
    t, s = mentioned.select(F.col("code").alias("target")).distinct().withColumn("_t", F.lit(True)), senders.select(F.col("code").alias("source")).distinct().withColumn("_s", F.lit(True))
    rows = flows.join(t, "target", "left").join(s, "source", "left")
    return rows.where("(target is null or _t) and (source is null or _s)").select(*flows.columns)


def arrow_layer(flows: DataFrame, points: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Adds coordinates (x0, y0, x1, y1) from ``points(code, x, y)``; flows with an unplaced end are dropped."""
    at = lambda end, i: points.select(F.col("code").alias(end), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    return flows.join(at(source, 0), source).join(at(target, 1), target)


def region_flows(flows: DataFrame, focal: str, domestic: DataFrame) -> DataFrame:
    """(ord, category, source, target): flows between a focal region and the domestic neighbours (region, name) that a direction or description names."""
    said = F.lower(F.concat_ws(" ", "direction", "description"))
    rows = flows.select("ord", "category", "direction", said.alias("_t"))
    words = rows.withColumn("_w", F.explode(F.array_distinct(T.all_matches(F.col("_t"), "[a-z]+"))))
    near = domestic.select("region", F.lower("name").alias("_name")).withColumn("_w", F.regexp_extract("_name", "[a-z]+", 0))
    hit = words.join(near, "_w").where(G.contains_term(F.col("_t"), F.col("_name"), "a-z")).select("ord", "category", "direction", "region", "_name").distinct()
    arrow = F.split("direction", ARROW)
    out = F.contains(F.lower(F.coalesce(F.get(arrow, F.lit(0)), F.lit(""))), F.col("_name"))
    return hit.select("ord", "category", F.when(out, F.col("region")).otherwise(F.lit(focal)).alias("source"), F.when(out, F.lit(focal)).otherwise(F.col("region")).alias("target")).distinct()


def substitute_focal(flows: DataFrame, focal_code: str, focal_region: str) -> DataFrame:
    """Ends at the focal country moved to the focal region."""
    swap = lambda c: F.when(F.col(c) == focal_code, focal_region).otherwise(F.col(c))
    return flows.withColumn("source", swap("source")).withColumn("target", swap("target"))
