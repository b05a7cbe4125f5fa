"""Replies that hold JSON, validated into relations, flows and supplements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import text as T
from lodestrand.operators import gazetteer as G
from lodestrand.sources.scratch import cut

# Categories that web flows may have, the six of a supplement, and older names.
WEB_CATEGORIES = ("matter", "material", "capital", "financial", "information", "energy", "people", "organisms")
CATEGORIES = ("matter", "capital", "information", "energy", "people", "organisms")
OLD_NAMES = {"material": "matter", "financial": "capital"}

_COUNTRY = "country string, kind string, confidence string, evidence array<string>, reason string"
_FLOW = "category string, source_country string, target_country string, kind string, confidence string, evidence array<string>, description string"
WEB_SCHEMA = f"focal_country string, receiving_systems array<struct<{_COUNTRY.replace(' ', ':').replace(',:', ',')}>>, spillover_systems array<struct<{_COUNTRY.replace(' ', ':').replace(',:', ',')}>>, flows array<struct<{_FLOW.replace(' ', ':').replace(',:', ',')}>>"
_MENTION = "array<struct<name:string,evidence_passage_ids:array<string>>>"
_FILL = "struct<human_subsystem:string,natural_subsystem:string,geographic_scope:string,evidence_passage_ids:array<string>>"
SUPPLEMENT_SCHEMA = ", ".join(
    [f"additional_{r}_mentions {_MENTION}" for r in ("sending", "receiving", "spillover")] + [f"{r}_subsystem_fills {_FILL}" for r in ("sending", "receiving", "spillover")]
    + ["supplementary_flows array<struct<category:string,direction:string,description:string,evidence_passage_ids:array<string>>>"]
)


def _first(rows: DataFrame, per: list[str], distinct: list[str], cap: int) -> DataFrame:
    """In the order of ``ord``: the first of each ``distinct``, at most ``cap`` for each ``per``; ``ord`` is counted anew."""
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*per, *distinct).orderBy("ord"))).where("_r = 1")
    at = F.row_number().over(Window.partitionBy(*per).orderBy("ord")) - 1
    return rows.withColumn("ord", at).where(F.col("ord") < cap).drop("_r")


def _kind(c: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(c, F.lit("direct"))))
    return F.when(k.isin("direct", "proxy"), k).otherwise("direct")


def web_signals(replies: DataFrame, snippets: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text_col: str = "text", min_confidence: float = 0.7, max_targets: int = 6) -> dict[str, DataFrame]:
    """Tables ``systems(key, role, ord, code, kind, confidence, evidence, reason)``, ``flows(key, ord, category, source, target, kind, confidence, evidence, description)`` and ``focal(key, focal)``.

    Kept: places that resolve, confidence of ``min_confidence`` or more, at least one known snippet
    (key, n) as evidence; a country once a role, a (category, source, target) once. A focal country that
    isn't given is the first flow's source if there are receiving countries.
    """
    known = snippets.groupBy(key).agg(F.collect_set(F.concat(F.lit("W"), F.col("n").cast("string"))).alias("_known"))
    none = F.array().cast("array<string>")
    obj = F.from_json(T.json_object(F.col(text_col)), WEB_SCHEMA)
    rows = cut(replies.select(key, obj.alias("o")).where("o is not null").join(known, key, "left").withColumn("_known", F.coalesce("_known", none)))
    parts = [rows.select(key, "_known", F.lit(r).alias("role"), F.posexplode(f"o.{r}_systems").alias("ord", "x")) for r in ("receiving", "spillover")]
    said = parts[0].unionByName(parts[1]).select(key, "role", "ord", "_known", "x.*")
    codes = G.resolve(said, [key, "role", "ord"], "country", gazetteer).where("code is not null")
    evidence = T.evidence_ids(F.coalesce("evidence", none), F.col("_known"))
    good = said.withColumn("evidence", evidence).withColumn("confidence", T.clamp(F.col("confidence"))).where((F.size("evidence") > 0) & (F.col("confidence") >= min_confidence))
    systems = good.join(codes, [key, "role", "ord"]).select(key, "role", "ord", "code", _kind(F.col("kind")).alias("kind"), "confidence", "evidence", F.trim(F.coalesce("reason", F.lit(""))).alias("reason"))
    systems = _first(systems, [key, "role"], ["code"], max_targets)

    flows = rows.select(key, "_known", F.posexplode("o.flows").alias("ord", "x")).select(key, "ord", "_known", "x.*")
    end = lambda c, name: G.resolve(flows, [key, "ord"], c, gazetteer).where("code is not null").withColumnRenamed("code", name)
    category = F.lower(F.trim("category"))
    good = flows.withColumn("evidence", evidence).withColumn("confidence", T.clamp(F.col("confidence"))).withColumn("category", category)
    good = good.where((F.size("evidence") > 0) & (F.col("confidence") >= min_confidence) & F.col("category").isin(*WEB_CATEGORIES))
    good = good.join(end("source_country", "source"), [key, "ord"]).join(end("target_country", "target"), [key, "ord"]).where("source <> target")
    flow_rows = good.select(key, "ord", "category", "source", "target", _kind(F.col("kind")).alias("kind"), "confidence", "evidence", F.trim(F.coalesce("description", F.lit(""))).alias("description"))
    flow_rows = _first(flow_rows, [key], ["category", "source", "target"], max_targets + 2)

    given = G.resolve(rows.select(key, F.col("o.focal_country").alias("c")), [key], "c", gazetteer).withColumnRenamed("code", "given")
    guess = flow_rows.where("ord = 0").join(systems.where("role = 'receiving'").select(key).distinct(), key, "left_semi").select(key, F.col("source").alias("guess"))
    focal = given.join(guess, key, "left").select(key, F.coalesce("given", "guess").alias("focal")).where("focal is not null")
    return {"systems": systems, "flows": flow_rows, "focal": focal}


def map_data(focal: DataFrame, systems: DataFrame, flows: DataFrame, regions: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, focal, receiving, spillover, flows): one row a reply with a focal country; old category names are replaced, flows to the source itself dropped."""
    renamed = F.create_map(*[x for p in OLD_NAMES.items() for x in map(F.lit, p)])
    flows = flows.where("source <> target").withColumn("category", F.coalesce(F.try_element_at(renamed, F.col("category")), F.col("category")))
    if regions is not None:
        flows = flows.join(regions.select(F.col("region").alias("source")), "source", "left_semi")
    listed = flows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "category", "source", "target"))).alias("flows"))
    roles = systems.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("code")))).alias(r) for r in ("receiving", "spillover")])
    return focal.join(roles, key, "left").join(listed, key, "left")


def supplement(replies: DataFrame, n_passages: DataFrame, key: str = "doc_id", text_col: str = "text", cap: int = 12) -> dict[str, DataFrame]:
    """Tables ``mentions(key, role, ord, name, ids)``, ``fills(key, role, field, value, ids)``, ``flows(key, ord, category, direction, description, ids)``.

    ids: known passages (1 to n of ``n_passages(key, n)``), each once; mentions and flows need one. Names of over
    200 characters are dropped; direction and description are cut to 200 and 400.
    """
    obj = F.from_json(T.json_object(F.col(text_col)), SUPPLEMENT_SCHEMA)
    rows = replies.select(key, obj.alias("o")).where("o is not null").join(n_passages.select(key, F.col("n").alias("_n")), key)

    def ids(c: str) -> Column:
        numbers = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.try_cast("int"))
        return F.filter(F.array_distinct(numbers), lambda x: x.between(1, F.col("_n")))

    roles = ("sending", "receiving", "spillover")
    said = _union([rows.select(key, "_n", F.lit(r).alias("role"), F.posexplode(f"o.additional_{r}_mentions").alias("ord", "x")) for r in roles])
    said = said.select(key, "role", "ord", F.trim("x.name").alias("name"), ids("x.evidence_passage_ids").alias("ids")).where("name <> '' and length(name) <= 200 and size(ids) > 0")
    mentions = said.withColumn("_r", F.row_number().over(Window.partitionBy(key, "role").orderBy("ord"))).where(F.col("_r") <= cap).withColumn("ord", F.col("_r") - 1).drop("_r")
    fields = ("human_subsystem", "natural_subsystem", "geographic_scope")
    fills = _union([rows.select(key, F.lit(r).alias("role"), F.lit(f).alias("field"), F.nullif(F.trim(f"o.{r}_subsystem_fills.{f}"), F.lit("")).alias("value"), ids(f"o.{r}_subsystem_fills.evidence_passage_ids").alias("ids")) for r in roles for f in fields])
    f = rows.select(key, "_n", F.posexplode("o.supplementary_flows").alias("ord", "x"))
    f = f.select(key, "ord", F.lower(F.trim("x.category")).alias("category"), F.substring(F.trim("x.direction"), 1, 200).alias("direction"), F.substring(F.trim("x.description"), 1, 400).alias("description"), ids("x.evidence_passage_ids").alias("ids"))
    f = f.where(F.col("category").isin(*CATEGORIES) & (F.col("direction") != "") & (F.col("description") != "") & (F.size("ids") > 0))
    flows = f.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("_r") <= cap).withColumn("ord", F.col("_r") - 1).drop("_r")
    return {"mentions": mentions, "fills": fills.where("value is not null"), "flows": flows}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def has_content(obj: Column, fields: tuple[str, ...]) -> Column:
    """Whether any of the named string or string-array fields of a struct holds a non-blank value."""
    text = F.concat_ws("", *[F.to_json(F.struct(obj[f].alias("v"))) for f in fields])
    return F.regexp_replace(F.regexp_replace(text, r'"[a-z_]+":', ""), r'[\[\]{},"\s]|null', "") != ""


def prompt_summary(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, summary): classification cut to 600 characters, two systems a role cut to 400, eight flows with descriptions cut to 100."""
    head = items.where("kind = 'classification'").select(key, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(F.lit("Coupling classification:\n"), F.substring("value", 1, 600)).alias("line"))
    per = items.where("kind = 'systems'").groupBy(key, "coupling", "ord").agg(F.max(F.when(F.col("field") == "role", F.col("value"))).alias("role"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("field") != "role", F.concat_ws(": ", "field", "value")))), " | ").alias("t"))
    order = F.array_position(F.array(*map(F.lit, ("focal", "adjacent", "sending", "receiving", "spillover"))), F.col("role")).cast("int")
    per = per.withColumn("i", F.row_number().over(Window.partitionBy(key, "role").orderBy("coupling", "ord"))).where("i <= 2 and t <> ''")
    systems = per.select(key, F.lit(1).alias("a"), order.alias("b"), F.col("i").alias("c"), F.concat(F.initcap("role"), F.lit(" system "), F.col("i").cast("string"), F.lit(": "), F.substring("t", 1, 400)).alias("line"))
    field = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit(""))
    flows = items.where("kind = 'flows'").groupBy(key, "coupling", "ord").agg(*[field(f).alias(f) for f in ("category", "direction", "description")])
    flows = flows.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("coupling", "ord"))).where("i <= 8")
    flows = flows.select(key, F.lit(2).alias("a"), F.lit(0).alias("b"), F.col("i").alias("c"), F.concat(F.lit("Flow ["), "category", F.lit("] "), "direction", F.lit(": "), F.substring("description", 1, 100)).alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "c", "line"))), lambda x: x["line"]), "\n\n")
    return head.unionByName(systems).unionByName(flows).groupBy(key).agg(whole.alias("summary"))
