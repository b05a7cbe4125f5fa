"""Markdown replies to typed records.

A reply is cut into lines once; headings and roles are carried forward by windows, so every list of
a record is a group of lines. Records stay in long form: ``(doc_id, coupling, kind, ord, key, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import lexicon as L

# Headings of a reply and of its coupling sections.
TOP = (
    ("coupling_classification", r"coupling\s+classification"), ("intracoupling", r"intracoupling\s+analysis"), ("pericoupling", r"pericoupling\s+analysis"),
    ("telecoupling", r"telecoupling\s+analysis"), ("cross_coupling_interactions", r"cross[-\s]+coupling\s+interactions?"), ("research_gaps", r"research\s+gaps?"),
)
PARTS = (("systems", r"systems?\s+identification"), ("flows", r"flows?\s+analysis"), ("agents", r"agents?"), ("causes", r"causes?"), ("effects", r"effects?"))
COUPLINGS = ("intracoupling", "pericoupling", "telecoupling")
BULLET = r"^\s*[-*•]\s+"


def _named(line: Column, patterns, lead: str) -> Column:
    return F.coalesce(*[F.when(line.rlike(rf"(?i)^{lead}{p}"), F.lit(name)) for name, p in patterns])


def _clean(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))


def lines(replies: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, line, section, part): trimmed lines under the first heading of each name; heading lines themselves are dropped.

    A heading that comes again opens nothing new: its line is text of the section it stands in.
    """
    rows = replies.select(key, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\r\n|\r|\n")).alias("n", "raw"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    top = _named(F.col("raw"), TOP, r"#+\s*\d*\.?\s*")
    rows = rows.withColumn("_top", top).withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_top").orderBy("n")))
    rows = rows.withColumn("_top", F.when(F.col("_nth") == 1, F.col("_top"))).withColumn("section", F.last("_top", True).over(before))
    part = F.when(F.col("section").isin(*COUPLINGS) & F.col("_top").isNull(), _named(F.col("raw"), PARTS, r"#{1,6}\s*\d+(?:\.\d+)?\.?\s*"))
    rows = rows.withColumn("_part", part).withColumn("_nth", F.row_number().over(Window.partitionBy(key, "section", "_part").orderBy("n")))
    rows = rows.withColumn("_part", F.when(F.col("_nth") == 1, F.col("_part")))
    inside = Window.partitionBy(key, "section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.last("_part", True).over(inside)).where("_top is null and _part is null and section is not null")
    return rows.select(key, "n", _clean(F.col("raw")).alias("line"), "section", "part")


def bullets(rows: DataFrame) -> DataFrame:
    """Bullet lines without their marks; empty ones are dropped."""
    item = _clean(F.regexp_replace("line", BULLET, ""))
    return rows.where(F.col("line").rlike(BULLET)).withColumn("item", item).where("item <> ''")


def classification(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, coupling_classification): the section's lines."""
    some = rows.where("section = 'coupling_classification'").groupBy(key).agg(_joined("n", "line", "\n").alias("t"))
    return some.select(key, _clean(F.col("t")).alias("coupling_classification"))


def _joined(order: str, value: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), by)


def listed(rows: DataFrame, section: str, key: str = "doc_id") -> DataFrame:
    """(key, ord, item): bullets of a section; interactions without any bullet are its non-empty lines."""
    mine = rows.where(F.col("section") == section)
    items = bullets(mine).select(key, "n", "item")
    if section == "cross_coupling_interactions":
        bare = mine.where("line <> ''").select(key, "n", F.col("line").alias("item")).join(items.select(key).distinct(), key, "left_anti")
        items = items.unionByName(bare)
    return items.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).alias("ord"), "item")


def categorised(rows: DataFrame, part: str, key: str = "doc_id") -> DataFrame:
    """(key, coupling, category, ord, item): bullets of causes or effects under bold headings, before any of them ``general``."""
    mine = rows.where(F.col("part") == part)
    heading = F.regexp_extract("line", r"^\*{2}([^*]+)\*{2}\s*(?::|[-—–].*)?\s*$", 1)
    name = F.lower(F.trim(F.regexp_replace(heading, r"\s+", " ")))
    table = F.create_map(*[F.lit(x) for pair in L.lookup(L.CAUSE_CATEGORIES) for x in pair])
    named = F.when(heading != "", F.coalesce(F.try_element_at(table, name), name))
    so_far = Window.partitionBy(key, "section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mine = mine.withColumn("category", F.coalesce(F.last(named, True).over(so_far), F.lit("general"))).where(heading == "")
    items = bullets(mine)
    order = F.row_number().over(Window.partitionBy(key, "section", "category").orderBy("n")) - 1
    return items.select(key, F.col("section").alias("coupling"), "category", order.alias("ord"), "item")


# --- systems -----------------------------------------------------------------------------------


def systems(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, coupling, ord, fields): a map of role, name, system_scope, subsystems, description and other labels.

    Lines below a role heading are its fields; of a repeated label the last value counts; free lines make
    the description. A section without role headings gives its bullets of the form ``role: name``.
    """
    mine = rows.where("part = 'systems' and line <> ''")
    head = r"(?i)^(?:#{1,6}\s*)?\*{0,2}\s*(focal|adjacent|sending|receiving|spillover)\s*(?:system)?(?:\s*\(([^)]+)\))?\s*\*{0,2}\s*:\s*(.*)$"
    is_head = F.col("line").rlike(head)
    so_far = Window.partitionBy(key, "section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mine = mine.withColumn("_head", is_head).withColumn("_g", F.sum(is_head.cast("int")).over(so_far))
    grab = lambda i: F.regexp_extract("line", head, i)
    scope = F.trim(F.regexp_replace(F.lower(grab(2)), r"\s+", " "))
    name = F.regexp_replace(F.trim(grab(3)), r"[*\s]+$", "")
    headed = mine.where("_head").select(key, "section", "_g", "n", F.explode(F.filter(F.array(
        F.struct(F.lit("role").alias("k"), F.lower(grab(1)).alias("v")), F.struct(F.lit("system_scope").alias("k"), scope.alias("v")), F.struct(F.lit("name").alias("k"), name.alias("v")),
    ), lambda x: x["v"] != "")).alias("f"))
    body = mine.where("not _head and _g > 0").withColumn("_c", _clean(F.regexp_replace("line", BULLET, ""))).where("_c <> ''")
    label_form = r"^\*{0,2}([^:*]+)\*{0,2}\s*:\s*(.*)"
    label = F.lower(F.trim(F.regexp_extract("_c", label_form, 1)))
    table = F.create_map(*[F.lit(x) for pair in L.lookup(L.SYSTEM_FIELDS) for x in pair])
    field = F.coalesce(F.try_element_at(table, label), F.replace(label, F.lit(" "), F.lit("_")))
    labelled = body.where(F.col("_c").rlike(label_form)).select(key, "section", "_g", "n", F.struct(field.alias("k"), F.trim(F.regexp_extract("_c", label_form, 2)).alias("v")).alias("f"))
    free = body.where(~F.col("_c").rlike(label_form)).groupBy(key, "section", "_g").agg(F.max("n").alias("n"), _joined("n", "_c", " ").alias("t"))
    free = free.select(key, "section", "_g", "n", F.struct(F.lit("description").alias("k"), F.col("t").alias("v")).alias("f"))
    fields = headed.unionByName(labelled).unionByName(free).groupBy(key, "section", "_g", "f.k").agg(F.max_by("f.v", "n").alias("v"), F.min("n").alias("n"))
    found = fields.groupBy(key, "section", "_g").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))
    found = found.select(key, "section", (F.col("_g") - 1).cast("int").alias("ord"), "fields")

    flat = bullets(rows.where("part = 'systems'").join(found.select(key, "section").distinct(), [key, "section"], "left_anti"))
    said = F.lower(F.trim(F.regexp_extract("item", label_form, 1)))
    role = F.regexp_replace(F.trim(F.regexp_replace(said, r"\s*\([^)]*\)", "")), r"\s+system$", "")
    within = F.lower(F.trim(F.regexp_extract(said, r"\(([^)]+)\)", 1)))
    flat = flat.where(role.isin(*L.SYSTEM_ROLES))
    entry = F.map_from_entries(F.filter(F.array(F.struct(F.lit("name"), F.trim(F.regexp_extract("item", label_form, 2))), F.struct(F.lit("role"), role), F.struct(F.lit("system_scope"), within)), lambda x: x["col2"] != ""))
    flat = flat.select(key, "section", (F.row_number().over(Window.partitionBy(key, "section").orderBy("n")) - 1).alias("ord"), entry.alias("fields"))
    return found.unionByName(flat).withColumnRenamed("section", "coupling")


# --- flows -------------------------------------------------------------------------------------

_PLACE = r"[A-Za-z][\w\s/,()'-]*"


def flow_category(text: Column) -> Column:
    """The first category whose name is in the text, else that of the first alias; null without."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(c)), F.lit(c)) for c in L.FLOW_CATEGORIES], *[F.when(F.contains(low, F.lit(a)), F.lit(c)) for a, c in L.FLOW_ALIASES])


def direction(text: Column) -> Column:
    """``A → B``, ``Bidirectional (A ↔ B)``, ``Bidirectional``, or null."""
    one, two = rf"({_PLACE}?)\s*(?:→|(?<!<)->|(?<!<)=>)\s*({_PLACE})", rf"({_PLACE}?)\s*(?:↔|<->|<=>)\s*({_PLACE})"
    ends = lambda p, i: F.trim(F.regexp_extract(text, p, i))
    return (
        F.when(text.rlike(one), F.concat(ends(one, 1), F.lit(" → "), ends(one, 2)))
        .when(text.rlike(two), F.concat(F.lit("Bidirectional ("), ends(two, 1), F.lit(" ↔ "), ends(two, 2), F.lit(")")))
        .when(F.contains(F.lower(text), F.lit("bidirectional")), "Bidirectional")
    )


def flows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, coupling, ord, category, direction, description); what isn't said is null.

    Under bold headings that end in ``flow(s)``: a flow each, its lines direction, description or free
    text. Without such headings every bullet is a flow: ``[category] direction: description``, labelled
    fields, or text in which direction and category are looked for.
    """
    mine = rows.where("part = 'flows' and line <> ''")
    bold = r"(?i)^(?:\d+\.?\s*)?\*{2}\s*(?:\d+\.?\s*)?([\w\s/]+?flows?)\s*\*{2}\s*:?\s*$"
    so_far = Window.partitionBy(key, "section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").rlike(bold)
    blocks = mine.withColumn("_h", is_head).withColumn("_g", F.sum(is_head.cast("int")).over(so_far)).where("_g > 0")
    c = _clean(F.regexp_replace("line", BULLET, ""))
    said, told = r"(?i)^\*{0,2}direction\*{0,2}\s*:\s*(.*)", r"(?i)^\*{0,2}description\*{0,2}\s*:\s*(.*)"
    blocks = blocks.withColumn("_c", c).where("_h or _c <> ''")
    given = F.when(~F.col("_h") & F.col("_c").rlike(said), F.trim(F.regexp_extract("_c", said, 1)))
    guess = F.when(~F.col("_h") & ~F.col("_c").rlike(said) & ~F.col("_c").rlike(told), direction(F.col("_c")))
    blocks = blocks.withColumn("_given", given).withColumn("_guess", guess)
    earlier = Window.partitionBy(key, "section", "_g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # a line is taken as the direction only while none is known
    taken = F.col("_guess").isNotNull() & (F.coalesce(F.count(F.coalesce("_given", "_guess")).over(earlier), F.lit(0)) == 0)
    blocks = blocks.withColumn("_taken", taken)
    text = F.when(F.col("_h") | F.col("_given").isNotNull() | F.col("_taken"), None).when(F.col("_c").rlike(told), F.trim(F.regexp_extract("_c", told, 1))).otherwise(F.col("_c"))
    way = F.coalesce(F.col("_given"), F.when(F.col("_taken"), F.col("_guess")))
    made = blocks.withColumn("_text", text).withColumn("_way", way).groupBy(key, "section", "_g").agg(
        F.max(F.when(F.col("_h"), flow_category(F.regexp_extract("line", bold, 1)))).alias("category"),
        F.max_by("_way", F.when(F.col("_way").isNotNull(), F.col("n"))).alias("direction"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("n", "_text")))), lambda x: x["_text"]), " ").alias("description"),
    )
    made = made.select(key, "section", (F.col("_g") - 1).cast("int").alias("ord"), "category", "direction", F.nullif("description", F.lit("")).alias("description"))

    items = bullets(mine.join(made.select(key, "section").distinct(), [key, "section"], "left_anti"))
    form = r"^\[([^\]]+)\]\s*([^:]+):\s*(.*)"
    part = lambda i: F.trim(F.regexp_extract("item", form, i))
    label = lambda w, stop: F.nullif(F.trim(F.regexp_extract("item", rf"(?i)\*{{0,2}}{w}\*{{0,2}}\s*:\s*({stop})", 1)), F.lit(""))
    cat, way, des = label("category", "[^|*]+"), label("direction", "[^|*]+"), label("description", ".*")
    bracket, labelled = F.col("item").rlike(form), cat.isNotNull() | way.isNotNull() | des.isNotNull()
    sort = lambda x: F.coalesce(flow_category(x), F.lower(x))
    flat = items.select(
        key, "section", (F.row_number().over(Window.partitionBy(key, "section").orderBy("n")) - 1).alias("ord"),
        F.when(bracket, sort(part(1))).when(labelled, sort(cat)).otherwise(flow_category(F.col("item"))).alias("category"),
        F.when(bracket, part(2)).when(labelled, way).otherwise(direction(F.col("item"))).alias("direction"),
        F.when(bracket, part(3)).when(labelled, des).otherwise(F.col("item")).alias("description"),
    )
    return made.unionByName(flat).withColumnRenamed("section", "coupling")


# --- agents ------------------------------------------------------------------------------------


def agent_level(text: Column) -> Column:
    """The level of a bracketed label, else of the first alias in the text; null without."""
    pairs = L.lookup(L.AGENT_LEVELS)
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    label = F.lower(F.trim(F.regexp_replace(F.regexp_extract(text, r"\[([^\]]+)\]", 1), r"\s+", " ")))
    found = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(v).alias("v")) for a, v in pairs]), lambda x: F.contains(F.lower(text), x["a"]))
    return F.coalesce(F.try_element_at(table, label), F.get(found, F.lit(0))["v"])


def agents(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, coupling, ord, level, name, description): ``[level] name: description``, or a bullet whose level is looked for."""
    items = bullets(rows.where("part = 'agents'"))
    bracket = r"^\[([^\]]+)\]\s*(.*)"
    has = F.col("item").rlike(bracket)
    rest = F.when(has, F.trim(F.regexp_extract("item", bracket, 2))).otherwise(F.col("item"))
    label = F.lower(F.trim(F.regexp_replace(F.regexp_extract("item", bracket, 1), r"\s+", " ")))
    table = F.create_map(*[F.lit(x) for pair in L.lookup(L.AGENT_LEVELS) for x in pair])
    colon = r"^([^:]+):\s*(.*)"
    return items.select(
        key, F.col("section").alias("coupling"), (F.row_number().over(Window.partitionBy(key, "section").orderBy("n")) - 1).alias("ord"),
        F.when(has, F.try_element_at(table, label)).otherwise(agent_level(F.col("item"))).alias("level"),
        F.when(rest.rlike(colon), F.trim(F.regexp_extract(rest, colon, 1))).otherwise(rest).alias("name"),
        F.when(rest.rlike(colon), F.trim(F.regexp_extract(rest, colon, 2))).alias("description"),
    )


def parse(replies: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole record in long form: (key, coupling, kind, ord, key, value).

    kind: classification, systems, flows, agents, causes, effects, interactions, gaps; ``coupling`` is null
    where a kind has none. For causes and effects the field name is the category.
    """
    rows = lines(replies, key, text_col)
    none = F.lit(None).cast("string")
    out = ["coupling", "kind", "ord", "field", "value"]
    parts = [
        classification(rows, key).select(key, none.alias("coupling"), F.lit("classification").alias("kind"), F.lit(0).alias("ord"), F.lit("text").alias("field"), F.col("coupling_classification").alias("value")),
        systems(rows, key).select(key, "coupling", F.lit("systems").alias("kind"), "ord", F.explode("fields").alias("field", "value")),
    ]
    for kind, df, fields in (("flows", flows(rows, key), ("category", "direction", "description")), ("agents", agents(rows, key), ("level", "name", "description"))):
        parts.append(df.select(key, "coupling", F.lit(kind).alias("kind"), "ord", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select(key, "coupling", "kind", "ord", "x.*").where("value is not null"))
    for kind in ("causes", "effects"):
        parts.append(categorised(rows, kind, key).select(key, "coupling", F.lit(kind).alias("kind"), "ord", F.col("category").alias("field"), F.col("item").alias("value")))
    for kind, section in (("interactions", "cross_coupling_interactions"), ("gaps", "research_gaps")):
        parts.append(listed(rows, section, key).select(key, none.alias("coupling"), F.lit(kind).alias("kind"), "ord", F.lit("item").alias("field"), F.col("item").alias("value")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select(key, *out)


# --- reading records -----------------------------------------------------------------------------


def active_couplings(items: DataFrame, key: str = "doc_id") -> DataFrame:
    return items.where("coupling is not null").select(key, "coupling").distinct()


def system_entries(items: DataFrame, key: str = "doc_id", role: str | None = None) -> DataFrame:
    """(key, coupling, ord, role, name, geographic_scope, system_scope, description) of systems, of one role if named."""
    fields = ("role", "name", "geographic_scope", "system_scope", "description")
    wide = items.where("kind = 'systems'").groupBy(key, "coupling", "ord").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return wide if role is None else wide.where(F.col("role") == role)


def summary(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, couplings, n_systems, n_flows, n_agents, n_causes, n_effects, n_gaps) of every record."""
    count = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.struct(F.coalesce("coupling", F.lit("")), F.when(F.col("kind").isin("causes", "effects"), F.col("field")).otherwise("").alias("f"), "ord")))
    return items.groupBy(key).agg(F.array_sort(F.collect_set("coupling")).alias("couplings"), *[count(k).alias(f"n_{k}") for k in ("systems", "flows", "agents", "causes", "effects", "gaps")])


def fragments(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): every value of a record, for term extraction and queries."""
    return items.select(key, F.col("value").alias("text"))


def retrieval_query(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, query): what a record asks of a corpus, joined by blanks.

    The classification; of sending, receiving and spillover systems the name, geographic scope and
    description; of flows the description and category; causes and effects, by category in the order
    of the alphabet. Couplings in that order too. A record with none of these has no row.
    """
    at = lambda g, a, b, c: F.struct(F.lit(g).alias("g"), F.coalesce("coupling", F.lit("")).alias("k"), a.alias("a"), b.alias("b"), c.alias("c"))
    blank, zero, ordinal = F.lit(""), F.lit(0), F.col("ord").cast("int")
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c).cast("int")
    long = items.select(key, "coupling", "kind", "ord", "field", "value").where("value <> ''")
    parts = [long.where("kind = 'classification'").select(key, at(0, blank, zero, zero).alias("at"), "value")]
    fields, roles = ("name", "geographic_scope", "description"), ("sending", "receiving", "spillover")
    systems_ = system_entries(items, key).where(F.col("role").isin(*roles))
    systems_ = systems_.select(key, "coupling", "ord", "role", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).where("x.value <> ''")
    parts.append(systems_.select(key, at(1, place(roles, F.col("role")).cast("string"), ordinal, place(fields, F.col("x.field"))).alias("at"), F.col("x.value").alias("value")))
    shown = ("description", "category")
    parts.append(long.where(F.col("kind") == "flows").where(F.col("field").isin(*shown)).select(key, at(2, blank, ordinal, place(shown, F.col("field"))).alias("at"), "value"))
    for n, kind in ((3, "causes"), (4, "effects")):
        parts.append(long.where(F.col("kind") == kind).select(key, at(n, F.coalesce("field", blank), ordinal, zero).alias("at"), "value"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return whole.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["value"]), " ").alias("query"))


def record_terms(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term): distinct search terms of a record's values, its coupling types and category labels."""
    from lodestrand.functions.text import search_terms

    words = items.select(key, F.explode(search_terms(F.col("value"), L.RECORD_TERM_STOPWORDS)).alias("term"))
    labels = items.where("kind in ('causes', 'effects')").select(key, F.lower("field").alias("term"))
    return words.unionByName(labels).where(~F.col("term").isin(*L.RECORD_TERM_STOPWORDS)).distinct()
