"""Adjacency, place names, flows, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import flows, gazetteer, graph, merge, record, signals
from lodestrand.plans.common import Catalogue, table

_c = Catalogue()
QUERIES, ORACLE = _c.queries, _c.oracle

#: Nations are adjacent when they share a region.
_EDGES = "e AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    pairs = n.select("n_regionkey", F.col("n_name").alias("x")).join(n.select("n_regionkey", F.col("n_name").alias("y")), "n_regionkey")
    return graph.edge_set(pairs, "x", "y")


@_c.add(f"""WITH {_EDGES}, p AS (SELECT a.n_name AS code_a, CASE WHEN b.n_nationkey % 7 = 3 THEN NULL ELSE b.n_name END AS code_b FROM nation a JOIN nation b ON (a.n_nationkey + b.n_nationkey) % 3 = 0)
SELECT code_a, code_b, CASE WHEN code_b IS NULL OR code_a = code_b THEN 'unknown' WHEN e.a IS NOT NULL THEN 'pericoupled' ELSE 'telecoupled' END AS pair_type,
CASE WHEN code_b IS NULL THEN 'unresolved' WHEN code_a = code_b THEN 'same_country' ELSE 'database' END AS confidence FROM p LEFT JOIN e ON e.a = least(code_a, code_b) AND e.b = greatest(code_a, code_b) AND code_b IS NOT NULL""")
def nation_adjacency_lookup(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("code_a"), (F.col("n_nationkey") % 3).alias("m")), n.select(F.col("n_nationkey").alias("j"), F.when(F.col("n_nationkey") % 7 != 3, F.col("n_name")).alias("code_b"), ((3 - F.col("n_nationkey") % 3) % 3).alias("m"))
    return graph.lookup_pairs(a.join(b, "m").select("code_a", "code_b"), _edges(spark, sf))


@_c.add(f"WITH {_EDGES}, s AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e) SELECT src, list_sort(list(dst)) AS neighbours FROM s GROUP BY 1")
def neighbour_sets(spark, sf):
    return graph.neighbours(_edges(spark, sf))


def _regions(spark, sf):
    """Market segments of nations as regions; adjacent with the next nation's same segment and the same nation's other ones."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).distinct()
    return c.select(F.concat_ws("-", "k", "s").alias("region"), F.col("s").alias("name"), F.col("k").cast("string").alias("iso"), F.col("k").alias("k"), F.col("s").alias("s"))


def _region_edges(spark, sf):
    r = _regions(spark, sf).select("region", "k", "s")
    other = r.select(F.col("region").alias("o"), F.col("k").alias("k2"), F.col("s").alias("s2"))
    same = r.join(other, F.col("k") == F.col("k2")).select("region", "o")
    following = r.withColumn("n", F.col("k") + 1).join(other, (F.col("n") == F.col("k2")) & (F.col("s") == F.col("s2"))).select("region", "o")
    return graph.edge_set(same.unionByName(following), "region", "o")


_REGIONS = """r AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s, c_nationkey || '-' || c_mktsegment AS region FROM customer),
p AS (SELECT a.region AS x, b.region AS y, a.k AS i, b.k AS j FROM r a JOIN r b ON a.region <> b.region AND (a.k = b.k OR (a.s = b.s AND abs(a.k - b.k) = 1)))"""


@_c.add(f"WITH {_REGIONS} SELECT x AS src, coalesce(list_sort(list(y) FILTER (i = j)), []) AS domestic, coalesce(list_sort(list(y) FILTER (i <> j)), []) AS cross_border FROM p GROUP BY 1")
def cross_border_neighbours(spark, sf):
    return graph.border_neighbours(_region_edges(spark, sf), _regions(spark, sf))


@_c.add(f"""WITH {_REGIONS}, q AS (SELECT a.region AS code_a, b.region AS code_b, a.k AS i, b.k AS j FROM r a JOIN r b ON a.s = b.s)
SELECT code_a, code_b, CASE WHEN code_a = code_b THEN 'same_region' WHEN p.x IS NOT NULL THEN 'pericoupled' ELSE 'telecoupled' END AS pair_type, q.i <> q.j AS cross_country FROM q LEFT JOIN p ON p.x = code_a AND p.y = code_b""")
def region_pair_lookup(spark, sf):
    r = _regions(spark, sf)
    pairs = r.select(F.col("region").alias("code_a"), "s").join(r.select(F.col("region").alias("code_b"), "s"), "s").select("code_a", "code_b")
    return graph.lookup_regions(pairs, _region_edges(spark, sf), r).select("code_a", "code_b", "pair_type", "cross_country")


# --- names -------------------------------------------------------------------------------------------


def _terms(spark, sf):
    n = table(spark, sf, "nation")
    return gazetteer.terms(n.select(F.col("n_name").alias("code"), F.lower("n_name").alias("name")), table(spark, sf, "region").select(F.lower("r_name").alias("alias"), F.col("r_name").alias("code")))


@_c.add("""WITH t AS (SELECT lower(n_name) AS term, n_name AS code, 2 AS prio FROM nation UNION ALL SELECT lower(r_name), r_name, 1 FROM region),
x AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Trade of ' || n_name || ' with ' || r_name WHEN 1 THEN n_name WHEN 2 THEN n_name || 'ish goods' ELSE 'from ' || lower(r_name) || '.' END AS txt
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT id, code, length(term) AS len, prio, term FROM x JOIN t ON regexp_matches(lower(txt), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)'))
SELECT x.id, arg_min(code, (-len, prio, term)) AS code FROM x LEFT JOIN m USING (id) GROUP BY 1""")
def gazetteer_resolution(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    m = F.col("c_custkey") % 4
    text = F.when(m == 0, F.concat(F.lit("Trade of "), "n_name", F.lit(" with "), "r_name")).when(m == 1, F.col("n_name")).when(m == 2, F.concat("n_name", F.lit("ish goods"))).otherwise(F.concat(F.lit("from "), F.lower("r_name"), F.lit(".")))
    return gazetteer.resolve(rows.select(F.col("c_custkey").alias("id"), text.alias("t")), ["id"], "t", _terms(spark, sf))


@_c.add("""WITH r AS (SELECT DISTINCT lower(c_mktsegment) AS term, c_nationkey || '-' || c_mktsegment AS region, c_nationkey::VARCHAR AS iso FROM customer),
x AS (SELECT s_suppkey AS id, (ARRAY['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'])[s_suppkey % 5 + 1] AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR END AS iso FROM supplier)
SELECT id, CASE WHEN count(DISTINCT r.iso) = 1 THEN min(region) END AS region FROM x LEFT JOIN r ON lower(name) = term AND (x.iso IS NULL OR x.iso = r.iso) GROUP BY 1""")
def region_resolution_ambiguity(spark, sf):
    names = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).alias("iso"))
    return gazetteer.resolve_regions(rows, ["id"], "name", _regions(spark, sf), _terms(spark, sf), "iso")


# --- classes -----------------------------------------------------------------------------------------

_FOCAL = "(SELECT n_name FROM nation WHERE n_nationkey = 3)"


def _focal(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey = 3").first()["n_name"]


@_c.add(f"""WITH {_EDGES}, m AS (SELECT n_name AS code FROM nation WHERE n_nationkey % 2 = 0)
SELECT n_name AS code, CASE WHEN n_name = {_FOCAL} THEN 'intracoupling' WHEN e.a IS NOT NULL THEN 'pericoupling' ELSE 'telecoupling' END AS legacy,
CASE WHEN n_name = {_FOCAL} THEN 'intracoupling' WHEN e.a IS NOT NULL THEN 'pericoupling' WHEN n_nationkey % 2 = 0 THEN 'telecoupling' ELSE 'na' END AS mentioned
FROM nation LEFT JOIN e ON least(n_name, {_FOCAL}) = e.a AND greatest(n_name, {_FOCAL}) = e.b""")
def coupling_classification(spark, sf):
    shapes = table(spark, sf, "nation").select(F.col("n_name").alias("code"), "n_nationkey")
    said, edges, focal = shapes.where("n_nationkey % 2 = 0").select("code"), _edges(spark, sf), _focal(spark, sf)
    a = graph.classify_countries(shapes, focal, edges, shapes.select("code")).withColumnRenamed("class", "legacy")
    return a.join(graph.classify_countries(shapes, focal, edges, shapes.select("code"), said).withColumnRenamed("class", "mentioned"), "code")


@_c.add(f"""WITH {_REGIONS}, f AS (SELECT region, k FROM r WHERE region = '3-BUILDING'),
c AS (SELECT r.region AS code, CASE WHEN r.region = '3-BUILDING' THEN 3 WHEN r.k % 2 = 1 AND p.x IS NOT NULL THEN 2 WHEN r.k % 2 = 1 THEN 1 WHEN r.k = 4 THEN 1 ELSE 0 END AS pr, r.k FROM r LEFT JOIN p ON p.x = r.region AND p.y = '3-BUILDING')
SELECT k::VARCHAR AS iso, (ARRAY['na', 'telecoupling', 'pericoupling', 'intracoupling'])[max(pr) + 1] AS class FROM c GROUP BY 1""")
def region_classification_dissolved(spark, sf):
    r = _regions(spark, sf)
    shapes, said = r.select(F.col("region").alias("code"), "iso"), r.where("k % 2 = 1").select(F.col("region").alias("code"))
    found = graph.classify_regions(shapes, "3-BUILDING", "3", _region_edges(spark, sf), r.select("iso"), r.where("k = 4").select("iso"), said)
    return graph.dissolve(found)


# --- flows -------------------------------------------------------------------------------------------

_TRADE = "t AS (SELECT s.n_name AS source, c.n_name AS target, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY ALL)"


def _trade(spark, sf):
    n = table(spark, sf, "nation")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    seller = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source")), "s_nationkey")
    buyer = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target")), "c_nationkey")
    rows = li.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(seller, F.col("l_suppkey") == F.col("s_suppkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@_c.add(f"""WITH {_EDGES}, {_TRADE}, p AS (SELECT target AS key, e.a IS NOT NULL AS peri FROM t LEFT JOIN e ON e.a = least(source, target) AND e.b = greatest(source, target) WHERE source <> target)
SELECT key, (count(*) FILTER (peri))::INT AS n_peri, (count(*) FILTER (NOT peri))::INT AS n_tele, CASE WHEN count(*) FILTER (peri) > 0 AND length(key) % 2 = 1 THEN 'differs' ELSE 'consistent' END AS note FROM p GROUP BY 1""")
def validation_note(spark, sf):
    """A nation's others are all that any order ties to it."""
    others = _trade(spark, sf).select(F.col("target").alias("key"), F.col("source").alias("code"))
    focal = others.select("key").distinct().select("key", F.col("key").alias("focal"), (F.length("key") % 2 == 0).alias("says_peri"), F.lit(True).alias("says_tele"))
    found = graph.validation(focal, others, _edges(spark, sf), "key")
    return found.select("key", F.size("pericoupled").alias("n_peri"), F.size("telecoupled").alias("n_tele"), "note")


@_c.add(f"WITH {_TRADE} SELECT source, target, source || ' → ' || target AS direction FROM t WHERE source <> target")
def trade_flows_resolved(spark, sf):
    names = _terms(spark, sf)
    said = _trade(spark, sf).where("source <> target").select(F.monotonically_increasing_id().alias("ord"), F.lit("matter").alias("category"), F.concat("source", F.lit(" -> "), "target", F.lit(" (trade)")).alias("direction"), F.lit("").alias("description"), F.lit(0).alias("doc_id"))
    systems = spark.createDataFrame([], "doc_id int, role string, name string, geographic_scope string, system_scope string")
    focal = spark.createDataFrame([(0, "NOWHERE")], "doc_id int, focal string")
    found = flows.resolve_flows(said, systems, focal, names)
    return found.select("source", "target", flows.direction_label(F.col("source"), F.col("target"), F.col("both_ways")).alias("direction"))


@_c.add(f"""WITH {_TRADE}, s AS (SELECT source, target, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source, target) - 1 AS slot FROM t)
SELECT source, target, slot::INT AS slot, round(CASE WHEN source <= target THEN 1 ELSE -1 END * (0.15 + 0.1 * slot), 6)::DOUBLE AS rad FROM s""")
def flow_slots(spark, sf):
    return flows.slots(_trade(spark, sf), ["source", "target"]).select("source", "target", "slot", "rad")


@_c.add(f"WITH {_TRADE} SELECT source, target, n FROM t WHERE target IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) AND source IN (SELECT n_name FROM nation WHERE n_nationkey < 6)")
def flow_endpoint_filter(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("code"), "n_nationkey")
    return flows.filter_ends(_trade(spark, sf), n.where("n_nationkey % 2 = 0"), n.where("n_nationkey < 6"))


@_c.add(f"WITH {_TRADE} SELECT source, target, a.n_nationkey::DOUBLE AS x0, a.n_regionkey::DOUBLE AS y0, b.n_nationkey::DOUBLE AS x1, b.n_regionkey::DOUBLE AS y1 FROM t JOIN nation a ON a.n_name = source JOIN nation b ON b.n_name = target")
def arrow_layer(spark, sf):
    points = table(spark, sf, "nation").select(F.col("n_name").alias("code"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    return flows.arrow_layer(_trade(spark, sf), points).select("source", "target", "x0", "y0", "x1", "y1")


@_c.add("""WITH a AS (SELECT user_id % 5 AS doc_id, event_id AS ord, event_type AS category, 'to ' || (user_id % 3) AS direction, event_id % 2 AS s FROM events)
SELECT doc_id, ord, category, direction FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, o) - 1 AS ord, category, direction FROM (SELECT *, ord AS o FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, category, direction ORDER BY s, ord) = 1))""")
def flow_merge(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 5).alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("category"), F.concat(F.lit("to "), (F.col("user_id") % 3).cast("string")).alias("direction"), (F.col("event_id") % 2).alias("s"))
    return merge.merge_flows(rows.where("s = 0").drop("s"), rows.where("s = 1").drop("s"), "doc_id").select("doc_id", F.col("ord").cast("bigint").alias("ord"), "category", "direction")


@_c.add("""WITH b AS (SELECT n_regionkey AS doc_id, 'receiving' AS role, n_name AS code FROM nation WHERE n_nationkey % 3 = 0), f AS (SELECT n_regionkey AS doc_id, min(n_name) AS code FROM nation GROUP BY 1),
x AS (SELECT n_regionkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'receiving' ELSE 'spillover' END AS role, n_name AS code FROM nation)
SELECT * FROM b UNION ALL SELECT doc_id, role, code FROM x ANTI JOIN b USING (doc_id, code) WHERE (doc_id, code) NOT IN (SELECT (doc_id, code) FROM f)""")
def supplement_merge(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_name").alias("code"), "n_nationkey")
    base = n.where("n_nationkey % 3 = 0").select("doc_id", F.lit("receiving").alias("role"), "code")
    extra = n.select("doc_id", F.when(F.col("n_nationkey") % 2 == 0, "sending").otherwise("spillover").alias("role"), "code")
    focal = n.groupBy("doc_id").agg(F.min("code").alias("focal"))
    return merge.add_codes(base, extra, focal, "doc_id")


# --- records: replies composed from the tables ---------------------------------------------------------


def _replies(spark, sf):
    """A reply for every nation: a record in the expected markdown, with its own and its region's name."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = F.col("n_name"), F.col("r_name")
    text = F.concat(
        F.lit("# 1. Coupling Classification\nMostly distant.\n\n## 4. Telecoupling Analysis\n### 4.1 Systems Identification\n**Sending System (distant)**: "), a, F.lit("\n- **Human subsystem**: growers\n- soils of "), a,
        F.lit("\n**Receiving System**: "), b, F.lit("\n\n### 4.2 Flows Analysis\n- [Matter] "), a, F.lit(" -> "), b, F.lit(": grain\n- money moves "), b, F.lit(" → "), a,
        F.lit("\n\n### 4.3 Agents\n- [Traders] Mills of "), a, F.lit(": buy grain\n- local farmers\n\n### 4.4 Causes\n**Economic**\n- prices\n- demand\n**Water**\n- drought\n\n### 4.5 Effects\n- land use\n\n# 6. Research Gaps\n- data on "), b, F.lit("\n* trends\n"),
    )
    return rows.select(F.col("n_nationkey").cast("bigint").alias("doc_id"), text.alias("text"))


def _rows(*rows: str) -> str:
    return " UNION ALL ".join(f"SELECT n_nationkey::BIGINT AS doc_id, {r} FROM nation JOIN region ON n_regionkey = r_regionkey" for r in rows)


@_c.add(_rows("'coupling_classification' AS section, NULL AS part, 2::BIGINT AS n", "'telecoupling', 'systems', 5", "'telecoupling', 'flows', 3", "'telecoupling', 'agents', 3", "'telecoupling', 'causes', 6", "'telecoupling', 'effects', 2", "'research_gaps', NULL, 3"))
def record_parse_sections(spark, sf):
    return record.lines(_replies(spark, sf)).groupBy("doc_id", "section", "part").agg(F.count(F.lit(1)).alias("n"))


@_c.add(_rows("0 AS ord, 'matter' AS category, n_name || ' -> ' || r_name AS direction, 'grain' AS description", "1, 'capital', 'money moves ' || r_name || ' → ' || n_name, 'money moves ' || r_name || ' → ' || n_name"))
def record_parse_flows(spark, sf):
    return record.flows(record.lines(_replies(spark, sf))).select("doc_id", "ord", "category", "direction", "description")


@_c.add(_rows("0 AS ord, 'sending' AS role, 'distant' AS system_scope, n_name AS name, 'growers' AS human, 'soils of ' || n_name AS description", "1, 'receiving', NULL, r_name, NULL, NULL"))
def record_parse_systems(spark, sf):
    f = F.col("fields")
    return record.systems(record.lines(_replies(spark, sf))).select("doc_id", "ord", f["role"].alias("role"), F.try_element_at(f, F.lit("system_scope")).alias("system_scope"), f["name"].alias("name"), F.try_element_at(f, F.lit("human_subsystem")).alias("human"), F.try_element_at(f, F.lit("description")).alias("description"))


@_c.add(_rows("0 AS ord, 'firms / traders / corporations' AS level, 'Mills of ' || n_name AS name, 'buy grain' AS description", "1, 'individuals / households', 'local farmers', NULL"))
def record_parse_agents(spark, sf):
    return record.agents(record.lines(_replies(spark, sf))).select("doc_id", "ord", "level", "name", "description")


@_c.add(_rows("'economic' AS category, 0 AS ord, 'prices' AS item", "'economic', 1, 'demand'", "'hydrological', 0, 'drought'"))
def record_parse_causes(spark, sf):
    return record.categorised(record.lines(_replies(spark, sf)), "causes").select("doc_id", "category", "ord", "item")


@_c.add(_rows("['telecoupling'] AS couplings, 2::BIGINT AS n_systems, 2::BIGINT AS n_flows, 2::BIGINT AS n_agents, 3::BIGINT AS n_causes, 1::BIGINT AS n_effects, 2::BIGINT AS n_gaps"))
def record_summary(spark, sf):
    return record.summary(record.parse(_replies(spark, sf)))


@_c.add(_rows("'Mostly distant. ' || n_name || ' soils of ' || n_name || ' ' || r_name || ' grain matter money moves ' || r_name || ' → ' || n_name || ' capital prices demand drought land use' AS query"))
def record_query(spark, sf):
    return record.retrieval_query(record.parse(_replies(spark, sf)))


@_c.add("""SELECT n_nationkey::BIGINT AS doc_id, n_name AS focal, CASE WHEN n_nationkey % 4 <> 1 THEN r_name END AS receiving, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS flows
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def json_signals_validate(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    sure = F.when(F.col("n_nationkey") % 4 == 1, "0.4").otherwise("0.9")
    known = F.when(F.col("n_nationkey") % 2 == 0, "W1").otherwise("W9")
    reply = F.concat(F.lit('Sure.\n```json\n{"focal_country": "'), "n_name", F.lit('", "receiving_systems": [{"country": "'), "r_name", F.lit('", "confidence": '), sure, F.lit(', "evidence": ["w1"]}, {"country": "Atlantis", "confidence": 1, "evidence": ["W1"]}], "flows": [{"category": "Material", "source_country": "'), "n_name", F.lit('", "target_country": "'), "r_name", F.lit('", "confidence": 2, "evidence": ["'), known, F.lit('"]}]}\n```'))
    replies = rows.select(F.col("n_nationkey").cast("bigint").alias("doc_id"), reply.alias("text"))
    found = signals.web_signals(replies, replies.select("doc_id", F.lit(1).alias("n")), _terms(spark, sf))
    count = found["flows"].groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("flows"))
    out = found["focal"].join(found["systems"].where("role = 'receiving'").select("doc_id", F.col("code").alias("receiving")), "doc_id", "left").join(count, "doc_id", "left")
    return out.select("doc_id", "focal", "receiving", F.coalesce("flows", F.lit(0)).alias("flows"))


