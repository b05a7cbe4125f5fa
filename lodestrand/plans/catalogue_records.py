"""Audits of records and licences, questions, predicates on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import lexicon as L
from lodestrand.functions import text as T
from lodestrand.operators import audit, gazetteer, graph, linkage, merge
from lodestrand.plans.catalogue_geo import _EDGES, _FOCAL, _REGIONS, _edges, _focal, _region_edges, _regions
from lodestrand.plans.common import Catalogue, sql_list, table

_c = Catalogue()
QUERIES, ORACLE = _c.queries, _c.oracle


def _pick(n, *values):
    """The value at a number's remainder."""
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


# --- audits ------------------------------------------------------------------------------------------

_LICENCES = ("cc-by", "cc-by-nc", "cc0", "other-oa", "cc-by-nc-nd")


@_c.add(f"""WITH d AS (SELECT p_partkey AS key, {sql_list(_LICENCES)}[p_partkey % 5 + 1] AS lic FROM part WHERE p_size % 2 = 0),
c AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN 'cc-by-sa' ELSE {sql_list(_LICENCES)}[p_partkey % 5 + 1] END AS l, CASE WHEN p_partkey % 7 = 0 THEN 'acceptedversion' ELSE 'publishedversion' END AS v FROM part WHERE p_partkey % 3 > 0),
x AS (SELECT lic, l, v FROM d LEFT JOIN c USING (key))
SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l IS NULL AND v IS NULL THEN 'missing cache' END, CASE WHEN l <> lic THEN 'license mismatch' END, CASE WHEN v <> 'publishedversion' THEN 'not published version' END,
'class ' || CASE WHEN lic IN ('cc-by', 'cc0') THEN 'strict' WHEN contains(lic, '-nc') THEN 'noncommercial' ELSE 'other' END], lambda i: i IS NOT NULL)) AS issue FROM x) GROUP BY 1""")
def licence_issues(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size")
    lic = _pick(F.col("key"), *_LICENCES)
    decisions = p.select("key", F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("No").alias("ship"), lic.alias("license"))
    cache = p.where("key % 3 > 0").select("key", F.when(F.col("key") % 11 == 0, "CC-BY-SA").otherwise(lic).alias("license"), F.when(F.col("key") % 7 == 0, "acceptedVersion").otherwise("publishedVersion").alias("version"))
    return audit.licence_audit(decisions, cache)


@_c.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE 'old' || c_custkey END AS doi, c_custkey % 3 = 0 AS patched FROM customer""")
def doi_patch(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(".pdf")).alias("file_name"), F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("doi"))
    fixed = F.concat(F.lit("new"), F.col("c_custkey").cast("string"))
    near = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("shelf/"), F.regexp_replace("file_name", "#", " # "))).otherwise(F.concat(F.lit("shelf/"), "file_name"))
    return audit.patch(c, c.where("c_custkey % 3 = 0").select(near.alias("file_name"), fixed.alias("doi"))).select("c_custkey", "doi", "patched")


@_c.add("""WITH f AS (SELECT l_partkey AS key, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT p_partkey AS key, CASE WHEN first IS NULL THEN NULL WHEN first % 3 = 0 THEN ' ' ELSE 'on ' || first END AS abstract,
CASE WHEN first IS NULL THEN 'no_markdown' WHEN first % 3 = 0 THEN 'not_found' ELSE 'extracted' END AS abstract_status FROM part LEFT JOIN f ON key = p_partkey""")
def abstract_status(spark, sf):
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = F.when(line % 3 == 0, " ").otherwise(F.concat(F.lit("on "), line.cast("string")))
    files = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_partkey").alias("key"), F.lpad(line.cast("string"), 12, "0").alias("file_name"), text.alias("abstract"))
    return audit.metadata_table(table(spark, sf, "part").select(F.col("p_partkey").alias("key")), files)


@_c.add("""WITH p AS (SELECT p_partkey AS key, 'd' || p_partkey AS doi, p_type AS category, p_partkey % 7 <> 0 AS ok, ['gold', 'hybrid', 'green', 'closed'][p_partkey % 4 + 1] AS st, ['cc-by', 'cc-by-nc', '', 'cc-by-nd', 'public-domain'][p_size % 5 + 1] AS lic,
['publishedversion', 'acceptedversion'][p_size % 2 + 1] AS ver FROM part),
c AS (SELECT *, lic IN ('cc-by', 'public-domain') AS free, CASE WHEN key % 13 = 0 OR NOT ok THEN 'No' WHEN st IN ('gold', 'hybrid') AND lic IN ('cc-by', 'public-domain') THEN 'Yes' WHEN st IN ('gold', 'hybrid') AND lic <> '' THEN 'Maybe'
WHEN st = 'green' AND ver = 'publishedversion' AND lic IN ('cc-by', 'public-domain') THEN 'Yes' WHEN st = 'green' AND lic <> '' THEN 'Maybe' ELSE 'No' END AS redistribution FROM p)
SELECT category, key, doi, redistribution, CASE WHEN key % 2 = 1 THEN 'new' WHEN redistribution <> 'Maybe' THEN 'Maybe -> ' || redistribution ELSE '' END AS change FROM c""")
def open_access_report(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_type").alias("category"), "p_size")
    answers = p.where("key % 13 <> 0").select("doi", (F.col("key") % 7 != 0).alias("ok"), _pick(F.col("key"), "gold", "hybrid", "green", "closed").alias("oa_status"), _pick(F.col("p_size"), "cc-by", "cc-by-nc", "", "cc-by-nd", "public-domain").alias("license"), _pick(F.col("p_size"), "publishedVersion", "acceptedVersion").alias("version"))
    return audit.oa_report(p.drop("p_size"), answers, p.where("key % 2 = 0").select("key", F.lit("Maybe").alias("redistribution")))


@_c.add("""SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'empty' WHEN p_partkey % 3 = 0 THEN 'COLLISION' ELSE 'RECOVERABLE' END AS flag FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""")
def recovery_audit(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_name"))
    found = p.select("key", "file_name", F.lit(1).alias("rank"), (F.col("key") % 2 == 1).alias("surname_hit"), F.lit(0.75).alias("overlap"))
    taken = p.where("key % 3 = 0").select("file_name", (F.col("key") + 1).alias("key"))
    return audit.recovery_flags(p.select("key"), p.where("key % 5 = 0").select("key"), p.where("key % 7 = 0").select("key"), found, taken)


@_c.add("SELECT p_type AS category, CASE WHEN p_size % 3 = 0 THEN 'Yes' ELSE 'No' END AS ship, count(*) AS n FROM part GROUP BY ALL")
def ship_summary(spark, sf):
    return audit.ship_counts(table(spark, sf, "part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") % 3 == 0, "Yes").otherwise("No").alias("ship")))


@_c.add("""WITH s AS (SELECT lower(replace(s_name, 'Supplier#', '')) AS n, max(s_suppkey) AS s FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND a.s IS NOT NULL THEN 'name/' || a.s WHEN b.s IS NOT NULL THEN 'number/' || b.s END AS path
FROM customer LEFT JOIN s a ON a.n = replace(c_name, 'Customer#', '') LEFT JOIN s b ON b.s = c_custkey // 2""")
def key_probe(spark, sf):
    s = table(spark, sf, "supplier").withColumn("n", F.replace("s_name", F.lit("Supplier#"), F.lit("")))
    number = F.col("s_suppkey").cast("string")
    index = s.select(F.concat(F.lit("n"), "n").alias("key"), F.concat(F.lit("name/"), number).alias("path"), F.col("s_suppkey").alias("ord"))
    index = index.unionByName(s.select(number.alias("key"), F.lit("lost").alias("path"), F.lit(-1).cast("bigint").alias("ord"))).unionByName(s.select(number.alias("key"), F.concat(F.lit("number/"), number).alias("path"), F.col("s_suppkey").alias("ord")))
    by_name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("n"), F.replace("c_name", F.lit("Customer#"), F.lit("")))).otherwise("none")
    rows = table(spark, sf, "customer").select("c_custkey", F.array(F.lit("?"), by_name, F.floor(F.col("c_custkey") / 2).cast("string")).alias("keys"))
    return linkage.probe_keys(rows, index, "c_custkey", "keys")


@_c.add("""SELECT o_custkey AS key, list_sort(list_distinct(list(code))) AS codes FROM (SELECT o_custkey, l_suppkey AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, -1 FROM orders) GROUP BY 1""")
def role_codes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    said = o.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("code")), "o_orderkey").select("key", "code").distinct()
    return merge.role_union(said, o.select("key", F.lit(-1).cast("bigint").alias("focal")).distinct(), "key")


# --- places ------------------------------------------------------------------------------------------


@_c.add(f"""WITH {_EDGES} SELECT n_name AS code, CASE WHEN n_name = {_FOCAL} THEN 'intracoupling' WHEN e.a IS NOT NULL THEN 'pericoupling' ELSE 'telecoupling' END AS class
FROM (SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 < 2) LEFT JOIN e ON least(n_name, {_FOCAL}) = e.a AND greatest(n_name, {_FOCAL}) = e.b""")
def mentioned_classification(spark, sf):
    said = table(spark, sf, "supplier").join(table(spark, sf, "nation").where("n_nationkey % 3 < 2"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("code"))
    return graph.classify_mentioned(said, _focal(spark, sf), _edges(spark, sf))


@_c.add(f"WITH {_REGIONS} SELECT DISTINCT j::VARCHAR AS iso FROM p WHERE x = '3-BUILDING' UNION SELECT k::VARCHAR FROM r WHERE region = '3-BUILDING'")
def detail_countries(spark, sf):
    return graph.detail_countries("3-BUILDING", _region_edges(spark, sf), _regions(spark, sf))


#: Nations and their harbours by names of letters.
_LANDS = "l AS (SELECT n_nationkey AS k, n_name AS code, 'Isle ' || translate(n_nationkey::VARCHAR, '0123456789', 'abcdefghij') || 'land' AS land, 'Harbour ' || translate(n_nationkey::VARCHAR, '0123456789', 'abcdefghij') || 'port' AS port FROM nation)"


def _lands(spark, sf):
    letters = F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("code"), F.concat(F.lit("Isle "), letters, F.lit("land")).alias("land"), F.concat(F.lit("Harbour "), letters, F.lit("port")).alias("port"))


@_c.add(f"""WITH {_LANDS} SELECT c_custkey AS id, CASE WHEN c_custkey % 4 IN (1, 3) THEN port END AS place, CASE WHEN c_custkey % 4 < 2 OR c_custkey % 4 = 3 THEN land END AS country FROM customer JOIN l ON k = c_nationkey""")
def query_focus(spark, sf):
    """A country; a region in another country; nothing; a region beside a country that isn't its own."""
    lands = _lands(spark, sf)
    rows = table(spark, sf, "customer").join(lands, F.col("c_nationkey") == F.col("k"))
    m, other = F.col("c_custkey") % 4, F.lit(" to Isle aland")
    text = F.when(m == 0, F.concat(F.lit("Who buys wheat from "), "land", F.lit("'s farms?"))).when(m == 1, F.concat(F.lit("What do the mills of "), "port", F.lit(" sell?")))
    text = text.when(m == 2, "What do mills sell?").otherwise(F.concat("port", F.lit("'s wheat went by sea and rail"), other))
    names = lands.select("code", F.col("land").alias("name"))
    regions = lands.select(F.concat(F.lit("r-"), "code").alias("region"), F.col("port").alias("name"), F.col("code").alias("iso"))
    return gazetteer.focus(rows.select(F.col("c_custkey").alias("id"), text.alias("t")), ["id"], "t", regions, gazetteer.terms(names), names)


@_c.add(f"""WITH {_LANDS} SELECT DISTINCT s_suppkey AS id, unnest([a.code, b.code]) AS code FROM supplier JOIN l a ON a.k = s_nationkey JOIN l b ON b.k = (s_nationkey + s_suppkey) % 25""")
def country_list_scan(spark, sf):
    lands = _lands(spark, sf)
    rows = table(spark, sf, "supplier").join(lands.select("k", F.col("land").alias("a")), F.col("s_nationkey") == F.col("k")).drop("k")
    rows = rows.join(lands.select("k", F.col("land").alias("b")), (F.col("s_nationkey") + F.col("s_suppkey")) % 25 == F.col("k"))
    text = F.concat("a", _pick(F.col("s_suppkey"), "; ", " -> ", " and ", " / "), "b")
    return gazetteer.country_scan(rows.select(F.col("s_suppkey").alias("id"), text.alias("t")), ["id"], "t", gazetteer.terms(lands.select("code", F.col("land").alias("name"))))


# --- texts -------------------------------------------------------------------------------------------


@_c.add(f"""WITH w AS (SELECT p_partkey, list_transform(regexp_extract_all(replace(lower('How do exports of ' || p_name || ' and ' || p_type || ' from ' || p_name || ' mills affect Exampleland''s lakes'), 'exampleland''s', ' '), '[a-z][a-z''-]{{2,}}'), lambda x: regexp_replace(x, '''s$', '')) AS w FROM part),
k AS (SELECT p_partkey, list_filter(w, lambda x: NOT list_contains({sql_list((*L.QUERY_FILLER, *L.STRUCTURAL_TERMS, *L.TRADE_HINTS))}, x)) AS w FROM w)
SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS terms FROM k""")
def topic_terms(spark, sf):
    text = F.concat(F.lit("How do exports of "), "p_name", F.lit(" and "), "p_type", F.lit(" from "), "p_name", F.lit(" mills affect Exampleland’s lakes"))
    return table(spark, sf, "part").select("p_partkey", T.topic_terms(text, F.array(F.lit("Exampleland"), F.lit(None).cast("string"))).alias("terms"))


_ENTRIES = ("'Smith, A. B., Jones, C. ' || (1950 + p_size) || '. ' || p_name", "'Thesis on ' || p_name || ', University Press, pages 4-9'", "p_name || ' grew from ' || (1950 + p_size) || ' on'", "'1997. ' || p_name || ' journal'", "'(1999) ' || p_name || ' (2001) doi:10.1/' || p_partkey", "p_name || ' in a journal'")


@_c.add(f"SELECT p_partkey, p_partkey % 6 NOT IN (2, 5) AS is_reference FROM part -- {len(_ENTRIES)} forms: entries, but for a sentence with a year and one with a term")
def reference_passages(spark, sf):
    forms = F.array(*[F.expr(e) for e in _ENTRIES])
    return table(spark, sf, "part").select("p_partkey", T.is_reference_text(F.get(forms, (F.col("p_partkey") % 6).cast("int"))).alias("is_reference"))


@_c.add(r"""WITH t AS (SELECT doc_id, regexp_extract(text, '^[^.\n]*') || CASE doc_id % 4 WHEN 0 THEN ' City' WHEN 1 THEN ' capacity' WHEN 2 THEN ' river  basin' ELSE ' such as here' END AS t FROM documents)
SELECT doc_id, regexp_matches(t, '(?i)\b(?:city|cities|municipalit(?:y|ies)|municipal|town|village|watersheds?|(?:river\s+)?basin|protected\s+area|(?:national\s+)?nature\s+reserve|(?:national\s+)?park|reserve|conservation\s+area)\b') AS unsupported,
len(regexp_extract_all(lower(trim(t)), '[A-Za-z][A-Za-z''’-]*')) BETWEEN 1 AND 8 AND doc_id % 4 <> 3 AS direct FROM t""")
def location_predicates(spark, sf):
    t = F.concat(F.regexp_extract("text", r"^[^.\n]*", 0), _pick(F.col("doc_id"), " City", " capacity", " river  basin", " such as here"))
    return table(spark, sf, "documents").select("doc_id", T.names_unsupported_scope(t).alias("unsupported"), T.is_direct_location(t).alias("direct"))


@_c.add("""SELECT p_partkey, '&lt;' || p_name || ' &amp; &quot;' || lower(p_brand) || '&quot;&gt;' AS attribute, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' et al.' ELSE p_name || ' and ' || p_type END AS authors,
'10.1234/' || lower(p_type) || p_partkey AS doi, p_name AS owner, p_name || ' of ' || p_type || ' ' AS candidate FROM part""")
def field_cleaners(spark, sf):
    number = F.col("p_partkey").cast("string")
    many = F.concat("p_name", F.lit(" and "), F.repeat(F.lit("x"), F.lit(60)), F.lit(" and "), "p_type")
    return table(spark, sf, "part").select(
        "p_partkey", T.xml_attribute(F.concat(F.lit("<"), "p_name", F.lit(' & "'), F.lower("p_brand"), F.lit('">'))).alias("attribute"),
        T.short_authors(F.when(F.col("p_partkey") % 2 == 0, many).otherwise(F.concat("p_name", F.lit(" and "), "p_type"))).alias("authors"),
        T.doi_of(F.concat(_pick(F.col("p_partkey"), " https://doi.org/", "http://dx.doi.org/", "HTTPS://DOI.ORG/", ""), F.lit("10.1234/"), "p_type", number)).alias("doi"),
        T.without_possessive(F.concat("p_name", _pick(F.col("p_partkey"), "'s", "’s ", "", "'S"))).alias("owner"),
        T.clean_candidate(F.concat(F.lit("**"), "p_name", F.lit("** [W1]  of `"), "p_type", F.lit("`;."))).alias("candidate"),
    )
