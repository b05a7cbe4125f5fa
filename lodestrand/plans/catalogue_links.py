"""Linkage, audits, ranking, licences, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import audit, linkage, rank
from lodestrand.plans.common import Catalogue, table

_c = Catalogue()
QUERIES, ORACLE = _c.queries, _c.oracle

#: Parts as papers: type and name words are keywords, line items citations.
_PAPERS = """cited AS (SELECT l_partkey AS p_partkey, count(*) AS cited_by FROM lineitem GROUP BY 1),
papers AS (SELECT p_partkey, p_name AS title, list_transform(string_split(p_type, ' '), lambda x: lower(x)) AS keywords, coalesce(cited_by, 0) AS cited_by, 1990 + p_size AS year FROM part LEFT JOIN cited USING (p_partkey))"""


def _papers(spark, sf):
    cited = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("cited_by"))
    p = table(spark, sf, "part").join(cited, "p_partkey", "left")
    return p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.transform(F.split("p_type", " "), F.lower).alias("keywords"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"), (F.col("p_size") + 1990).alias("year"), F.col("p_brand").alias("authors"))


@_c.add(f"""WITH {_PAPERS}, q AS (SELECT unnest(['steel', 'small', 'part', 'brushed']) AS term),
s AS (SELECT p_partkey, cited_by, year, round(3.0 * (SELECT count(*) FROM q WHERE len(list_filter(keywords, lambda k: contains(k, term) OR contains(term, k))) > 0) + 2.0 * (SELECT count(*) FROM q WHERE contains(lower(title), term)) + CASE WHEN cited_by > 0 THEN least(2.0, log10(cited_by + 1)) ELSE 0 END, 9) AS score FROM papers)
SELECT p_partkey AS key, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cited_by DESC, year DESC, p_partkey)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20""")
def literature_rank(spark, sf):
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.array(*map(F.lit, ("steel", "small", "part", "brushed"))).alias("terms"))
    return rank.recommend(_papers(spark, sf), asked, 20).select("key", "score", "rank")


@_c.add("""WITH s AS (SELECT p_partkey AS ord, 2.0 * len(list_filter(string_split(p_name, ' '), lambda w: contains('large brass items of economy', lower(w)))) + 1.5 * len(list_filter([p_type], lambda d: contains('large brass items of economy', lower(d)))) AS score FROM part)
SELECT ord, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, ord)::INT AS rank FROM s QUALIFY rank <= 5""")
def example_selection(spark, sf):
    examples = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.split("p_name", " ").alias("keywords"), F.col("p_type").alias("domain"))
    return rank.select_examples(examples, "Large brass items of economy", 5).select("ord", "score", "rank")


@_c.add(f"WITH {_PAPERS} SELECT count(*) AS total_papers, count(*) FILTER (len(keywords) > 0) AS with_keywords, min(year)::INT AS year_min, max(year)::INT AS year_max, sum(cited_by)::BIGINT AS total_citations FROM papers")
def db_summary(spark, sf):
    return rank.database_summary(_papers(spark, sf))


_SET = "list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({0}), '[^a-z0-9\\s_]', '', 'g')), '\\s+'), lambda w: w <> ''))"


@_c.add(f"""WITH a AS (SELECT p_partkey AS k1, p_size AS y1, {_SET.format('p_name')} AS w1 FROM part WHERE p_partkey % 20 = 0), b AS (SELECT p_partkey AS k2, p_size AS y2, {_SET.format('p_name')} AS w2 FROM part),
s AS (SELECT k1, k2, round(len(list_intersect(w1, w2)) / len(list_distinct(list_concat(w1, w2)))::DOUBLE + least(0.2, 0.05 * 1), 9) AS score FROM a JOIN b ON abs(y1 - y2) <= 1)
SELECT 'part - ' || (1990 + y1) || ' - ' || p.p_name || '.md' AS file_name, arg_min(k2, (-score, k2)) AS key, max(score) AS score FROM s JOIN a USING (k1) JOIN part p ON p.p_partkey = k1 WHERE score >= 0.3 GROUP BY ALL""")
def near_title_linkage(spark, sf):
    papers = _papers(spark, sf).withColumn("authors", F.lit("part"))
    files = papers.where("key % 20 = 0").select(F.concat(F.lit("part - "), F.col("year").cast("string"), F.lit(" - "), "title", F.lit(".md")).alias("file_name")).distinct()
    return linkage.match_files(files, papers)


@_c.add(r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS v FROM benchmark),
x AS (SELECT doc_id, w, unnest(w) AS t FROM d), y AS (SELECT item_id, v, unnest(v) AS t FROM b),
p AS (SELECT doc_id, item_id, count(*) AS k, len(any_value(w)) AS n, len(any_value(v)) AS m FROM x JOIN y USING (t) GROUP BY ALL)
SELECT item_id, doc_id, round(k / least(n, m)::DOUBLE, 6) AS overlap, round(k / (n + m - k)::DOUBLE, 6) AS jaccard FROM p WHERE k / least(n, m)::DOUBLE >= 0.5 AND least(n, m) >= 5""")
def benchmark_overlap_linkage(spark, sf):
    words = lambda: F.array_distinct(T.all_matches(F.lower("text"), "[a-z]{4,}"))
    d = table(spark, sf, "documents").select("doc_id", words().alias("w")).select("doc_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    b = table(spark, sf, "benchmark").select("item_id", words().alias("v")).select("item_id", F.size("v").alias("m"), F.explode("v").alias("t"))
    p = d.join(b, "t").groupBy("doc_id", "item_id", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    low = F.least("n", "m")
    return p.where((F.col("k") / low >= 0.5) & (low >= 5)).select("item_id", "doc_id", F.round(F.col("k") / low, 6).alias("overlap"), F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))


@_c.add("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def unlinked_docs(spark, sf):
    return audit.unmatched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@_c.add("SELECT d.doc_id, d.source FROM documents d SEMI JOIN labels l USING (doc_id)")
def linked_docs(spark, sf):
    return audit.matched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@_c.add("WITH k AS (SELECT doc_id, md5(text) AS key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY key) AS n FROM k) SELECT key, n, list_sort(list(doc_id) FILTER (r <= 5)) AS items FROM r WHERE n > 1 GROUP BY ALL")
def duplicate_key_audit(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "documents"), F.md5("text"), "doc_id")


@_c.add("SELECT key, n, doc_id FROM (SELECT doc_id, md5(text) AS key, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def duplicate_key_members(spark, sf):
    return audit.duplicate_members(table(spark, sf, "documents"), F.md5("text"), "doc_id")


@_c.add("SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN quality = 1 AND toxic = 1 THEN 'conflict' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_consistency_audit(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("l", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("l").isNull(), "unlabelled").when((F.col("quality") == 1) & (F.col("toxic") == 1), "conflict").when(F.col("quality") == 1, "good").otherwise("poor")
    return audit.outcomes(rows.select(status.alias("status")), "status")


@_c.add("WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT lang, count(*) AS n, list_sort(list(doc_id) FILTER (r <= 5)) AS samples FROM r GROUP BY 1")
def licence_inventory(spark, sf):
    return audit.inventory(table(spark, sf, "documents"), "lang", "doc_id")


# --- licences: attributes of parts stand in --------------------------------------------------------------

_LIC = """a AS (SELECT p_partkey, (ARRAY['cc-by', 'cc-by-nd', 'cc-by-nc', '', 'other', 'cc0'])[p_partkey % 6 + 1] AS lic, (ARRAY['gold', 'green', 'bronze', 'closed', 'hybrid'])[p_partkey % 5 + 1] AS st,
CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '10.1/' || p_partkey END AS doi, (ARRAY['publishedVersion', 'acceptedVersion', ''])[p_partkey % 3 + 1] AS ver FROM part)"""


def _licences(spark, sf):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", pick(("cc-by", "cc-by-nd", "cc-by-nc", "", "other", "cc0"), 6).alias("lic"), pick(("gold", "green", "bronze", "closed", "hybrid"), 5).alias("st"),
        F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).alias("doi"), pick(("publishedVersion", "acceptedVersion", ""), 3).alias("ver"),
    )


@_c.add(f"""WITH {_LIC} SELECT p_partkey, CASE WHEN doi <> '' AND lic IN ('cc-by', 'cc-by-nc', 'cc0') AND (st IN ('gold', 'hybrid') OR (st = 'green' AND ver = 'publishedVersion')) THEN 'Yes' ELSE 'No' END AS ship,
CASE WHEN doi = '' THEN 'No DOI' WHEN lic IN ('cc-by', 'cc-by-nc', 'cc0') THEN CASE WHEN st IN ('gold', 'hybrid') THEN st || ' OA, ' || lic WHEN st = 'green' AND ver = 'publishedVersion' THEN 'green OA published version, ' || lic
 WHEN st = 'green' THEN 'green OA but only ' || CASE WHEN ver = '' THEN 'unknown' ELSE lower(ver) END || ' version available' ELSE 'OA status ' || st || ' unclear despite license ' || lic END
 WHEN lic = 'cc-by-nd' THEN 'ND license (cc-by-nd) prohibits derivative chunks/embeddings' WHEN st = 'bronze' THEN 'bronze OA, free to read but no license to redistribute' WHEN st = 'closed' THEN 'closed access (subscription only)'
 WHEN st = 'green' THEN 'green OA without permissive license (' || CASE WHEN lic = '' THEN 'none' ELSE lic END || ')' WHEN lic <> '' THEN 'non-permissive license (' || lic || ')' ELSE 'no license info, oa_status=' || st END AS reason FROM a""")
def license_decision(spark, sf):
    d = T.ship_decision(F.col("lic"), F.col("st"), F.col("doi"), F.col("ver"))
    return _licences(spark, sf).select("p_partkey", d["ship"].alias("ship"), d["reason"].alias("reason"))


@_c.add(f"""WITH {_LIC} SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'No' WHEN st IN ('gold', 'hybrid') THEN CASE WHEN lic IN ('cc-by', 'cc0') THEN 'Yes' WHEN lic <> '' THEN 'Maybe' ELSE 'No' END
WHEN st = 'green' THEN CASE WHEN lic IN ('cc-by', 'cc0') AND ver = 'publishedVersion' THEN 'Yes' WHEN lic IN ('cc-by', 'cc0', 'cc-by-nd', 'cc-by-nc') THEN 'Maybe' ELSE 'No' END ELSE 'No' END AS class FROM a""")
def redistribution_class(spark, sf):
    return _licences(spark, sf).select("p_partkey", T.redistribution_class(F.col("p_partkey") % 13 != 0, F.col("st"), F.col("lic"), F.col("ver")).alias("class"))


# --- keywords, sources, names ------------------------------------------------------------------------------

_KW = "list_sort(list_distinct(list_transform(string_split({0}, ' '), lambda x: lower(trim(x)))))"


@_c.add(f"""WITH k AS (SELECT p_partkey, {_KW.format('p_type')} AS a, {_KW.format("p_name || ' ' || p_type")} AS b FROM part)
SELECT p_partkey, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS missing, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS extra, round(len(list_intersect(a, b)) / len(b)::DOUBLE, 6) AS coverage FROM k""")
def keyword_set_diff(spark, sf):
    ours, theirs = T.keyword_set(F.col("p_type"), " "), T.keyword_set(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, sf, "part").select("p_partkey", audit.keyword_diff(ours, theirs).alias("d")).select("p_partkey", "d.*")


@_c.add("""SELECT CASE WHEN p_partkey % 10 = 0 THEN 'no_file' WHEN p_partkey % 7 = 0 THEN 'partial' ELSE 'ok' END AS issue, count(*) AS n FROM part GROUP BY 1""")
def coverage_audit(spark, sf):
    p = table(spark, sf, "part")
    papers = p.select(F.col("p_partkey").alias("key"), F.array(F.lit("a"), F.lit("b")).alias("keywords"))
    wanted = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("b"))).alias("keywords"))
    files = p.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("key"))
    return audit.outcomes(audit.coverage_issues(papers, wanted, files), "issue")


@_c.add("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'b' || doc_id WHEN doc_id % 5 = 0 THEN 's' || doc_id END AS doi,
CASE WHEN doc_id % 3 = 0 THEN 'cache' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'bib' WHEN doc_id % 5 = 0 THEN 'pdf_scan' ELSE 'not_found' END AS doi_source FROM documents""")
def best_source_coalesce(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    some = lambda cond, letter: d.where(cond).select("doc_id", F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("doi"))
    return audit.best_source(d, some("doc_id % 3 = 0", "c"), some("doc_id % 3 = 1 and doc_id % 2 = 0", "b"), some("doc_id % 5 = 0", "s"), "doc_id")


@_c.add("SELECT CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 0 THEN 'deleted' WHEN p_partkey % 4 = 0 THEN 'noop' WHEN p_partkey % 4 = 1 AND p_partkey % 3 <> 0 THEN 'replaced' WHEN p_partkey % 4 = 1 THEN 'inserted' ELSE 'noop' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def outcome_counts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    papers = p.select("key", F.when(F.col("key") % 3 != 0, "old").alias("keywords"))
    todo = p.where("key % 4 < 2").select("key", F.lit(0).alias("ord"), F.when(F.col("key") % 4 == 0, "NA").otherwise("new").alias("keywords"))
    return audit.outcomes(audit.apply_directives(papers, todo), "outcome")


@_c.add("""SELECT 'Customer ' || lpad(c_custkey::VARCHAR, 9, '0') || ' report.pdf' AS a, 'customer_' || lpad(c_custkey::VARCHAR, 9, '0') || '_report.md' AS b, 'exact' AS how FROM customer""")
def prefix_reconcile(spark, sf):
    c = table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("n"))
    return linkage.prefix_reconcile(c.select(F.concat(F.lit("Customer "), "n", F.lit(" report.pdf")).alias("a")), c.select(F.concat(F.lit("customer_"), "n", F.lit("_report.md")).alias("b")), "a", "b")


@_c.add(r"""WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda w: length(w) >= 4)) AS b, list_distinct(list_filter(string_split(lower(p_name || ' ' || split_part(p_type, ' ', 1)), ' '), lambda w: length(w) >= 4)) AS a FROM part)
SELECT p_partkey, CASE WHEN len(b) > 0 THEN round(len(list_intersect(a, b)) / len(b)::DOUBLE, 6) ELSE 0 END::DOUBLE AS share FROM w""")
def title_overlap_check(spark, sf):
    return table(spark, sf, "part").select("p_partkey", audit.title_overlap(F.concat_ws(" ", "p_name", F.get(F.split("p_type", " "), F.lit(0))), F.col("p_type")).alias("share"))


@_c.add("""WITH k AS (SELECT c_custkey, c_mktsegment || '_' || c_nationkey || '_' || (c_custkey % 7) AS base FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS n FROM k)
SELECT c_custkey, CASE WHEN n = 1 THEN base WHEN n <= 27 THEN base || '_' || chr((95 + n)::INT) ELSE base || '_' || (n - 1) END AS unique_key FROM n""")
def key_uniqueness_suffix(spark, sf):
    base = F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 7).cast("string"))
    return linkage.unique_keys(table(spark, sf, "customer").withColumn("base", base), "base", ["c_custkey"]).select("c_custkey", "unique_key")


@_c.add("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def paging(spark, sf):
    return audit.page(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100, 50)


# --- bibliographies ------------------------------------------------------------------------------------------


def _bib(spark, sf):
    """Every part as an entry, in files of a brand each."""
    title = F.concat(F.lit("{The} "), "p_name", F.lit(" of $\\mathrm{CO}_{2}$"))
    raw = F.concat(F.lit("@article{part"), F.col("p_partkey").cast("string"), F.lit(",\n  title = {"), title, F.lit("},\n  author = {"), "p_brand", F.lit("},\n  year = {"), (F.col("p_size") + 1990).cast("string"), F.lit("},\n  keywords = {"), F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit("},\n  annote = {Cited by: "), F.col("p_size").cast("string"), F.lit("}\n}\n"))
    return table(spark, sf, "part").select("p_partkey", raw.alias("text"))


@_c.add(r"SELECT 'part' || p_partkey AS key, 'The ' || p_name || ' of $\mathrmCO_2$' AS title, p_brand AS authors, (p_size + 1990)::INT AS year, list_sort(list_distinct(string_split(lower(p_type), ' '))) AS keywords, p_size::INT AS cited_by FROM part")
def bibtex_parse(spark, sf):
    from lodestrand.sources import bibtex

    papers = bibtex.parse(bibtex.split_entries(_bib(spark, sf), "p_partkey", "text"))
    return papers.select("key", "title", "authors", "year", F.array_sort("keywords").alias("keywords"), "cited_by")


@_c.add("SELECT 'part' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN ['new'] ELSE [] END AS keywords FROM part")
def bib_rewrite(spark, sf):
    from lodestrand.sources import bibtex

    rows = bibtex.split_entries(_bib(spark, sf), "p_partkey", "text")
    rows = rows.withColumn("raw", bibtex.with_keywords(F.col("raw"), F.when(F.col("p_partkey") % 2 == 0, "new")))
    return bibtex.parse(rows).select("key", "keywords")
