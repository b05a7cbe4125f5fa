"""Retrieval, passages, citations and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import citations as C
from lodestrand.functions import lexicon as L
from lodestrand.functions import text as T
from lodestrand.operators import chunks, convo, evidence, index, merge, retrieve
from lodestrand.plans.common import Catalogue, sql_in, sql_list, table, tokens_sql

_c = Catalogue()
QUERIES, ORACLE = _c.queries, _c.oracle

QUESTION = "the other heed nation of interest and thering hand"

_TFIDF = f"""
tf AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, (1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1) AS w, ln((n + 1) / (df + 1)) + 1 AS idf FROM tf JOIN df USING (term), n),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS c FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM q) GROUP BY ALL),
qw AS (SELECT query_id, term, (1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1) AS qw FROM qt JOIN df USING (term), n),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS q_norm FROM qw GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(w * qw) / any_value(norm * q_norm), 9) AS score FROM qw JOIN w USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL)
"""
_ONE = f"q AS (SELECT 0::BIGINT AS query_id, '{QUESTION}' AS query)"
_DIVERSE = """
f AS (SELECT *, row_number() OVER (PARTITION BY paper, section ORDER BY score DESC, id) = 1 AS f FROM s2),
p AS (SELECT *, row_number() OVER (PARTITION BY paper, f ORDER BY score DESC, id) AS rn, sum(f::INT) OVER (PARTITION BY paper) AS nf FROM f),
k AS (SELECT *, CASE WHEN f THEN 1 ELSE 2 END AS pass FROM p WHERE (f AND rn <= 3) OR (NOT f AND rn <= 3 - least(nf, 3))),
r AS (SELECT *, row_number() OVER (ORDER BY pass, score DESC, id) AS rank FROM k)
"""


def _scores(spark: SparkSession, sf: str, queries: DataFrame, least: float = 0.01) -> DataFrame:
    return index.TfIdfIndex.build(table(spark, sf, "documents"), ["doc_id"]).scores(queries, min_score=least)


def _question(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUESTION).alias("query"))


@_c.add(f"WITH {_ONE}, {_TFIDF} SELECT doc_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score >= 0.01) WHERE rank <= 10")
def tfidf_topk(spark, sf):
    return retrieve.top_k(_scores(spark, sf, _question(spark)), 10, [], ["doc_id"]).select("doc_id", "score", "rank")


@_c.add(f"WITH {_ONE}, {_TFIDF}, s2 AS (SELECT s.doc_id AS id, source AS paper, lang AS section, score FROM s JOIN documents USING (doc_id) WHERE score >= 0.01), {_DIVERSE} SELECT id AS doc_id, paper AS source, section AS lang, score, pass::INT AS pass, rank::INT AS rank FROM r WHERE rank <= 20")
def tfidf_diverse_topk(spark, sf):
    scored = _scores(spark, sf, _question(spark)).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return retrieve.diverse_top_k(scored, 20, [], "source", "lang", ["doc_id"], 3, 0.01).select("doc_id", "source", "lang", "score", "pass", "rank")


@_c.add(f"WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_TFIDF} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score >= 0.05) WHERE rank <= 5")
def tfidf_multi_query(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.top_k(_scores(spark, sf, asked, 0.05), 5, ["query_id"], ["doc_id"]).select("query_id", "doc_id", "score", "rank")


_VEC = "s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings)"


def _vector_scores(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieve.vector_scores(rows, asked)


@_c.add(f"WITH {_VEC} SELECT vec_id, label, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score >= 0.3) WHERE rank <= 10")
def embedding_topk(spark, sf):
    return retrieve.top_k(_vector_scores(spark, sf).where("score >= 0.3"), 10, [], ["vec_id"]).select("vec_id", "label", "score", "rank")


@_c.add(f"WITH {_VEC}, s2 AS (SELECT vec_id AS id, label AS paper, vec_id % 4 AS section, score FROM s WHERE score >= -0.2), {_DIVERSE} SELECT id AS vec_id, paper AS label, section::INT AS section, score, pass::INT AS pass, rank::INT AS rank FROM r WHERE rank <= 15")
def embedding_diverse_topk(spark, sf):
    scored = _vector_scores(spark, sf).withColumn("section", (F.col("vec_id") % 4).cast("int"))
    return retrieve.diverse_top_k(scored, 15, [], "label", "section", ["vec_id"], 3, -0.2).select("vec_id", "label", "section", "score", "pass", "rank")


@_c.add(f"WITH {_VEC} SELECT CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.6 THEN 'Medium' WHEN score >= 0.5 THEN 'Low' ELSE 'Very Low' END AS confidence, count(*) AS n FROM s GROUP BY 1")
def retrieval_confidence_hist(spark, sf):
    return _vector_scores(spark, sf).groupBy(T.confidence(F.col("score"), "embeddings").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@_c.add(f"WITH {_VEC}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 50) SELECT label, max(score) AS best, arg_max(score, rank) AS last FROM t GROUP BY 1")
def paper_best_vs_last_score(spark, sf):
    ranked = retrieve.top_k(_vector_scores(spark, sf), 50, [], ["vec_id"])
    best, last = retrieve.paper_scores(ranked, "label"), retrieve.paper_scores(ranked, "label", "last")
    return best.withColumnRenamed("score", "best").join(last.withColumnRenamed("score", "last"), "label")


_VECS = "s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"
_DIVERSE_EACH = _DIVERSE.replace("(PARTITION BY paper", "(PARTITION BY query_id, paper").replace("(ORDER BY pass", "(PARTITION BY query_id ORDER BY pass")


def _all_vector_scores(spark, sf):
    """Every vector whose id is divisible by 20 against all vectors."""
    rows = table(spark, sf, "embeddings")
    return retrieve.vector_scores(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")))


@_c.add(f"WITH {_VECS} SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score >= 0.3) WHERE rank <= 10")
def embedding_topk_each(spark, sf):
    return retrieve.top_k(_all_vector_scores(spark, sf).where("score >= 0.3"), 10, ["query_id"], ["vec_id"]).select("query_id", "vec_id", "label", "score", "rank")


@_c.add(f"WITH {_VECS}, s2 AS (SELECT query_id, vec_id AS id, label AS paper, vec_id % 4 AS section, score FROM s WHERE score >= -0.2), {_DIVERSE_EACH} SELECT query_id, id AS vec_id, paper AS label, section::INT AS section, score, pass::INT AS pass, rank::INT AS rank FROM r WHERE rank <= 15")
def embedding_diverse_topk_each(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("section", (F.col("vec_id") % 4).cast("int"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieve.diverse_vector_top_k(rows, asked, 15, "label", "section", -0.2).select("query_id", "vec_id", "label", "section", "score", "pass", "rank")


@_c.add(f"WITH {_VECS} SELECT query_id, CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.6 THEN 'Medium' WHEN score >= 0.5 THEN 'Low' ELSE 'Very Low' END AS confidence, count(*) AS n FROM s GROUP BY ALL")
def retrieval_confidence_hist_each(spark, sf):
    return _all_vector_scores(spark, sf).groupBy("query_id", T.confidence(F.col("score"), "embeddings").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@_c.add(f"WITH {_VECS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 50) SELECT query_id, label, max(score) AS best, arg_max(score, rank) AS last FROM t GROUP BY ALL")
def paper_best_vs_last_score_each(spark, sf):
    ranked = retrieve.top_k(_all_vector_scores(spark, sf), 50, ["query_id"], ["vec_id"])
    best, last = (retrieve.paper_scores(ranked, "label", fold, ["query_id"]).withColumnRenamed("score", fold) for fold in ("best", "last"))
    return best.join(last, ["query_id", "label"])


@_c.add(f"SELECT term, count(*) AS df, sum(c)::BIGINT AS occurrences FROM (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY 1 ORDER BY df DESC, term LIMIT 50")
def token_df_top(spark, sf):
    counts = index.term_counts(table(spark, sf, "documents"), ["doc_id"])
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")).orderBy(F.desc("df"), "term").limit(50)


@_c.add(f"SELECT doc_id, len({tokens_sql('text')})::INT AS n_tokens, len(list_filter(list_distinct({tokens_sql('text')}), lambda w: NOT list_contains({sql_list(L.GENERIC_TOKENS)}, w)))::INT AS n_specific FROM documents")
def stopword_filtered_tf(spark, sf):
    words = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(T.specific(words)).alias("n_specific"))


_WORDS = r"string_split_regex(trim(regexp_replace(text, '[\s]+', ' ', 'g')), ' ')"


@_c.add(rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 250 THEN 1 ELSE ceil((len(w) - 250) / 200.0)::INT + 1 END)) AS i FROM d)
SELECT doc_id, i::INT AS i, len(list_slice(w, i * 200 + 1, i * 200 + 250))::INT AS n_words, md5(array_to_string(list_slice(w, i * 200 + 1, i * 200 + 250), ' ')) AS hash FROM i WHERE len(list_slice(w, i * 200 + 1, i * 200 + 250)) >= 30""")
def chunk_windows(spark, sf):
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks.windows(words)).alias("i", "w")).where(F.size("w") >= 30)
    return rows.select("doc_id", "i", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("hash"))


@_c.add(rf"SELECT source, count(*) AS docs, sum(len({_WORDS}))::BIGINT AS words, max(len({_WORDS}))::INT AS longest FROM documents GROUP BY 1")
def chunk_word_stats(spark, sf):
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(words).cast("bigint").alias("words"), F.max(words).alias("longest"))


@_c.add(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)https?://|doi[:/]')) AS url_lines, count(*) FILTER (regexp_matches(trim(line), '^((18|19|20)[0-9][0-9]|[0-9]{{3,}})\.') OR lower(trim(line)) IN {sql_in(L.REFERENCE_HEADINGS)}) AS reference_headings, count(*) AS lines FROM l GROUP BY 1""")
def reference_like_lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"(?i)https?://|doi[:/]")).alias("url_lines"), F.count_if(T.is_reference_heading(F.col("line"))).alias("reference_headings"), F.count(F.lit(1)).alias("lines"))


@_c.add(f"SELECT doc_id, length(regexp_replace(text, '[ \t\n\r\f\v]+$', ''))::INT AS kept FROM documents")
def truncate_at_marker(spark, sf):
    marked = F.concat("text", F.lit("\n## References\nTail "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.length(T.truncate_at_references(marked)).alias("kept"))


@_c.add(rf"""WITH a AS (SELECT list_filter(list_distinct({tokens_sql("'" + QUESTION + "'")}), lambda x: NOT list_contains({sql_list(L.GENERIC_TOKENS)}, x)) AS a),
d AS (SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS c FROM documents), w AS (SELECT doc_id, c, string_split(c, ' ') AS w FROM d WHERE length(c) > 300),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 16)) AS start FROM w),
t AS (SELECT doc_id, w, start, list_filter(list_distinct({tokens_sql("array_to_string(list_slice(w, start + 1, start + 50), ' ')")}), lambda x: NOT list_contains({sql_list(L.GENERIC_TOKENS)}, x)) AS tok FROM s),
o AS (SELECT doc_id, w, start, len(list_intersect(a, tok)) AS shared, len(tok) AS size FROM t, a),
b AS (SELECT doc_id, w, CASE WHEN max(shared) = 0 THEN 0 ELSE arg_min(start, (-shared, -shared / greatest(1, size)::DOUBLE, start)) END AS start FROM o GROUP BY ALL)
SELECT doc_id, start::INT AS start FROM (SELECT doc_id, start FROM b)""")
def best_excerpt(spark, sf):
    rows = table(spark, sf, "documents").where(F.length(T.squeeze(F.col("text"))) > 300)
    return rows.select("doc_id", T.excerpt_start(F.col("text"), F.lit(QUESTION)).alias("start"))


FINGERPRINT_GROUPS = 65_536


@_c.add("""WITH h AS (SELECT substr(md5(doc_id::VARCHAR), 1, 4) AS g, sha256(concat_ws(chr(31), doc_id::VARCHAR, source)) AS h FROM documents),
l AS (SELECT g, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY g)) AS fingerprint FROM l""")
def chunk_fingerprint(spark, sf):
    return chunks.fingerprint(table(spark, sf, "documents"), ["doc_id"], ["source"], FINGERPRINT_GROUPS)


@_c.add("SELECT p_partkey, substr(sha256(concat_ws(chr(31), p_name, p_brand, p_type, p_size::VARCHAR)), 1, 20) AS cache_key FROM part")
def cache_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.cache_key(*map(F.col, ("p_name", "p_brand", "p_type", "p_size"))).alias("cache_key"))


# --- citations -----------------------------------------------------------------------------------

_CITED = "coalesce(text, '') || ' [' || (conv_id % 5) || '] and [' || (turn % 7) || '], see [W1] [' || (conv_id % 5) || '].'"


def _cited_turns(spark, sf):
    say = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("conv_id") % 5).cast("string"), F.lit("] and ["), (F.col("turn") % 7).cast("string"), F.lit("], see [W1] ["), (F.col("conv_id") % 5).cast("string"), F.lit("]."))
    return table(spark, sf, "conversations").select("conv_id", "turn", say.alias("t"))


def _tidy_sql(t: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), ' +([.,;:!?)])', '\1', 'g'), '(?m) +$', '', 'g')"


@_c.add(rf"""WITH c AS (SELECT conv_id, turn, {_CITED} AS t FROM conversations), i AS (SELECT conv_id, turn, t, list_distinct(list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: x::BIGINT)) AS ids FROM c)
SELECT conv_id, turn, {_tidy_sql("regexp_replace(t, '\\[(0+|0*[4-9]|0*[1-9][0-9]+)\\]', '', 'g')")} AS clean, list_sort(list_filter(ids, lambda x: x < 1 OR x > 3)) AS invalid FROM i""")
def citation_sanitize(spark, sf):
    s = C.sanitized(F.col("t"), F.lit(3))
    return _cited_turns(spark, sf).select("conv_id", "turn", s["text"].alias("clean"), s["invalid_ids"].alias("invalid"))


@_c.add(rf"""WITH c AS (SELECT conv_id, turn, {_CITED} AS t FROM conversations)
SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: x::BIGINT))) AS ids FROM c""")
def citation_extract(spark, sf):
    return _cited_turns(spark, sf).select("conv_id", "turn", F.array_sort(C.cited_ids(F.col("t"))).alias("ids"))


@_c.add(rf"""WITH c AS (SELECT conv_id, turn, {_CITED} AS t FROM conversations),
p AS (SELECT conv_id, turn, regexp_split_to_array(t, '\[\d+\]') AS pieces, list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: x::BIGINT) AS ids FROM c),
k AS (SELECT *, list_transform(ids, lambda x: len(list_distinct(ids[1:list_position(ids, x)]))) AS nos FROM p)
SELECT conv_id, turn, pieces[1] || coalesce(array_to_string(list_transform(range(1, len(ids) + 1), lambda i: '[' || nos[i] || ']' || pieces[i + 1]), ''), '') AS answer FROM k""")
def citation_renumber(spark, sf):
    return _cited_turns(spark, sf).select("conv_id", "turn", C.renumbered(F.col("t"), F.lit(99)).alias("answer"))


@_c.add()
def evidence_annotation(spark, sf):
    """Every benchmark item as a report of one paper collection: its sentences are lines, the five best documents its passages."""
    items = table(spark, sf, "benchmark")
    ranked = retrieve.top_k(_scores(spark, sf, items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 0.05), 5, ["query_id"], ["doc_id"])
    passages = ranked.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(F.col("query_id").alias("item_id"), F.col("rank").alias("n"), "text", "score")
    return evidence.annotate(items.select("item_id", F.regexp_replace("text", r"\. ", ".\n").alias("text")), passages, "item_id").select("item_id", "added", F.md5("text").alias("hash"))


@_c.add()
def web_annotation(spark, sf):
    """Turns of conversations as reports, the titles of their own words as snippets."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.regexp_replace("text", r"\. ", ".\n").alias("text"))
    snippets = turns.select("id", F.lit(1).alias("n"), F.lit("").alias("title"), F.substring("text", 1, 200).alias("snippet"))
    return evidence.annotate_web(turns, snippets, "id").select("id", "added", F.md5("text").alias("hash"))


@_c.add(rf"SELECT item_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]+'), lambda w: length(w) > 3 AND NOT list_contains({sql_list(L.TEXT_TERM_STOPWORDS)}, w))))::INT AS n_terms FROM benchmark")
def search_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(T.search_terms(F.col("text"))).alias("n_terms"))


@_c.add(rf"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*') AS w FROM benchmark),
p AS (SELECT item_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([4, 3, 2, 1]) AS k)))
SELECT item_id, count(*) AS n, arg_min(p, (-k, i)) AS first FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id, lower(p) ORDER BY k DESC, i) = 1) GROUP BY 1""")
def ngram_phrases(spark, sf):
    p = T.phrases(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", p.alias("p")).select("item_id", F.size("p").cast("bigint").alias("n"), F.get("p", F.lit(0)).alias("first"))


@_c.add(rf"SELECT item_id, list_has_any(regexp_extract_all(lower(text), '[a-z]+'), {sql_list(L.TRADE_HINTS)}) AS trade, 1::INT + (CASE WHEN list_has_any(regexp_extract_all(lower(text), '[a-z]+'), {sql_list(L.TRADE_HINTS)}) THEN 1 ELSE 0 END)::INT AS at_least FROM benchmark")
def query_expansion(spark, sf):
    q = T.expanded_queries(F.col("text"), F.lit("Nowhere"), F.lit(None).cast("string"), F.array().cast("array<string>"))
    return table(spark, sf, "benchmark").select("item_id", T.has_trade_intent(F.col("text")).alias("trade"), F.when(F.size(q) > 1, 2).otherwise(1).alias("at_least"))


@_c.add("SELECT event_id, greatest(0.0, least(1.0, coalesce(value, 0.0)))::DOUBLE AS confidence FROM events")
def confidence_clamp(spark, sf):
    return table(spark, sf, "events").select("event_id", T.clamp(F.col("value").cast("string")).alias("confidence"))


@_c.add("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf, "events").select("event_id", F.get_json_object(T.json_object(wrapped), "$.k").cast("bigint").alias("k"))


# --- conversations ---------------------------------------------------------------------------------


@_c.add("""WITH u AS (SELECT conv_id, turn, text, row_number() OVER w AS n, first_value(text) OVER w AS f FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN n = 1 THEN text ELSE 'Original question: ' || f || chr(10) || 'Refinement: ' || text END AS query FROM u""")
def merged_query(spark, sf):
    return convo.merged_queries(table(spark, sf, "conversations"))


@_c.add("""SELECT conv_id, turn, role, count(*) OVER w AS history_len, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS history_chars, count(*) FILTER (role = 'assistant') OVER v AS turn_count
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def conversation_prefix(spark, sf):
    return convo.prefixes(table(spark, sf, "conversations")).drop("text")


@_c.add("SELECT conv_id, coalesce(sum(length(text)), 0)::BIGINT AS chars, (coalesce(sum(length(text)), 0) // 4)::BIGINT AS tokens, coalesce(sum(length(text)), 0) > 480000 AS \"over\" FROM conversations GROUP BY 1")
def token_budget(spark, sf):
    return convo.token_budget(table(spark, sf, "conversations"))


# --- web results and pages ---------------------------------------------------------------------------


@_c.add("""WITH b AS (SELECT page_id % 10 AS q, 0 AS backend, page_id, url FROM pages UNION ALL SELECT page_id % 10, 1, page_id, upper(url) || '/' FROM pages),
k AS (SELECT *, regexp_replace(lower(trim(url)), '/+$', '') AS k FROM b),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY q, k ORDER BY backend, page_id) = 1)
SELECT q, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY backend, page_id)::INT AS rank FROM d) WHERE rank <= 6""")
def fanout_merge_topup(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") % 10).alias("q"), F.lit(0).alias("backend"), "page_id", F.lit("").alias("title"), F.lit("").alias("snippet"), "url")
    both = pages.unionByName(pages.withColumn("backend", F.lit(1)).withColumn("url", F.concat(F.upper("url"), F.lit("/"))))
    return merge.merge_results(both, ["q"], ["backend", "page_id"], merge.fan_out_cap(8)).select("q", "rank", "url")


@_c.add("SELECT page_id, regexp_replace(lower(trim(url)), '/+$', '') AS k FROM pages")
def url_normalise(spark, sf):
    empty = F.lit("")
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(T.result_key(empty, empty, F.col("url")), "^url:", "").alias("k"))


@_c.add("SELECT page_id, url AS target FROM pages")
def url_param_decode(spark, sf):
    from lodestrand.sources.web import redirect_target

    wrapped = F.concat(F.lit("//duck.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    return table(spark, sf, "pages").select("page_id", redirect_target(wrapped).alias("target"))


@_c.add(r"""SELECT page_id, count(*) AS n, string_agg(h, ' ' ORDER BY i) AS hrefs FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href=[''"]([^''"]*)[''"][^>]*>.*?</a>', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?href=[''"]([^''"]*)[''"][^>]*>.*?</a>', 1), 1) AS i FROM pages) GROUP BY 1""")
def link_extract(spark, sf):
    from lodestrand.sources.web import links

    rows = links(table(spark, sf, "pages"), "page_id", "html")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "href"))), lambda x: x["href"]), " ").alias("hrefs"))


@_c.add(r"SELECT page_id, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'))::INT AS headings, len(regexp_extract_all(html, '(?is)<p[^a-z>]*>'))::INT AS paragraphs FROM pages")
def html_heading_sections(spark, sf):
    count = lambda p: F.size(T.all_matches(F.col("html"), p))
    return table(spark, sf, "pages").select("page_id", count(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>").alias("headings"), count(r"(?is)<p[^a-z>]*>").alias("paragraphs"))

