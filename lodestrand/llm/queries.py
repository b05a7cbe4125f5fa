"""The ten operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import bpe, exact_dedup, language_id, mixing, ngram_join, search, sharding, token_counts, url_filter, warc

RANKS = "byte_bpe_50k.tiktoken"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words that name unwanted hosts: a url with one of them in its host is a labelled example to block, any other one to allow.
SEED_WORDS = ("spam", "pills", "casino", "bets", "track")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = url_filter.host_of(F.col("url"))
    labelled = pages.select("url", host.rlike("|".join(SEED_WORDS)).cast("int").alias("label"))
    return url_filter.judge(pages, url_filter.train(labelled), URL_RULES)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_sets(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.dedup_roundtrip(table(spark, sf_dir, "pages")).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 as a query to all documents; itself is among those found."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10, query_id="query_id")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.scripted_edits(table(spark, sf_dir, "documents"))
    return token_counts.count_with_edits(edited, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("mix.rate", 6).alias("rate"), "mix.n_copies", "mix.copy", "mix.shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_byte_bpe, op3_ngram_jaccard, op4_warc_revisits, op5_bm25_topk, op6_rendezvous_shards, op7_exact_dedup, op8_edit_token_counts, op9_language_id, op10_poisson_mix)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op4_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d JOIN f USING (payload_digest)""",
    "op5_bm25_topk": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM tf WHERE doc_id % 20 = 0),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), g GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10""",
    "op6_rendezvous_shards": """
WITH t AS (SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, coalesce(doc_id::VARCHAR, 'null') AS name FROM documents),
n AS (SELECT doc_id, name, len(h) // 2 + 1 AS size,
             flatten(list_transform(range(1, len(h), 2), lambda i: [instr('123456789ABCDEF', substr(h, i + 1, 1)), instr('123456789ABCDEF', substr(h, i, 1))])) AS nibbles FROM b),
d AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(list_prepend(4294967295, nibbles), lambda c, x: xor(c >> 4, t[(xor(c, x) & 15) + 1])))::BIGINT AS text_crc32,
             list_transform(range(9), lambda i: substr(md5(name || ':' || i), 1, 13)) AS draws FROM n, t),
s AS (SELECT *, list_position(draws[1:8], list_max(draws[1:8])) - 1 AS shard, list_position(draws, list_max(draws)) - 1 AS grown FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown::INT AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot FROM s""",
    "op7_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op10_poisson_mix": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r),
cdf AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
d AS (SELECT doc_id, u.source, any_value(text) AS text, any_value(rate) AS rate, (count(*) FILTER (cdf <= u))::INT AS n_copies
      FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id, u.source)
SELECT doc_id, source, round(rate, 6) AS rate, n_copies, copy::INT AS copy, md5('order42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM d WHERE n_copies > 0)""",
}
