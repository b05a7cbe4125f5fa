import hashlib
from collections import Counter

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.ORACLE[name])


def test_contract_columns(spark):
    want = {
        "op1_url_filter": "page_id host path rule verdict", "op2_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op3_ngram_jaccard": "doc_id n_shingles component_id",
        "op4_warc_revisits": "page_id payload_bytes payload_digest record_type refers_to", "op6_rendezvous_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op9_language_id": "doc_id held_out lang_pred score",
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns[: len(columns.split())] == columns.split(), name


def test_bpe_query_against_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    from lodestrand.llm.bpe import load_ranks

    with open(P.path(queries.RANKS), "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(f.read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.op2_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_against_brute_force(spark):
    """Every stage done again in plain Python on the rows before it, tokens included."""
    import public_tokenizers as P
    import tiktoken
    from test_exact_and_mix import inverse, lower, uniform
    from test_models import brute_languages
    from test_ngram_join import brute

    from lodestrand.llm.bpe import load_ranks

    rows = {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}
    found = brute_languages([(i, r["text"], r["lang"]) for i, r in rows.items()])
    least = lambda told: max(corpus_pipeline.LEAST_SCORE, min(corpus_pipeline.ENOUGH, corpus_pipeline.RISE * told**0.5))
    kept = {i: rows[i] for i, (lang, score, told) in found.items() if lang != "und" and score >= least(told)}
    assert len(kept) > 0.97 * len(rows)
    first = {}
    for i in sorted(kept):
        first.setdefault(lower(kept[i]["text"]), i)
    kept = {i: kept[i] for i in first.values()}
    near = brute([(i, r["text"]) for i, r in kept.items()])
    kept = {i: kept[i] for i, _, c in near if i == c}
    n = Counter(r["source"] for r in kept.values())
    total = sum(x**0.5 for x in n.values())
    want = Counter({i: inverse(uniform(42, i), n[r["source"]] ** 0.5 * (len(kept) / total) / n[r["source"]]) for i, r in kept.items()})
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == +want
    with open(P.path(queries.RANKS), "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(f.read()), special_tokens={})
    for r in out:
        ids = reference.encode_ordinary(rows[r["doc_id"]]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stages_keep_the_columns(spark):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_nothing_else_imports_the_operators():
    import pathlib

    top = pathlib.Path(queries.__file__).parents[2]
    for p in top.rglob("*.py"):
        if "llm" not in p.parts and p.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert "lodestrand.llm" not in p.read_text(), p
