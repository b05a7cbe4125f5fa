"""The whole job: nothing is left out by a filter, a cap or a sample."""

import random
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import mixing, queries, store, url_filter

SF = "/root/testdata/sf0.001"


def test_every_twentieth_document_is_a_query(spark):
    got = queries.QUERIES["op5_bm25_topk"](spark, SF).toPandas()
    asked = queries.table(spark, SF, "documents").where("doc_id % 20 = 0 and text rlike '[a-zA-Z]'").toPandas()
    assert len(asked) >= 10 and set(got.query_id) == set(asked.doc_id)
    assert (got.groupby("query_id")["rank"].max() == 10).mean() > 0.8


def test_texts_in_no_learned_language_go(spark):
    """Unlearned scripts and random letters, in texts of 20 words and more; short clean texts stay."""
    rng = random.Random(5)
    spans = {"Cyrillic": (0x430, 0x44F), "Greek": (0x3B1, 0x3C9), "Georgian": (0x10D0, 0x10F0), "Han": (0x4E00, 0x9F00), "Latin": (0x61, 0x7A)}
    words = lambda span, n: " ".join("".join(chr(rng.randint(*span)) for _ in range(rng.randint(2, 9))) for _ in range(n))
    odd = [words(span, n) for span in spans.values() for n in (20, 200, 200, 3000)]
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    for c in docs.columns[2:]:
        rows = rows.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(rows.select(docs.columns)), SF).select("doc_id").collect()}
    assert not [i for i in kept if i < 0]
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def exact_inverse(u, rate):
    with localcontext(prec=60):
        k, p = 0, (-Decimal(rate)).exp()
        cdf = p
        while cdf <= Decimal(u):
            k += 1
            p = p * Decimal(rate) / k
            cdf += p
        return k


def test_counts_at_any_rate_are_the_inverse(spark):
    draws = [(i * 37 % 200 + 0.5) / 200 for i in range(25)]
    cases = [(u, rate) for rate in (3.5, 75.0, 499.5, 500.5, 700.0, 1500.0) for u in draws]
    made = mixing.distributions(spark.createDataFrame([(str(r), 1, r) for _, r in cases[::25]], "source string, n bigint, rate double"))
    asked = spark.createDataFrame([(i, u, str(r)) for i, (u, r) in enumerate(cases)], "i int, u double, source string").join(made, "source")
    got = asked.select("i", mixing.poisson_inverse(F.col("u"), F.col("first"), F.col("cdf")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == [exact_inverse(u, rate) for u, rate in cases]
    df = spark.range(40).selectExpr("id as doc_id", "'a' as source")
    counts = {r["doc_id"]: r["mix"]["n_copies"] for r in mixing.poisson_mix(df, size=40 * 700).collect()}
    for r in df.select("doc_id", mixing.uniform(F.lit("42"), F.col("doc_id").cast("string")).alias("u")).collect():
        assert counts[r["doc_id"]] == exact_inverse(r["u"], 700.0)


def test_suffixes_are_counted_over_all_labelled_urls(spark, monkeypatch):
    urls = [(f"http://h{i % 7}.d{i % 300}.com/{i}", int(i % 300 < 100)) for i in range(3000)]
    df = spark.createDataFrame([*urls, *urls[:50], (None, 1)], "url string, label int").selectExpr("url", "label", "monotonically_increasing_id() as page_id")
    model = url_filter.train(df, max_rows=400)
    counts = {r["suffix"]: (r["n"], r["blocked"]) for r in model.table.collect()}
    assert counts == {None: (3000, 1000), "com": (3000, 1000)} | {f"d{i}.com": (10, 10 * (i < 100)) for i in range(300)}
    want = sorted(map(str, url_filter.judge(df, model).collect()))
    right = url_filter.judge(df.where("url is not null"), model).join(df, "page_id").where("label = cast(verdict = 'block' as int)").count()
    assert right == 3050
    monkeypatch.setattr(url_filter, "BROADCAST_SUFFIXES", 0)
    salted = url_filter.train(df, max_rows=400)
    assert not salted.small and sorted(map(str, url_filter.judge(df, salted).collect())) == want


def test_workers_hold_one_operators_tables(spark):
    """Workers are pooled: one that encodes holds no language's tables any more, and the reverse."""

    def probe(batches):
        from lodestrand.llm import bpe, language_id

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(language_id._PROFILES)]), pa.array([len(bpe._CODECS)])], ["profiles", "codecs"])

    docs = queries.table(spark, SF, "documents").repartition(16)
    stages = dict(corpus_pipeline.STAGES)
    for last in ("byte-level BPE", "language ID"):
        for name in ("language ID", "byte-level BPE", last):
            stages[name](spark, docs, SF).write.format("noop").mode("overwrite").save()
        held = [tuple(r) for r in spark.range(0, 16, 1, 16).mapInArrow(probe, "profiles bigint, codecs bigint").collect()]
        assert any(map(sum, held)) and not any(p and c for p, c in held)


def test_freed_memory_goes_back_at_the_end_of_a_task():
    used = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096  # noqa: E731, SIM115
    kept = []

    def run(batches):
        large = []
        for _ in batches:
            large.append(np.ones(12_000))  # not so large that it is mapped by itself
            kept.append(bytes(2000))
        yield used()

    before = used()
    (at_most,) = store.light(run)(range(2000))
    assert at_most - before > 150e6
    assert used() - before < 60e6
