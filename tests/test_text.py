import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import citations as C
from lodestrand.functions import text as T
from lodestrand.operators import chunks, retrieve


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, n, want, invalid",
    [
        ("a [1] b [2]", 2, "a [1] b [2]", []), ("Tokens [0] [1] [3] [4].", 3, "Tokens [1] [3].", [0, 4]), ("x [W1] y [1]", 1, "x [W1] y [1]", []),
        ("claim [99] and more", 0, "claim and more", [99]), ("first [99], second [99]; third [99]: fourth [99]!", 0, "first, second; third: fourth!", [99]),
        ("a [99]\nb\n[99] c", 0, "a\nb\n c", [99]), ("", 3, "", []),
    ],
)
def test_sanitize(spark, text, n, want, invalid):
    got = one(spark, C.sanitized(F.col("t"), F.col("n")), t=text, n=n)
    assert (got["text"], got["invalid_ids"]) == (want, invalid)
    assert one(spark, C.sanitized(F.col("t"), F.col("n")), t=want, n=n)["text"] == want


def test_renumber_against_a_model(spark):
    rng = random.Random(5)
    cases = ["".join(rng.choice(["[1]", "[3]", "[7]", "[12]", " a ", "[W2]", "."]) for _ in range(rng.randint(0, 12))) for _ in range(60)]

    def model(text, n):
        seen = {}

        def put(m):
            x = int(m[1])
            if x not in seen and len(seen) < n:
                seen[x] = len(seen) + 1
            return f"[{seen.get(x, x)}]"

        return re.sub(r"\[(\d+)\]", put, text)

    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", C.renumbered(F.col("t"), F.lit(2)).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [model(c, 2) for c in cases]


@pytest.mark.parametrize("n", [0, 1, 29, 30, 249, 250, 251, 449, 450, 451, 452, 1000])
def test_windows(spark, n):
    got = one(spark, chunks.windows(F.filter(F.split("t", " "), lambda w: w != "")), t=" ".join(f"w{i}" for i in range(n)))
    want, start = [], 0
    while start < n:
        want.append([f"w{i}" for i in range(start, min(start + 250, n))])
        if start + 250 >= n:
            break
        start += 200
    assert got == want


def test_chunking(spark):
    words = lambda n: " ".join(f"word{i}" for i in range(n))
    text = f"# Introduction\n{words(300)}\n## Methods\n{words(200)}\n## Short\n{words(10)}\n## 2016. Old entry\n{words(60)}\nReferences\n# Later\n{words(90)}"
    got = chunks.chunk(spark.createDataFrame([("p", text)], "key string, text string"), "key").orderBy("chunk_index").collect()
    assert [(r["section"], r["chunk_index"], len(r["text"].split())) for r in got] == [("Introduction", 0, 250), ("Introduction", 1, 100), ("Methods", 2, 200)]


def test_reference_text(spark):
    assert one(spark, T.is_reference_text(F.col("t")), t="Liu, J. 2013. Framing. Journal of Ecology. University Press. Smith, A. B. 2015.")
    assert not one(spark, T.is_reference_text(F.col("t")), t="The growth of trade changed the land near the river.")
    assert not one(spark, T.is_reference_text(F.col("t")), t="   ")


@pytest.mark.parametrize("score, backend, want", [(0.2, "tfidf", "High"), (0.1, "tfidf", "Medium"), (0.05, "tfidf", "Low"), (0.01, "tfidf", "Very Low"), (0.7, "embeddings", "High"), (0.55, "embeddings", "Low")])
def test_confidence(spark, score, backend, want):
    assert one(spark, T.confidence(F.col("s"), backend), s=score) == want


@pytest.mark.parametrize(
    "text, want",
    [('{"a": 1}', True), ('x ```json\n{"a": 1}\n``` y', True), ('so {"a": 1} it is', True), ('{"a": {"b": [1, 2', True), ('{"a": {"b": 2, "c": ', True), ("none", False), ("[1]", False), ("", False)],
)
def test_json_object(spark, text, want):
    assert (one(spark, T.json_object(F.col("t")), t=text) is not None) == want


def test_diverse_selection_against_a_model(spark):
    rng = random.Random(11)
    for cap, k in ((3, 8), (1, 5), (0, 5), (5, 2)):
        rows = [(i, f"p{rng.randint(0, 2)}", f"s{rng.randint(0, 2)}", rng.randint(0, 6) / 10) for i in range(30)]
        best, seen, count, late, out = sorted(rows, key=lambda r: (-r[3], r[0])), set(), {}, [], []
        for r in best:
            if r[3] < 0.1 or count.get(r[1], 0) >= max(cap, 1):
                continue
            if (r[1], r[2]) in seen:
                late.append(r)
                continue
            seen.add((r[1], r[2]))
            count[r[1]] = count.get(r[1], 0) + 1
            out.append(r[0])
        for r in late:
            if count[r[1]] < max(cap, 1):
                count[r[1]] += 1
                out.append(r[0])
        df = spark.createDataFrame(rows, "id int, paper string, section string, score double")
        got = retrieve.diverse_top_k(df, k, [], "paper", "section", ["id"], cap, 0.1).orderBy("rank").collect()
        assert [r["id"] for r in got] == out[:k]


def test_phrases_and_topics(spark):
    assert one(spark, T.phrases(F.col("t"), 2), t="Corn trade, corn Trade") == ["Corn trade", "trade corn", "Corn", "trade"]
    assert one(spark, T.topic_terms(F.col("t"), F.array(F.lit("Michigan"), F.lit(None))), t="How do Michigan's pork exports impact soy markets and pork") == ["pork", "soy"]
    assert one(spark, T.has_trade_intent(F.col("t")), t="Who imports it?") and not one(spark, T.has_trade_intent(F.col("t")), t="Water and birds")


def test_query_expansion(spark):
    got = one(spark, T.expanded_queries(F.col("t"), F.lit("Michigan"), F.lit("United States"), F.array(F.lit("pork"))), t="Michigan  pork exports")
    assert got[0] == "Michigan pork export destinations" and got[-1] == "Michigan pork exports" and len(got) == 6
    assert one(spark, T.expanded_queries(F.col("t"), F.lit("X"), F.lit(None).cast("string"), F.array().cast("array<string>")), t="birds") == ["birds"]


def test_names(spark):
    assert one(spark, T.without_marks(F.col("t")), t="Müller-Łódź é") == "Muller-Łodz e"
    assert one(spark, T.doi_of(F.col("t")), t="https://doi.org/10.1/AB") == "10.1/ab"
    assert one(spark, T.surname_forms(F.col("t")), t="Ana García-López") == ["garcialopez", "garcia", "lopez"]
    assert one(spark, T.is_direct_location(F.col("t")), t="likely markets such as Mexico") is False
    assert one(spark, T.names_unsupported_scope(F.col("t")), t="the river basin of X") is True


def test_excerpt(spark):
    text = " ".join(["plain words here"] * 60 + ["soybean exports deforest land"] + ["other things follow"] * 60)
    got = one(spark, T.excerpt(F.col("t"), F.col("a")), t=text, a="soybean exports")
    assert "soybean exports" in got and got.startswith("...") and got.endswith("...") and len(got) <= 306
    assert one(spark, T.excerpt_start(F.col("t"), F.col("a")), t=text, a="soybean exports") == 144
    assert one(spark, T.excerpt(F.col("t"), F.col("a")), t="short", a="x") == "short"
    assert one(spark, T.excerpt(F.col("t"), F.lit("")), t=text).endswith("...")
