"""The whole job: nothing is left out by a filter, a cap or a sample."""

import numpy as np
from pyspark.sql import functions as F

from lodestrand.operators import audit, linkage, retrieve
from lodestrand.plans import catalogue
from lodestrand.plans.common import table

SF = "/root/testdata/sf0.001"


def test_all_orders_tie_nations(spark):
    trade = {(r["source"], r["target"]) for r in catalogue.QUERIES["flow_slots"](spark, SF).collect()}
    got = {r["key"]: r["n_peri"] + r["n_tele"] for r in catalogue.QUERIES["validation_note"](spark, SF).collect()}
    assert got == {k: sum(t == k != s for s, t in trade) for k in got} and set(got) == {t for s, t in trade if s != t}


def test_every_twentieth_vector_is_asked(spark):
    rows = table(spark, SF, "embeddings").select("vec_id").toPandas().vec_id
    asked = {i for i in rows if i % 20 == 0}
    for name in ("embedding_topk_each", "embedding_diverse_topk_each", "retrieval_confidence_hist_each", "paper_best_vs_last_score_each"):
        got = catalogue.QUERIES[name](spark, SF).toPandas()
        assert len(asked) > 1 and set(got.query_id) == asked, name
        if "hist" in name:
            assert (got.groupby("query_id").n.sum() == len(rows)).all()


def test_queries_of_more_than_one_block(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id bigint, embedding array<double>")
    asked = spark.range(1200).selectExpr("id as query_id", "array(1d, id / 100) as query_vector")
    got = retrieve.vector_scores(vectors, asked).toPandas()
    assert len(got) == 3600 and got.groupby("query_id").vec_id.nunique().eq(3).all() and got.query_id.nunique() == 1200


def test_repeated_and_null_ids_over_a_block_edge(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id bigint, embedding array<double>")
    asked = spark.range(1500).selectExpr("if(id between 998 and 1001, 998, if(id = 5, null, id)) as query_id", "array(1d, id / 100) as query_vector")
    assert retrieve.vector_scores(vectors, asked).count() == 4500


def test_norms_take_time_in_proportion(spark):
    plan = spark.range(1).selectExpr("array(3d, 4d) as v").select(retrieve.normalised(F.col("v")).alias("n"))
    assert plan.first()["n"] == [0.6, 0.8]
    # the norm, a sum over all elements, stands once, and not inside the lambda over the elements
    assert plan._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 2


def test_every_member_of_a_group_is_returned(spark):
    rows = spark.createDataFrame([(i, "same") for i in range(9)] + [(9, "one"), (10, ""), (11, ""), (12, None), (13, None)], "id bigint, k string")
    got = audit.duplicate_members(rows, F.col("k"), "id").collect()
    assert sorted(map(tuple, got)) == [("same", 9, i) for i in range(9)]


def test_few_scores_leave_the_tasks(spark):
    """Of all pairs of query and vector only those that may be in the result are shuffled; the result is that of all scores."""
    import random

    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(600)]
    odd = [None, [0.0] * 6, [1.0] * 5, [1.0, None, 1.0, 1.0, 1.0, 1.0], [], base[7], base[7]]
    data = [(i, v if i % 9 else base[i % 60], None if i % 31 == 0 else f"p{rng.choice([0, 0, 0, 1, 2, 3]) if i > 40 else 0}", rng.randrange(5)) for i, v in enumerate(base + odd)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, paper string, section int").repartition(3)
    asked = vectors.where("vec_id % 20 = 0 or vec_id >= 600").selectExpr("if(vec_id in (40, 60), 40, vec_id) as query_id", "embedding as query_vector")
    columns = ["query_id", "vec_id", "paper", "section", "score", "pass", "rank"]
    for k, least in ((3, -0.2), (9, 0.1), (40, -2.0)):
        full = retrieve.diverse_top_k(retrieve.vector_scores(vectors, asked), k, ["query_id"], "paper", "section", ["vec_id"], 3, least).select(columns)
        got = retrieve.diverse_vector_top_k(vectors, asked, k, "paper", "section", least, block=7).select(columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, full.collect())), k
    made = vectors.selectExpr("vec_id", "paper", "section", "embedding as v").where("size(v) = 6 and not exists(v, x -> x is null)").coalesce(1)
    find = retrieve._diverse_searcher(list(range(30)), list(map(np.array, base[:30])), 9, 3, -2.0, ["q", "vec_id", "paper", "section", "score"])
    assert made.mapInArrow(find, "q bigint, vec_id bigint, paper string, section int, score double").count() == 30 * 9


def test_files_meet_only_papers_that_may_match(spark, monkeypatch):
    """Pairs that share an author alone are not scored, nor is a file that its own title settles; the best paper is that of all pairs."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5])))
    data = [(i, title(), rng.choice(["ann", "bob cid", "ann bob cid dan eve", "zoe", None, ""]), 2000 + rng.randrange(4)) for i in range(300)]
    papers = spark.createDataFrame([*data, (300, None, "ann", 2000), (301, "", "ann", 2000), (302, "w1", "ann", None)], "key bigint, title string, authors string, year int")
    names = [f"{rng.choice(['ann', 'bob', 'ann bob', 'zed'])} - {2000 + rng.randrange(5)} - {t}.md" for t in [title() for _ in range(80)] + ["v1 v2", "w3 v4 v5"]]
    files = spark.createDataFrame([(n,) for n in [*names, names[0], "notes.md", "ann - 2001 - !.md"]], "file_name string")

    def brute(name, least):
        authors, year, text = name[:-3].split(" - ")
        ft, fa, found = set(text.split()), set(authors.split()), []
        for key, t, a, y in data:
            if a is not None and abs(y - int(year)) <= 1 and (ft & set(t.split()) or fa & set(a.split())):
                score = round(len(ft & set(t.split())) / len(ft | set(t.split())) + min(0.2, 0.05 * len(fa & set(a.split()))), 9)
                found += [(-score, key)] * (score >= least)
        return min(found, default=(None, None))

    for least in (0.1, 0.3, 0.9):
        got = linkage.match_files(files, papers, least=least).collect()
        assert len(got) == 85
        for r in got:
            if r["file_name"] in names:
                score, key = brute(r["file_name"], least)
                assert (r["key"], r["score"]) == (key, None if score is None else -score), (r, least)

    def strict(a, b, whole=linkage.jaccard):
        return F.when((a == b) | ~F.arrays_overlap(a, b), F.raise_error(F.lit("a pair that needs no score")).cast("double")).otherwise(whole(a, b))

    monkeypatch.setattr(linkage, "jaccard", strict)
    ours = spark.range(400).selectExpr("id as key", "concat('t', id % 40, ' u', id % 40, ' all') as title", "'ann' as authors", "2001 as year")
    asked = ours.where("key % 20 = 0").selectExpr("concat('ann - 2001 - ', title, '.md') as file_name").union(spark.sql("select 'ann - 2001 - t7 x y.md'"))
    assert {r["file_name"]: r["key"] for r in linkage.match_files(asked, ours).collect()} == {"ann - 2001 - t0 u0 all.md": 0, "ann - 2001 - t20 u20 all.md": 20, "ann - 2001 - t7 x y.md": None}
