import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import audit, convo, evidence, linkage, rank, render
from lodestrand.sources import bibtex, tables, web
from lodestrand.streaming.convo import running_turns

BIB = """﻿@article{liu2013,
  title = {Framing {Sustainability} in a Telecoupled World},
  author = {Liu, Jianguo and Hull, Vanessa},
  year = {2013},
  journal = {Ecology \\& Society},
  keywords = {Trade, land use , trade},
  annote = {Cited by: 500},
}

@misc{skip, title = {No}}

@book{b2,
  title = {On $\\mathrm{CO}_{2}$ {and {deep} braces}},
  year = {n.d.}
}
"""


def test_bibtex(spark, tmp_path):
    (tmp_path / "x.bib").write_text(BIB)
    papers = {r["key"]: r for r in bibtex.parse(bibtex.read_entries(spark, str(tmp_path))).collect()}
    assert set(papers) == {"liu2013", "b2"}
    p = papers["liu2013"]
    assert (p["title"], p["year"], p["journal"], p["cited_by"], sorted(p["keywords"])) == ("Framing Sustainability in a Telecoupled World", 2013, "Ecology & Society", 500, ["land use", "trade"])
    assert papers["b2"]["year"] == 0 and papers["b2"]["title"] == "On $\\mathrmCO_2$ and deep braces"
    strict = {r["key"]: r for r in bibtex.parse(bibtex.read_entries(spark, str(tmp_path)), defaults=False).collect()}
    assert strict["b2"]["year"] is None and strict["b2"]["cited_by"] is None


def test_csv_and_regions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Sending,Receiving,Intracoupling\nMEX,USA, 1\nUSA,MEX,1\nBRA,CHN,0\n,,\n")
    assert [tuple(r) for r in tables.read_country_pairs(spark, str(tmp_path / "p.csv")).collect()] == [("MEX", "USA")]
    with pytest.raises(ValueError, match="lacks"):
        tables.read_csv(spark, str(tmp_path / "p.csv"), ["nope"])
    (tmp_path / "e.csv").write_text("ADM1_code_A,ADM1_name_A,country_A,ISO_A3_A,ADM1_code_B,ADM1_name_B,country_B,ISO_A3_B\nAFG001 ,One,Afghanistan,AFG,AFG024,Two,Afghanistan,AFG\nAFG001,Again,Afghanistan,AFG,PAK005,Five,Pakistan,PAK\n")
    edges, regions = tables.read_region_edges(spark, str(tmp_path / "e.csv"))
    assert edges.count() == 2 and {r["region"]: r["name"] for r in regions.collect()} == {"AFG001": "One", "AFG024": "Two", "PAK005": "Five"}


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    tables.write_with_manifest(df, str(tmp_path / "m"), ["id"], ["t"], model="none")
    assert tables.read_with_manifest(spark, str(tmp_path / "m"), ["id"], ["t"]).count() == 2
    df.where("id = 1").write.mode("overwrite").parquet(str(tmp_path / "m" / "data"))
    with pytest.raises(ValueError, match="manifest"):
        tables.read_with_manifest(spark, str(tmp_path / "m"), ["id"], ["t"])


def test_documents_and_zip(spark, tmp_path):
    (tmp_path / "b.md").write_text("two\nlines")
    (tmp_path / "A.md").write_text("one")
    (tmp_path / "no.txt").write_text("x")
    assert [r["file_name"] for r in tables.read_documents(spark, str(tmp_path)).collect()] == ["A.md", "b.md"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/c.md", "three")
    got = tables.unzip(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))).collect()
    assert [(r["file_name"], r["text"]) for r in got] == [("d/c.md", "three")]


def test_web_sources(spark):
    reply = '{"a": [{"url": "http://x", "title": "X", "snippet": "s"}, {"b": {"url": "http://y", "excerpt": "e"}}, {"url": "http://x"}], "url": ""}'
    df = spark.createDataFrame([(1, reply), (2, "junk")], "id int, j string")
    assert [(r["url"], r["snippet"]) for r in web.json_sources(df, "id", "j", 5).orderBy("ord").collect()] == [("http://x", "s"), ("http://y", "e")]
    cited = '{"content": [{"type": "search", "content": [{"title": "T", "page_age": "1 day", "url": "http://z"}]}]}'
    assert [(r["snippet"], r["url"]) for r in web.cited_sources(spark.createDataFrame([(1, cited)], "id int, j string"), "id", "j", 5).collect()] == [("(page age: 1 day)", "http://z")]
    html = "<a class='result-link' href='//d.com/l/?uddg=http%3A%2F%2Fx.org%2Fa&amp;rut=1'>Ti<b>tle</b></a><td class='result-snippet'> some  text </td>"
    got = web.html_results(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h").first()
    assert (got["title"], got["snippet"], got["url"]) == ("Title", "some text", "http://x.org/a")


def test_linkage(spark):
    papers = spark.createDataFrame([("k1", "Framing sustainability in a telecoupled world", "Liu, J.", 2013), ("k2", "Fish trade networks", "Carlson, A.", 2017)], "key string, title string, authors string, year int")
    files = spark.createDataFrame([("Liu et al. - 2013 - Framing sustainability in a telecoupled world.md",), ("Carlson - 2018 - Fish trade networks.md",), ("X - 2050 - Fish trade networks.md",), ("notes.md",)], "file_name string")
    got = {r["file_name"][:6]: r["key"] for r in linkage.match_files(files, papers).collect()}
    assert got == {"Liu et": "k1", "Carlso": "k2", "X - 20": None, "notes.": None}
    cites = spark.createDataFrame([(1, "Jianguo Liu and X Y", 2013, "Framing sustainability in a telecoupled world"), (2, "Nobody", 2013, "Other")], "cite_id int, authors string, year int, title string")
    assert {r["cite_id"]: r["key"] for r in linkage.match_citations(cites, papers).collect()} == {1: "k1", 2: None}
    fb = files.select(linkage.fallback_paper(F.col("file_name")).alias("p")).collect()
    assert fb[3]["p"]["title"] == "notes" and fb[3]["p"]["authors"] == "Unknown" and fb[0]["p"]["year"] == 2013


def test_evidence(spark):
    report = "CAUSES\nsoybean exports deforest amazon lands\n\nAGENTS\nsoybean exports deforest amazon lands\nSUPPORTING EVIDENCE FROM LITERATURE\nsoybean exports deforest amazon lands"
    passages = spark.createDataFrame([(1, 1, "soybean exports deforest amazon lands quickly", 0.5), (1, 2, "nothing alike", 0.9), (1, 3, "soybean exports deforest cerrado", 0.4)], "id int, n int, text string, score double")
    got = evidence.annotate(spark.createDataFrame([(1, report)], "id int, text string"), passages, "id").first()
    lines = got["text"].split("\n")
    assert lines[1].endswith("lands [1]") and lines[4].endswith("lands [1] [3]") and lines[6].endswith("lands") and got["added"] == 3


def test_ranking_and_blocks(spark):
    papers = spark.createDataFrame([("a", "Avocado trade", ["avocado", "trade"], 5, 2015, "A and B and C", "J", ""), ("b", "Coffee", ["coffee"], 500, 2010, "D", "J", "10.1/x"), ("c", "Zebra", [], 0, 2000, "E", "", "")], "key string, title string, keywords array<string>, cited_by int, year int, authors string, journal string, doi string")
    got = rank.recommend(papers, spark.createDataFrame([(1, ["avocado", "trade"])], "query_id int, terms array<string>"), 5)
    assert [(r["key"], round(r["score"], 3)) for r in got.orderBy("rank").collect()] == [("a", 10.778), ("b", 2.0)]
    assert "[1] Avocado trade" in render.recommendations_block(got, "query_id").first()["text"]
    assert rank.database_summary(papers).first()["year_min"] == 2000


def test_conversations(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "more")], "conv_id int, turn int, role string, text string")
    got = [r["query"] for r in convo.merged_queries(turns).orderBy("turn").collect()]
    assert got == ["q", "Original question: q\nRefinement: more"]
    turns.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    q = running_turns(stream).writeStream.outputMode("complete").format("memory").queryName("turns_out").start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("turns_out").first()
    assert (row["messages"], row["assistant_turns"], row["first_question"]) == (4, 1, "q")


def test_audits(spark):
    rows = spark.createDataFrame([("a", "10.1/X"), ("b", "10.1/x"), ("c", "")], "key string, doi string")
    got = audit.duplicate_keys(rows, F.lower("doi"), "key").collect()
    assert [(r["key"], r["n"], r["items"]) for r in got] == [("10.1/x", 2, ["a", "b"])]
    papers = spark.createDataFrame([("a", "old"), ("b", None)], "key string, keywords string")
    todo = spark.createDataFrame([("a", "NA", 0), ("b", "new", 0), ("z", "q", 0)], "key string, keywords string, ord int")
    assert {r["key"]: r["outcome"] for r in audit.apply_directives(papers, todo).collect()} == {"a": "deleted", "b": "inserted"}
    assert [r["key"] for r in audit.unused_directives(papers, todo).collect()] == ["z"]


def test_saved_index_scores_alike(spark, tmp_path):
    from lodestrand.operators.index import TfIdfIndex

    texts = spark.createDataFrame([(1, "soybean trade deforestation"), (2, "fishery trade quota quota"), (3, ""), (4, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "soybean quota"), (2, "the of"), (3, None)], "query_id int, query string")
    made = TfIdfIndex.build(texts, ["id"])
    rows = lambda index: sorted(map(tuple, index.scores(asked).collect()))
    assert rows(made) == rows(made.save(str(tmp_path / "i"))) and {r[1] for r in rows(made)} == {1, 2}
    assert made.statistics().first()["texts"] == 2


def test_corpus_source():
    shipped = {"articles_2025": "/data/articles"}
    assert tables.corpus_source() is None
    assert tables.corpus_source("/papers") == "/papers"
    assert tables.corpus_source(corpus=" Articles-2025 ", shipped=shipped) == "/data/articles"
    for wrong in ({"folder": "/papers", "corpus": "articles_2025"}, {"corpus": "others"}):
        with pytest.raises(ValueError):
            tables.corpus_source(**wrong, shipped=shipped)
