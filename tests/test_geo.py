import pytest
from pyspark.sql import functions as F

from lodestrand.operators import flows, gazetteer, graph, merge, record, signals


@pytest.fixture(scope="module")
def names(spark):
    return gazetteer.default_terms(spark).persist()


@pytest.mark.parametrize(
    "text, code",
    [
        ("usa", "USA"), ("UK", "GBR"), ("South Korea", "KOR"), ("Ethiopian coffee regions", "ETH"), ("Indiana", None), ("Great Lakes ports, interstate", None),
        ("Planet Mars", None), ("", None), (None, None), ("Trade with China increased", "CHN"), ("mex", "MEX"),
    ],
)
def test_countries(spark, names, text, code):
    rows = spark.createDataFrame([(1, text)], "id int, t string")
    assert gazetteer.resolve(rows, ["id"], "t", names).first()["code"] == code


def test_country_table(spark):
    assert gazetteer.countries(spark).count() > 200


@pytest.fixture(scope="module")
def edges(spark):
    return graph.edge_set(spark.createDataFrame([("MEX", "USA"), ("USA", "MEX"), ("CAN", "USA"), ("MEX", "GTM"), ("X", "X")], "x string, y string"), "x", "y").persist()


def test_adjacency(spark, edges):
    assert edges.count() == 3
    pairs = spark.createDataFrame([("MEX", "USA"), ("USA", "MEX"), ("MEX", "CAN"), ("MEX", "MEX"), ("MEX", None)], "code_a string, code_b string")
    got = {(r["code_a"], r["code_b"]): (r["pair_type"], r["confidence"]) for r in graph.lookup_pairs(pairs, edges).collect()}
    assert got["MEX", "USA"] == got["USA", "MEX"] == ("pericoupled", "database") and got["MEX", "CAN"][0] == "telecoupled"
    assert got["MEX", "MEX"] == ("unknown", "same_country") and got["MEX", None] == ("unknown", "unresolved")
    assert {r["src"]: r["neighbours"] for r in graph.neighbours(edges).collect()}["MEX"] == ["GTM", "USA"]


def test_country_classes(spark, edges):
    code = lambda *xs: spark.createDataFrame([(x,) for x in xs], "code string")
    shapes = code("MEX", "USA", "GTM", "BRA", "XYZ")
    got = {r["code"]: r["class"] for r in graph.classify_countries(shapes, "MEX", edges, code("MEX", "USA", "GTM", "BRA")).collect()}
    assert got == {"MEX": "intracoupling", "USA": "pericoupling", "GTM": "pericoupling", "BRA": "telecoupling", "XYZ": "na"}
    got = {r["code"]: r["class"] for r in graph.classify_countries(shapes, "MEX", edges, code("BRA"), code()).collect()}
    assert got["BRA"] == "na" and got["USA"] == "pericoupling"


def test_region_classes(spark):
    e = graph.edge_set(spark.createDataFrame([("AFG001", "AFG024"), ("AFG001", "PAK005")], "x string, y string"), "x", "y")
    shapes = spark.createDataFrame([("AFG001", "AFG"), ("AFG024", "AFG"), ("AFG010", "AFG"), ("PAK005", "PAK"), ("BRA001", "BRA"), ("CHN001", "CHN"), ("XYZ999", None)], "code string, iso string")
    iso = lambda *xs: spark.createDataFrame([(x,) for x in xs], "iso string")
    code = lambda *xs: spark.createDataFrame([(x,) for x in xs], "code string")
    cls = lambda df: {r["code"]: r["class"] for r in df.collect()}
    loose = cls(graph.classify_regions(shapes, "AFG001", "AFG", e, iso("AFG", "PAK", "BRA", "CHN")))
    assert loose == {"AFG001": "intracoupling", "AFG024": "pericoupling", "AFG010": "telecoupling", "PAK005": "pericoupling", "BRA001": "telecoupling", "CHN001": "telecoupling", "XYZ999": "na"}
    strict = cls(graph.classify_regions(shapes, "AFG001", "AFG", e, iso("AFG"), iso("CHN", "AFG"), code("PAK005")))
    assert strict == {"AFG001": "intracoupling", "AFG024": "na", "AFG010": "na", "PAK005": "pericoupling", "BRA001": "na", "CHN001": "telecoupling", "XYZ999": "na"}
    empty = cls(graph.classify_regions(shapes, "AFG001", "AFG", e, iso("AFG"), None, code()))
    assert set(empty.values()) == {"intracoupling", "na"}


def test_regions_resolve(spark, names):
    regions = spark.createDataFrame([("USA023", "Michigan", "USA"), ("USA011", "Georgia", "USA"), ("CHN001", "Anhui Sheng", "CHN"), ("ESP009", "Cataluña/Catalunya", "ESP"), ("A1", "Central", "AAA"), ("B1", "Central", "BBB")], "region string, name string, iso string")
    ask = spark.createDataFrame([(1, "Michigan", None), (2, "anhui", None), (3, "Catalunya", None), (4, "Georgia", None), (5, "Georgia", "USA"), (6, "Central", None), (7, "Central", "BBB"), (8, "southern Michigan farms", None), (9, "trade", None), (10, "Michigan", "CHN")], "id int, n string, c string")
    got = {r["id"]: r["region"] for r in gazetteer.resolve_regions(ask, ["id"], "n", regions, names, "c").collect()}
    assert got == {1: "USA023", 2: "CHN001", 3: "ESP009", 4: None, 5: "USA011", 6: None, 7: "B1", 8: "USA023", 9: None, 10: None}


REPLY = """# 1. Coupling Classification
A telecoupling case.

## 4. Telecoupling Analysis
### 4.1 Systems Identification
**Sending System (distant)**: Brazil
- **Human subsystem**: farmers
free words
**Receiving System**: China and Japan

### 4.2 Flows Analysis
- [Matter] Brazil -> China: soybeans
- [Capital] Importing countries -> Brazil: payments
- Soil within Brazil

### 4.3 Agents
- [Traders] Cargill: ships
- local farmers

### 4.4 Causes
**Economic**
- demand

# 5. Cross-coupling Interactions
no bullets here

# 6. Research Gaps and Suggestions
- data
"""


def test_record_and_flows(spark, names):
    items = record.parse(spark.createDataFrame([(1, REPLY), (2, None), (3, "no headings")], "doc_id int, text string")).persist()
    assert {r["doc_id"] for r in items.collect()} == {1}
    get = lambda kind: sorted((r["ord"], r["field"], r["value"]) for r in items.where(f"kind = '{kind}'").collect())
    assert (0, "human_subsystem", "farmers") in get("systems") and (0, "system_scope", "distant") in get("systems") and (0, "description", "free words") in get("systems")
    assert (0, "level", "firms / traders / corporations") in get("agents") and (1, "level", "individuals / households") in get("agents")
    assert get("causes") == [(0, "economic", "demand")] and get("interactions") == [(0, "item", "no bullets here")] and get("gaps") == [(0, "item", "data")]
    wide = items.where("kind = 'flows'").groupBy("doc_id", "ord").pivot("field", ["category", "direction", "description"]).agg({"value": "max"})
    focal = spark.createDataFrame([(1, "BRA")], "doc_id int, focal string")
    got = flows.resolve_flows(wide, record.system_entries(items), focal, names)
    assert {(r["category"], r["source"], r["target"]) for r in got.collect()} == {("matter", "BRA", "CHN"), ("capital", "CHN", "BRA"), ("capital", "JPN", "BRA")}


def test_flat_systems_and_bold_flows(spark):
    text = "## 2. Intracoupling Analysis\n### 2.1 Systems Identification\n- Focal: Michigan\n- Note: none\n### 2.2 Flows Analysis\n**1. Energy flows**\n- Direction: A → B\n- power lines\n**People flows**\nworkers move C -> D\n"
    rows = record.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [dict(r["fields"]) for r in record.systems(rows).collect()] == [{"name": "Michigan", "role": "focal"}]
    got = [(r["category"], r["direction"], r["description"]) for r in record.flows(rows).orderBy("ord").collect()]
    assert got == [("energy", "A → B", "power lines"), ("people", "workers move C → D", None)]


def test_supplement(spark):
    reply = '{"additional_receiving_mentions": [{"name": "Japan", "evidence_passage_ids": [1, "2", 9, 1]}, {"name": "X", "evidence_passage_ids": [9]}], "supplementary_flows": [{"category": "Matter", "direction": "A -> B", "description": "d", "evidence_passage_ids": [2]}, {"category": "spice", "direction": "A -> B", "description": "d", "evidence_passage_ids": [2]}]}'
    got = signals.supplement(spark.createDataFrame([(1, reply), (2, "junk")], "doc_id int, text string"), spark.createDataFrame([(1, 2), (2, 2)], "doc_id int, n int"))
    assert [(r["role"], r["name"], r["ids"]) for r in got["mentions"].collect()] == [("receiving", "Japan", [1, 2])]
    assert [(r["category"], r["ids"]) for r in got["flows"].collect()] == [("matter", [2])]


def test_merge_results(spark):
    rows = spark.createDataFrame([(0, 0, "t", "s", "http://a/"), (1, 0, "t", "s", "HTTP://A"), (1, 1, "T ", "s", ""), (1, 2, "t", " S", None)], "backend int, ord int, title string, snippet string, url string")
    got = merge.merge_results(rows.selectExpr("1 as q", "*"), ["q"], ["backend", "ord"], 5).orderBy("rank").collect()
    assert [(r["backend"], r["ord"]) for r in got] == [(0, 0), (1, 1)]


def test_every_alias_and_names_without_latin_letters(spark):
    aliases = list(gazetteer.ALIASES)
    assert len(aliases) > 180 and len({a for a, _ in aliases}) == len(aliases)
    found = gazetteer.resolve(spark.createDataFrame([(i, f"exports of {a}, mostly") for i, (a, _) in enumerate(aliases)], "id int, t string"), ["id"], "t", gazetteer.terms(spark.createDataFrame([], "code string, name string"), spark.createDataFrame(aliases, "alias string, code string")))
    assert {r["id"]: r["code"] for r in found.collect()} == {i: c for i, (_, c) in enumerate(aliases)}
    places = gazetteer.terms(spark.createDataFrame([("JPN", "日本"), ("EGY", "مصر"), ("CIV", "Côte d'Ivoire")], "code string, name string"))
    rows = spark.createDataFrame([(1, "東京は日本の首都"), (2, "قمح مصر"), (3, "cocoa (côte d'ivoire)"), (4, "日 本"), (5, "日本")], "id int, t string")
    assert {r["id"]: r["code"] for r in gazetteer.resolve(rows, ["id"], "t", places).collect()} == {1: "JPN", 2: "EGY", 3: "CIV", 4: None, 5: "JPN"}


def test_focus_of_questions(spark):
    names = spark.createDataFrame([("AAA", "Northland"), ("BBB", "South Isle")], "code string, name string")
    regions = spark.createDataFrame([("A-1", "Millport", "AAA"), ("A-2", "Twinford", "AAA"), ("B-2", "Twinford", "BBB"), ("C-1", "Lonely Bay", "CCC"), ("D-1", "Nowhere Bay", None)], "region string, name string, iso string")
    asked = [(0, "Wheat of Millport's farms and South Isle"), (1, "What does South Isle’s trade need?"), (2, None), (3, ""), (4, "Fish of Twinford"), (5, "Lonely Bay fish"), (6, "Nowhere Bay fish")]
    got = gazetteer.focus(spark.createDataFrame(asked, "id int, t string"), ["id"], "t", regions, gazetteer.terms(names), names)
    want = {0: ("Millport", "Northland"), 1: (None, "South Isle"), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("Lonely Bay", None), 6: (None, None)}
    assert {r["id"]: (r["place"], r["country"]) for r in got.collect()} == want
    none = spark.createDataFrame([], "id int, t string")
    assert gazetteer.focus(none, ["id"], "t", regions, gazetteer.terms(names), names).count() == 0


def test_country_scan_reads_the_column_it_is_given(spark):
    names = spark.createDataFrame([("AAA", "Northland"), ("BBB", "South Isle")], "code string, name string")
    rows = spark.createDataFrame([(0, "Northland -> South Isle"), (1, None), (2, "nowhere")], "id int, said string")
    assert sorted(gazetteer.country_scan(rows, ["id"], "said", gazetteer.terms(names)).collect()) == [(0, "AAA"), (0, "BBB")]


def test_retrieval_for_records(spark):
    from lodestrand.operators import retrieve

    reply = "# 1. Coupling Classification\nMostly distant.\n\n## 4. Telecoupling Analysis\n### 4.1 Systems Identification\n**Sending System**: {0}\n\n### 4.2 Flows Analysis\n- [Matter] a -> b: {1}\n"
    replies = spark.createDataFrame([(1, reply.format("orchards", "apples")), (2, reply.format("harbours", "herring")), (3, ""), (4, None)], "doc_id int, text string")
    texts = [(1, "p", "Orchards grow apples and pears"), (2, "p", "Harbours land herring"), (3, "q", "Kilns bake bricks"), (4, "q", "Apples travel from orchards"), (5, "q", None)]
    passages = spark.createDataFrame(texts, "chunk int, paper string, text string").withColumn("section", F.lit("s"))
    found = retrieve.retrieve_for_records(passages, record.parse(replies), ["chunk"], "paper", "section", k=5).collect()
    assert {(r["query_id"], r["chunk"]) for r in found} == {(1, 1), (1, 4), (2, 2)}
    assert record.retrieval_query(record.parse(replies.limit(0))).count() == 0
