import random
from collections import Counter, defaultdict

import pytest

from lodestrand.llm import components, ngram_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=75):
    """Per row: (id, set size, smallest id reachable)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in inverted[g])
        for j, k in met.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for g in s:
            inverted[g].append(i)
    low = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None and (find(i) not in low or ident < low[find(i)]):
            low[find(i)] = ident
    return Counter((ident, len(sets[i]), low.get(find(i))) for i, (ident, _) in enumerate(rows))


def check(spark, rows, percent=75, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as digest", "1 as n", "2 as root", "3 as block")
    got = Counter(tuple(r) for r in ngram_join.linked_sets(df, percent=percent, **kw).collect())
    assert got == brute(rows, percent)


def test_cases(spark):
    w = lambda n, tag="w": " ".join(f"{tag}{i}" for i in range(n))
    rows = [
        (10, w(60)), (3, w(60).upper()), (7, w(58) + " x y"), (8, None), (9, ""), (1, "  \t\n "), (4, "one two three"), (5, "ONE  two\tthree"), (6, "one two"), (11, w(20_000, "long")),
        (12, w(20_000, "long") + " more"), (None, w(61)), (13, "a b"), (13, w(60)), (14, "Éa b c d e"), (15, "éa b c d e"), (16, "a\u00a0b c d e f"),
    ]
    check(spark, rows)


def test_null_identifiers_only_and_empty(spark):
    check(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    check(spark, [])


@pytest.mark.parametrize("seed, percent", [(1, 75), (3, 50)])
def test_random_edits_against_brute_force(spark, seed, percent):
    """Families of copies with edits around the threshold, a passage that many share, and exact copies."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, at = [], 0
    for size in (1, 2, 3, 8, 60, 150):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))] + (passage if rng.random() < 0.5 else [])
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((at * 7919 % 10_007, " ".join(t)))
            at += 1
    rows += [(20_000 + i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 14))])) for i in range(60)]
    rng.shuffle(rows)
    check(spark, rows, percent, block=2000)


def test_a_hot_family(spark):
    """A group in which only some pairs link, over many blocks and lists."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(500):
        t = list(base)
        for p in rng.sample(range(100), rng.randint(1, 4)):
            t[p] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    check(spark, rows, block=3000)


def test_packing():
    import numpy as np

    a = np.array([0, 1, 5, 2**40, 2**64 - 1], np.uint64)
    got = ngram_join.unpack(ngram_join.pack(a, np.arange(5), np.arange(5) * 7))
    assert got[0].tolist() == a.tolist() and got[1].tolist() == [0, 1, 2, 3, 4] and got[2].tolist() == [0, 7, 14, 21, 28]
    assert len(ngram_join.unpack(ngram_join.pack(a[:0], a[:0]))[0]) == 0


@pytest.mark.parametrize("split_edges", [components.SPLIT_EDGES, 10])
def test_components(spark, monkeypatch, split_edges):
    monkeypatch.setattr(components, "SPLIT_EDGES", split_edges)
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(None, 4), (5, 5)]
    parent = {x: x for ab in links if ab[0] is not None for x in ab}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found, _ = components.connected(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: find(x) for x in parent if find(x) != x}


def test_components_of_few_edges_need_two_tables(spark, monkeypatch):
    """Not a round for each doubling of a chain: what a task can hold is joined in one."""
    written, settle = [], components.store.settle
    monkeypatch.setattr(components.store, "settle", lambda df, name: written.append(name) or settle(df, name))
    chain = spark.range(3000).repartition(7).selectExpr("concat('n', lpad(id, 5, '0')) AS a", "concat('n', lpad(id + 1, 5, '0')) AS b")
    for kind in ("string", "binary"):
        written.clear()
        found = components.connected(chain.selectExpr(f"cast(a AS {kind}) AS a", f"cast(b AS {kind}) AS b"))[0].selectExpr("cast(node AS string) AS node", "cast(root AS string) AS root").collect()
        assert sorted(r["node"] for r in found) == [f"n{i:05d}" for i in range(1, 3001)] and {r["root"] for r in found} == {"n00000"}
        assert len(written) == 2


@pytest.mark.parametrize("split_edges", [components.SPLIT_EDGES, 10])
def test_forest_of_a_task(monkeypatch, split_edges):
    import pyarrow as pa

    monkeypatch.setattr(components, "SPLIT_EDGES", split_edges)
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 540)] + [(600 + i, 699 - i) for i in range(50)]
    links = [ab if rng.random() < 0.5 else ab[::-1] for ab in links]
    rng.shuffle(links)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links[i : i + 9])], ["u", "v"]) for i in range(0, len(links), 9)]
    (got,) = components._forest(batches)
    want = {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 540)} | {i: 1299 - i for i in range(650, 700)}
    assert dict(zip(*(c.to_pylist() for c in got.columns))) == want
    assert not list(components._forest([]))


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text), (2, text + " x"), (9, "other words"), (None, text), (4, None)], "doc_id bigint, text string")
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 2, 4, 9]
