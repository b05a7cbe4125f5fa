import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from lodestrand.llm import exact_dedup, mixing, sharding

CASES = [(1, "Same"), (2, "sAME"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "Same"), (7, "Same"), (None, "SAME"), (8, "long " * 30_000), (9, "LONG " * 30_000)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", "'x' as norm", "'y' as sha", "1 as salt", "'s' as source", "0 as id") if extra else df


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_against_brute_force(spark, keep):
    got = exact_dedup.duplicate_groups(frame(spark, CASES), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in CASES:
        groups[lower(t)].append(i)
    pick = max if keep == "largest" else min
    want = Counter((i, pick(x for x in ids if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_only_null_identifiers_and_empty_table(spark):
    got = exact_dedup.duplicate_groups(frame(spark, [(None, "a"), (None, "A")])).collect()
    assert sorted(r["kept"] for r in got) == [False, True] and {r["keep_id"] for r in got} == {None}
    assert exact_dedup.duplicate_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0


def test_survivors_keep_all_columns(spark):
    df = frame(spark, CASES)
    got = exact_dedup.drop_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5, 6, 8]


def test_hot_text_over_many_partitions(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text").repartition(16)
    got = exact_dedup.duplicate_groups(df, keep="largest")
    assert got.where("kept").count() == 4000 - 1334 + 1
    assert got.where("group_size = 1334 and keep_id = 3999").count() == 1334


def test_dedup_plan_is_native(spark):
    plan = exact_dedup.duplicate_groups(frame(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- mixing ------------------------------------------------------------------------------------------


def uniform(seed, ident):
    return int(hashlib.md5(f"{seed}:{ident}".encode()).hexdigest()[:13], 16) / 2**52


def inverse(u, rate):
    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_counts_against_brute_force(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(600)] + [(None, None, None), (5, "again", "s0"), (7, "", "hot")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as rate", "2 as row", "3 as ident")
    n = Counter(s for _, _, s in rows)
    total = sum(math.sqrt(x) for x in n.values())
    want = Counter()
    for i, t, s in rows:
        rate = math.sqrt(n[s]) / total * len(rows) / n[s]
        want[i, t, s] += inverse(uniform(42, "null" if i is None else i), rate)
    got = mixing.poisson_mix(df)
    assert got.columns == [*df.columns, "mix"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == +want
    assert [r["mix"]["shuffle_key"] for r in rows] == sorted(r["mix"]["shuffle_key"] for r in rows)
    assert {r["mix"]["copy"] for r in rows if r["doc_id"] == 3} == set(range(want[3, "t3", "hot"]))


def test_given_weights_and_size(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id < 2700, 'a', 'b') as source")
    got = Counter(r["source"] for r in mixing.poisson_mix(df, weights={"a": 1, "b": 3, "c": 5}, size=4000).collect())
    assert abs(got["b"] - 3000) < 250 and abs(got["a"] - 1000) < 150
    assert mixing.poisson_mix(df, weights={"zz": 1}).count() == 0
    assert mixing.poisson_mix(df.limit(0)).count() == 0


def test_large_rates_and_the_salted_way(spark, monkeypatch):
    df = spark.range(40).selectExpr("id as doc_id", "'a' as source")
    n = mixing.poisson_mix(df, size=40 * 700).count()
    assert abs(n - 28_000) < 1500
    want = sorted(map(tuple, mixing.poisson_mix(df, info=False).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_VALUES", -1)
    assert sorted(map(tuple, mixing.poisson_mix(df, info=False).collect())) == want


@pytest.mark.parametrize("rate", [1, 400, 1500])
def test_mean_and_variance(spark, rate):
    n = 4000
    counts = [r["n"] for r in mixing.poisson_mix(spark.range(n).selectExpr("id as doc_id", "'a' as source"), size=rate * n).groupBy("doc_id").count().selectExpr("count as n").collect()]
    counts += [0] * (n - len(counts))
    mean = sum(counts) / n
    variance = sum((c - mean) ** 2 for c in counts) / (n - 1)
    assert abs(mean - rate) < 5 * math.sqrt(rate / n) and abs(variance / rate - 1) < 5 * math.sqrt(2 / n) + 5 / math.sqrt(rate * n)


def test_mix_plan_is_native(spark):
    plan = mixing.poisson_mix(spark.range(9).selectExpr("id as doc_id", "'a' as source"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- shards ------------------------------------------------------------------------------------------


def owner(key, n):
    draws = [(int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16), -i) for i in range(n)]
    return -max(draws)[1]


def test_shards_against_brute_force(spark):
    rows = [(i, f"text {i}" * (i % 7)) for i in range(500)] + [(None, None), (3, "twice"), (3, "twice"), (-5, "é🙂")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as k", "2 as size", "3 as shard", "4 as part"), ranges=8).collect()
    name = lambda i: "null" if i is None else i
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), owner(name(i), 8), owner(name(i), 9)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(((r["doc_id"] is not None, r["doc_id"], r["text_crc32"], r["size"]), r["slot"]))
    for of in by.values():
        assert sorted(s for _, s in of) == list(range(len(of)))
        assert [k for k, _ in sorted(of, key=lambda x: x[1])] == sorted(k for k, _ in of)


def test_weights_and_empty(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    n = Counter(r["shard"] for r in sharding.assign(df, weights=[1, 3, 0]).collect())
    assert n[2] == 0 and abs(n[1] - 3000) < 150
    assert sharding.assign(df.limit(0)).count() == 0
    assert sharding.assign(df.selectExpr("cast(doc_id as string) as doc_id", "text"), ranges=4).selectExpr("count(distinct shard, slot) as n").first()["n"] == 4000
    with pytest.raises(ValueError):
        sharding.owner(df["doc_id"], [])
