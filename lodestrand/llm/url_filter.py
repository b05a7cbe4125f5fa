"""URL filtering: explicit rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import store

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "host_entropy", "parameters",
    "host_labels", "host_hyphens", "longest_label", "fragment", "suffix_share", "suffix_block_rate", "domain_share", "domain_block_rate",
)
#: Labelled URLs that training brings to the driver, at most.
TRAIN_ROWS = 20_000
#: Up to so many suffixes their table of counts is broadcast; beyond, it is joined by salted keys.
BROADCAST_SUFFIXES, SALTS = 20_000, 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    """The last label, and the last two."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


class SuffixStatistics:
    """Share of all labelled URLs, and smoothed rate of blocked ones, of a suffix with n of them, k blocked."""

    def __init__(self, n: int, blocked: int, prior: float = 20.0):
        self.n, self.base, self.prior = max(1, n), blocked / n if n else 0.5, prior

    def of(self, n: int, k: int) -> tuple[float, float]:
        return n / self.n, (k + self.prior * self.base) / (n + self.prior)


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, n, blocked) of (host, y) rows; a suffix of one label that is both counts once, and null stands for all rows."""
    both = F.array_distinct(F.array(F.substring_index("host", ".", -1), F.substring_index("host", ".", -2), F.lit(None).cast("string")))
    return labelled.select(F.explode(both).alias("suffix"), "y").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked"))


def with_counts(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``rows`` with n0, k0, n1, k1: the counts of the host's last label and its last two, 0 if unknown. Beside ``host`` they have a ``spread``, a hash."""
    for i in (0, 1):
        counts = table.where("suffix is not null").select(F.col("suffix").alias(f"s{i}"), F.col("n").alias(f"n{i}"), F.col("blocked").alias(f"k{i}"))
        rows = rows.withColumn(f"s{i}", F.substring_index("host", ".", -1 - i))
        if small:
            rows = rows.join(F.broadcast(counts), f"s{i}", "left")
        else:
            counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            rows = rows.withColumn("salt", F.pmod("spread", F.lit(SALTS))).join(counts, [f"s{i}", "salt"], "left").drop("salt")
    return rows.fillna(0, ["n0", "k0", "n1", "k1"])


def features(url: str | None, host: str, path: str, n0: int, k0: int, n1: int, k1: int, stats: SuffixStatistics) -> tuple[float, ...]:
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    labels = host.split(".") if host else []
    (a, b), (c, d) = stats.of(n0, k0), stats.of(n1, k1)
    return (
        len(url), len(host), len(path), sum(bool(x) for x in path.split("/")), sum(x.isdigit() for x in url) / max(1, len(url)), entropy(url), entropy(host),
        sum(bool(x) for x in query.split("&")), len(labels), host.count("-"), max(map(len, labels), default=0), float("#" in url), a, b, c, d,
    )


def matrix(urls: list[tuple], stats: SuffixStatistics) -> np.ndarray:
    return np.array([features(*u, stats) for u in urls], float).reshape(len(urls), len(FEATURES))


class BoostedTrees:
    """Binary logistic boosting of small regression trees over binned features; deterministic."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.start, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features; y: 0 or 1. Labels of one kind, or none, give a constant."""
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        self.start, self.forest = math.log(p / (1 - p)), []
        if len(y) == 0 or y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T)], 1)
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, prob - y, prob * (1 - prob), np.arange(len(y)), self.depth, score)
            self.forest.append(tree)
        return self

    def _grow(self, binned, grad, hess, rows, depth, score):
        """A leaf (value) or (feature, cut, left, right); left holds values up to the cut. Adds leaves to ``score``."""
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * self.least:
            for j in range(binned.shape[1]):
                if not len(self.cuts[j]):
                    continue
                b, width = binned[rows, j], len(self.cuts[j]) + 1
                n = np.cumsum(np.bincount(b, minlength=width))[:-1]
                gl = np.cumsum(np.bincount(b, grad[rows], width))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], width))[:-1]
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            value = -self.rate * g / (h + self.ridge)
            score[rows] += value
            return float(value)
        _, j, k = best
        left = binned[rows, j] <= k
        return j, float(self.cuts[j][k]), self._grow(binned, grad, hess, rows[left], depth - 1, score), self._grow(binned, grad, hess, rows[~left], depth - 1, score)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)

        def add(tree, rows):
            if isinstance(tree, float):
                score[rows] += tree
            elif len(rows):
                left = x[rows, tree[0]] <= tree[1]
                add(tree[2], rows[left])
                add(tree[3], rows[~left])

        for tree in self.forest:
            add(tree, np.arange(len(x)))
        return 1 / (1 + np.exp(-score))


class Rules:
    """(host, path, verdict) rules. A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equals that with the longer host."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
            self.by_host.setdefault(host.lower(), []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule as text, and its verdict."""
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for start, verdict in self.by_host.get(at := ".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(at) + len(start) > len(best[0])):
                    best = at + start, verdict
        return best


class Model:
    """Fitted trees, and the table of all suffixes' counts, broadcast if ``small``."""

    def __init__(self, trees: BoostedTrees, stats: SuffixStatistics, table: DataFrame, small: bool):
        self.trees, self.stats, self.table, self.small = trees, stats, table, small


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_rows: int = TRAIN_ROWS, **settings) -> Model:
    """Fit on labelled URLs (label 1: block); null urls or labels are left out.

    Suffixes are counted over all distinct URLs. The trees see ``max_rows`` of these at most: those with the least hashes.
    """
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y")).where("url is not null and y is not null")
    rows = rows.groupBy("url").agg(F.max("y").alias("y")).select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y")
    table, _ = store.settle(suffix_counts(rows), "suffixes")
    total = table.where("suffix is null").first()
    stats = SuffixStatistics(total["n"], total["blocked"]) if total else SuffixStatistics(0, 0)
    small = table.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES
    some = rows.withColumn("spread", F.xxhash64("url")).orderBy("spread", "url").limit(max_rows)
    got = sorted(with_counts(some, table, small).select("spread", "url", "host", "path", "n0", "k0", "n1", "k1", "y").collect())
    return Model(BoostedTrees(**settings).fit(matrix([r[1:8] for r in got], stats), np.array([r["y"] for r in got], float)), stats, table, small)


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule``, ``verdict``, ``block_probability``.

    verdict: that of the longest fitting rule, else block where the trees' probability reaches
    ``threshold``. A null or malformed url has empty host and path and is judged by the trees. Rows that
    repeat an id are judged each; an empty table gives an empty result; further columns are not read.
    """
    store.ship(pages.sparkSession)
    table, trees, stats = Rules(list(rules)), model.trees, model.stats
    key = pages.select(F.col(id_col)).schema[0].dataType.simpleString()
    names = [id_col, "host", "path", "rule", "verdict", "block_probability"]

    def run(batches):
        for batch in batches:
            urls = list(zip(*(batch.column(i).to_pylist() for i in range(1, 8))))
            chance = trees.probability(matrix(urls, stats))
            found = [table.find(u[1], u[2]) for u in urls]
            verdict = [f[1] if f else "block" if c >= threshold else "allow" for f, c in zip(found, chance)]
            arrays = [pa.array([f[0] if f else None for f in found], pa.string()), pa.array(verdict, pa.string()), pa.array(chance, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *arrays], names)

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.xxhash64(id_col, url_col).alias("spread"))
    rows = with_counts(rows, model.table, model.small).select("id", "url", "host", "path", "n0", "k0", "n1", "k1")
    return rows.mapInArrow(run, f"`{id_col}` {key}, host string, path string, rule string, verdict string, block_probability double")
