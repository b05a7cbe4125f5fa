"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

A source with n of N rows and target weight w gets the mean repetition rate w * size / n. Each
document's count is the inverse of the Poisson distribution of that rate at a uniform number
hashed from seed and identifier; the document is exploded by its count, and the copies are
ordered globally by a hash of seed, identifier and copy number. A source's distribution function
is made once, around its mode, and every document finds its count in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.llm import store

#: Up to so many values of all distribution functions (8 bytes each) they are broadcast; beyond, they are joined by salted keys.
BROADCAST_VALUES = 1_000_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distributions(rates: DataFrame) -> DataFrame:
    """``rates`` (source, n, rate) with ``first`` and ``cdf``: the Poisson(rate) distribution function from k = first on.

    ``first`` lies so far below the mode that what is before it is nothing in a double, and the values end so far
    above it that more change nothing. The first term comes from Stirling's series, the others from
    the logarithms of rate / k added up, so no rate is too large for a double.
    """
    rate, reach = F.col("rate"), 12 * F.sqrt("rate") + 30
    rows = rates.where("rate > 0").withColumn("first", F.greatest(F.floor(rate - reach), F.lit(0)).cast("bigint"))
    at = F.greatest(F.col("first"), F.lit(1)).cast("double")
    far = at * F.ln(rate / at) + at - rate - F.ln(2 * math.pi * at) / 2 - 1 / (12 * at) + 1 / (360 * at * at * at)
    rows = rows.withColumn("start", F.when(F.col("first") > 0, far).otherwise(-rate))
    terms = rows.select("source", "n", "rate", "first", "start", F.explode(F.sequence("first", F.ceil(rate + reach).cast("bigint"))).alias("k"))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") > F.col("first"), F.ln(rate / F.col("k"))).otherwise(F.lit(0.0))
    terms = terms.withColumn("p", F.exp(F.col("start") + F.sum(step).over(up_to))).withColumn("c", F.sum("p").over(up_to))
    return terms.groupBy("source", "n", "rate", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def poisson_inverse(u: Column, first: Column, cdf: Column) -> Column:
    """The least k whose distribution function exceeds u: as many values as don't lie behind ``first``."""
    return (first + F.size(F.filter(cdf, lambda c: c <= u))).cast("int")


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, temperature: float, size: float | None) -> DataFrame:
    """(source, n, rate). Weights not given are n ** temperature; all are scaled to sum to 1."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is not None:
        pairs = [x for s, w in sorted(weights.items()) for x in (F.lit(s), F.lit(float(w)))]
        table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    counts, _ = store.settle(counts.select("source", "n", weight.alias("w")), "sources")
    all_w, all_n = counts.agg(F.sum("w"), F.sum("n")).first()
    scale = (float(all_n or 0) if size is None else float(size)) / all_w if all_w else 0.0
    return counts.select("source", "n", (F.col("w") * F.lit(scale) / F.col("n")).alias("rate"))


def poisson_mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None,
    temperature: float = 0.5, size: float | None = None, seed: int = 42, info: bool = True,
) -> DataFrame:
    """All columns of ``docs`` for each copy, globally shuffled; with ``info`` also a struct ``mix``.

    weights: target weight by source, summing to any positive number; a source without one gets no
    rows. Without weights a source's weight is its row count to the power ``temperature``. size: the
    expected number of rows returned, by default that of the input. ``mix`` holds rate, n_copies,
    copy (from 0) and shuffle_key. The null source is a source of its own. Rows with a null
    identifier are seeded as the text ``null``; rows that repeat an identifier draw the same
    number, each for itself. An empty table gives an empty result. Columns of any name are kept as they are.
    """
    rates, _ = store.settle(distributions(source_rates(docs, source_col, weights, temperature, size)), "rates")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(row, F.col(source_col).alias("source"), ident.alias("ident"))
    if (rates.agg(F.sum(F.size("cdf") + F.lit(8))).first()[0] or 0) <= BROADCAST_VALUES:
        joined = rows.join(F.broadcast(rates), rows["source"].eqNullSafe(rates["source"]))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)))
        spread = rates.withColumn("salt2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = salted.join(spread, salted["source"].eqNullSafe(spread["source"]) & (F.col("salt") == F.col("salt2")))
    count = poisson_inverse(uniform(F.lit(str(seed)), F.col("ident")), F.col("first"), F.col("cdf"))
    copies = joined.select("row", "ident", "rate", count.alias("n_copies")).where("n_copies > 0")
    copies = copies.select("*", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col("ident"), F.col("copy").cast("string")))
    copies = copies.withColumn("shuffle_key", key).orderBy("shuffle_key", "ident", "copy")
    mix = [F.struct("rate", "n_copies", "copy", "shuffle_key").alias("mix")] if info else []
    return copies.select("row.*", *mix)
