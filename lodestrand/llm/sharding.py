"""Shards by weighted rendezvous hashing of stable record keys (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.llm import store

#: Ranges of keys into which the rows of all shards are cut for numbering.
RANGES = 256


def draw(key: Column, shard: int) -> Column:
    """52 bits, uniform in (0, 1), of the MD5 of key and shard number."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def owner(key: Column, weights: list[float]) -> Column:
    """The shard with the largest weight / -ln(draw); of equals the smallest. A shard added at the end takes rows only into itself."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: at least one shard, none negative, one positive")
    if len(set(weights)) == 1:  # the order of the scores is that of the draws
        scores = [F.struct(draw(key, i).alias("score"), F.lit(-i).alias("shard")) for i in range(len(weights))]
    else:
        scores = [F.struct((F.lit(float(w)) / -F.ln(draw(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return -(F.greatest(*scores)["shard"] if len(scores) > 1 else scores[0]["shard"])


def assign(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, grown: list[float] | None = None, ranges: int = RANGES) -> DataFrame:
    """Per row: the key, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    weights: of the shards, eight equal ones by default; grown: of the shards after growth, by
    default one more of weight 1. The shard depends on nothing but key and weights; rows that repeat
    a key share a shard. Slots count from 0 in each shard without gaps, in the order of key, then
    CRC and size (identical rows in any order). A null key is hashed as the text ``null`` and comes
    first. Null text has size 1 and the CRC of no bytes, 0. An empty table gives an empty result;
    further columns are not read.

    Slots: cut points of the keys, ``ranges`` at most, are computed in one aggregation; each
    (shard, range) is numbered by itself and shifted by the counts of the earlier ranges, so no
    task holds a whole shard. The table of shifts has at most shards * ranges rows.
    """
    weights = list(weights or [1.0] * 8)
    grown = list(grown or [*weights, 1.0])
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key_col).alias("k"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        owner(name, weights).alias("shard"), owner(name, grown).alias("grown_shard"),
    )
    numeric = dict(docs.dtypes)[key_col] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    place = F.col("k") if numeric else F.conv(F.substring(F.rpad(F.hex(F.col("k").cast("string")), 12, "0"), 1, 12), 16, 10).cast("double")
    cuts = docs.select(F.col(key_col).alias("k")).agg(F.percentile_approx(place, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # binary search over the cut points, as nested conditions log2(ranges) deep
    rows = rows.withColumn("part", F.coalesce(_search(place, cuts, 0), F.lit(-1)))
    rows, _ = store.settle(rows, "shards")
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col("k").asc_nulls_first(), "crc", "size")) - 1
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("shard", "part", before.alias("shift"))
    return rows.withColumn("inside", inside).join(F.broadcast(shifts), ["shard", "part"]).select(
        F.col("k").alias(key_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("shift") + F.col("inside")).cast("bigint").alias("slot"), "grown_shard",
    )


def _search(place: Column, cuts: list, base: int) -> Column:
    """The number of cut points that are at most ``place``; null stays null."""
    if not cuts:
        return F.when(place.isNotNull(), F.lit(base))
    mid = len(cuts) // 2
    return F.when(place < F.lit(cuts[mid]), _search(place, cuts[:mid], base)).when(place.isNotNull(), _search(place, cuts[mid + 1 :], base + mid + 1))
