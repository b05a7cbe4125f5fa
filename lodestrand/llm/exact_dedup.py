"""Exact duplicate removal by sorting contents (DataFrame operations only).

Rows are range-partitioned on the leading normalised bytes with sampled splitters, sorted
externally inside each range by the whole text, and neighbouring rows are compared in full:
Spark's range partitioning counts as clustering, so the window over equal texts needs no second
exchange of the texts. The sample for the splitters holds heads and hashes, never whole texts. The
text's hash and a salt taken from the identifier are further sort keys, so neither a head that many
texts share nor a text that a third of all rows share lies in one range; the salted runs of one
text meet again as one short row each, keyed by the SHA-256 of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.llm import store

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 64
#: Leading characters by which splitters are chosen.
HEAD = 48


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _runs(rows: DataFrame, keep: str) -> DataFrame:
    """Rows with ``norm`` and ``id``: sorted by content; ``best``, ``n`` and ``rn`` of each (text, salt) run."""
    pick, order = (F.max, F.desc_nulls_last) if keep == "largest" else (F.min, F.asc_nulls_last)
    columns = [c for c in rows.columns if c != "norm"]
    rows = rows.select("*", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("mix"))
    run = Window.partitionBy("head", "mix", "salt", "norm")
    return rows.repartitionByRange("head", "mix", "salt").select(
        *columns, F.sha2(F.col("norm"), 256).alias("sha"), pick("id").over(run).alias("best"),
        F.count(F.lit(1)).over(run).alias("n"), F.row_number().over(run.orderBy(order("id"))).alias("rn"),
    )


def _winners(heads: DataFrame, keep: str) -> DataFrame:
    """One row per text: the identifier that stays, the group's size, and the salt of the run that holds it."""
    pick = F.max if keep == "largest" else F.min
    rank = F.struct(F.col("best").isNull(), F.col("best"), "salt") if keep != "largest" else F.struct(F.col("best").isNotNull(), F.col("best"), "salt")
    home = (F.max_by if keep == "largest" else F.min_by)("salt", rank)
    return heads.groupBy("sha").agg(pick("best").alias("keep_id"), F.sum("n").alias("group_size"), home.alias("home"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    keep: ``smallest`` or ``largest`` identifier of a group stays. Null text counts as empty and
    so equals other null or empty texts. A null identifier loses to any other; if a whole group has
    null identifiers, ``keep_id`` is null and one of its rows is kept. Rows that repeat an
    identifier within a group all count in ``group_size``; exactly one row per group is kept. An
    empty table gives an empty result. Only the two named columns are read, so further columns of
    any name do no harm. ``salts`` bounds the share of a hot text that one task holds.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    runs, _ = store.settle(_runs(rows, keep), "content-runs")  # ids and digests; the texts stay behind
    heads = runs.where("rn = 1").select("sha", "salt", "best", "n")
    # joined by (text, salt), so that the rows of a hot text stay spread
    per_run = heads.select("sha", "salt").join(_winners(heads, keep), "sha")
    return runs.join(per_run, ["sha", "salt"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        ((F.col("rn") == 1) & (F.col("salt") == F.col("home"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts and all its columns; cases as in :func:`duplicate_groups`."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), row.alias("row")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    runs, _ = store.settle(_runs(rows, keep).where("rn = 1").select("sha", "salt", "best", "n", "row"), "content-heads")
    winners = _winners(runs, keep).select("sha", F.col("home").alias("salt"))
    return runs.join(winners, ["sha", "salt"]).select("row.*")
