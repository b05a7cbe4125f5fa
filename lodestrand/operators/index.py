"""TF-IDF index as long tables, and cosine retrieval as joins on terms.

``postings(doc, term, tf)``, ``df(term, df)`` and the norms come from one pass over the texts; a
query table is joined with the postings on the term, so only matching terms are touched and any
number of queries runs as one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import tokens
from lodestrand.sources.scratch import cut


def term_counts(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, term, tf): how often each term is in each text."""
    words = texts.select(*key, F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_counts(postings: DataFrame) -> DataFrame:
    """(term, df): in how many texts a term is."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n + 1) / (df + 1)) + 1


@dataclass
class TfIdfIndex:
    """Tables of an index; ``key`` names the columns that identify a text."""

    key: list[str]
    postings: DataFrame
    n_docs: int
    saved_norms: DataFrame | None = None
    terms: DataFrame | None = None

    @classmethod
    def build(cls, texts: DataFrame, key: list[str], text_col: str = "text") -> TfIdfIndex:
        """Texts are cut into terms once; the terms' counts and the postings are tables in the shared folder, which searches read."""
        counts = cut(term_counts(texts, key, text_col))
        n, terms = texts.count(), cut(document_counts(counts))
        weighted = counts.join(terms, "term").withColumn("w", (1 + F.ln("tf")) * idf(F.lit(n), F.col("df")))
        return cls(key, cut(weighted), n, terms=terms)

    def save(self, path: str) -> TfIdfIndex:
        """Write postings, sorted by term in each file, and norms as Parquet; searches of the index returned read only these."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.norms().withColumn("n_docs", F.lit(self.n_docs)).write.mode("overwrite").parquet(f"{path}/norms")
        return self.load(self.postings.sparkSession, path, self.key)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: list[str]) -> TfIdfIndex:
        norms = spark.read.parquet(f"{path}/norms")
        first = norms.select("n_docs").first()
        return cls(key, spark.read.parquet(f"{path}/postings"), first["n_docs"] if first else 0, norms.drop("n_docs"))

    def norms(self) -> DataFrame:
        return self.saved_norms if self.saved_norms is not None else self.postings.groupBy(*self.key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    def statistics(self) -> DataFrame:
        """One row: texts with terms, terms, postings."""
        return self.postings.agg(F.count_distinct(*self.key).alias("texts"), F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"))

    def scores(self, queries: DataFrame, query_id: str = "query_id", query_text: str = "query", min_score: float = 0.01) -> DataFrame:
        """(query_id, key, score) for every text with a cosine of ``min_score`` or more.

        Query terms that no text has are dropped; a query without terms gives no rows. Scores are
        rounded to 9 digits, so that order doesn't hang on the order of additions.
        """
        asked = term_counts(queries, [query_id], query_text).withColumnRenamed("tf", "qtf")
        known = self.terms if self.terms is not None else self.postings.join(asked.select("term").distinct(), "term", "left_semi").select("term", "df").distinct()
        asked = asked.join(known, "term").withColumn("qw", (1 + F.ln("qtf")) * idf(F.lit(self.n_docs), F.col("df"))).drop("df")
        lengths = asked.groupBy(query_id).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
        dots = asked.select(query_id, "term", "qw").join(self.postings, "term").groupBy(query_id, *self.key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
        found = dots.join(self.norms(), self.key).join(lengths, query_id)
        score = F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), 9)
        return found.select(query_id, *self.key, score.alias("score")).where(F.col("score") >= min_score)
