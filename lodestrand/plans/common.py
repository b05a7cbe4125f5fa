"""Registration of queries and shared SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.functions import lexicon as L


class Catalogue:
    """Queries by name, each with its SQL if there is one."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


#: Tokens of a text column, repeated as in the text.
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9-]+'), lambda w: length(w) > 2 AND NOT list_contains(" + sql_list(L.STOPWORDS) + ", w))"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)
