"""Citation marks: [N] for passages, [WN] for web results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import all_matches, let, tidy

MARK = r"\[(\d+)\]"


def cited_ids(text: Column) -> Column:
    """Numbers cited, each once, in order of first appearance. Of over 18 digits: null."""
    return F.array_distinct(F.transform(all_matches(text, MARK, 1), lambda x: x.try_cast("bigint")))


def rebuild(text: Column, mark) -> Column:
    """The text with every [N] replaced by ``mark(N as bigint, position from 0)``."""
    parts = F.struct(F.split(text, MARK).alias("pieces"), F.transform(all_matches(text, MARK, 1), lambda x: x.try_cast("bigint")).alias("ids"))
    tail = lambda v: F.transform(v["ids"], lambda x, i: F.concat(mark(x, i), F.get(v["pieces"], i + 1)))
    return let(parts, lambda v: F.concat(F.get(v["pieces"], F.lit(0)), F.array_join(tail(v), "")))



def sanitized(text: Column, n_valid: Column) -> Column:
    """struct(text, invalid_ids): [N] outside 1..n_valid go, blanks are tidied; the removed numbers sorted."""
    bad = lambda x: x.isNull() | (x < 1) | (x > n_valid)
    kept = rebuild(text, lambda x, _: F.when(bad(x), "").otherwise(F.concat(F.lit("["), x.cast("string"), F.lit("]"))))
    return F.struct(tidy(kept).alias("text"), F.array_sort(F.filter(cited_ids(text), bad)).alias("invalid_ids"))


def renumbered(text: Column, n_refs: Column) -> Column:
    """Numbers in order of first appearance; those past ``n_refs`` different ones stay as they are."""
    def again(order: Column) -> Column:
        def mark(x: Column, _) -> Column:
            at = F.array_position(order, x)
            return F.concat(F.lit("["), F.when(at <= n_refs, at).otherwise(x).cast("string"), F.lit("]"))

        return rebuild(text, mark)

    return F.when(n_refs <= 0, text).otherwise(let(cited_ids(text), again))
