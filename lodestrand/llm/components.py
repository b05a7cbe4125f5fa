"""Connected components: each task shrinks its edges to a forest, one task joins forests that it can hold, alternating large-star and small-star steps join larger ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import store

#: Edges (some 40 MB) that one task may hold; more go through star steps, laid out so that Spark can split a hot key.
SPLIT_EDGES = 1_000_000
#: Types of nodes that have the same order in Arrow as in Spark.
_PLAIN = T.IntegralType, T.StringType, T.BinaryType


def least_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least node that edges (a, b) tie it to, itself if there is none."""
    root = np.arange(n)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


def _forest(batches):
    """(u, v) for every node u of the task's edges but the roots, v being the least node of its component in these edges."""
    from lodestrand.llm.components import SPLIT_EDGES, least_of

    names, held, kept, size = ["u", "v"], [], None, 0

    def shrunk(held):
        edges = pa.Table.from_batches(held)
        ends = pa.chunked_array(edges.column(0).chunks + edges.column(1).chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[ends.indices.to_numpy()]
        root = least_of(len(order), codes[: len(edges)], codes[len(edges) :])
        node = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(order[x])) for x in (node, root[node])], names)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= max(SPLIT_EDGES, 2 * (kept or 0)):
            held = [shrunk(held)]
            size = kept = held[0].num_rows
    if size:
        yield shrunk(held)


def _large_star(edges: DataFrame, split: bool) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours; as many rows as edges, some may repeat."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(store.detached(least, "u") if split else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, split: bool) -> DataFrame:
    """Every node and its lower neighbours are tied to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(store.detached(least, "u") if split else least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> tuple[DataFrame, str]:
    """(node, root) for every node of a link but the roots, root being the least node of its component; and the table's path.

    Links may repeat, be in either order or join a node to itself (ignored); nodes are of any ordered
    type. Rows with a null end are ignored. Each round writes its edges to the shared folder.
    """
    spark = links.sparkSession
    store.ship(spark)
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo)
    plain = all(isinstance(f.dataType, _PLAIN) for f in edges.schema)
    edges, path = store.settle(edges.mapInArrow(store.light(_forest), edges.schema) if plain else edges.distinct(), "edges")
    if plain and edges.count() <= SPLIT_EDGES:
        whole, whole_path = store.settle(edges.coalesce(1).mapInArrow(store.light(_forest), edges.schema), "edges")
        store.remove(spark, path)
        return whole.select(F.col("u").alias("node"), F.col("v").alias("root")), whole_path
    mark = _mark(edges)
    for _ in range(most):
        if not mark[0]:
            break
        split = mark[0] > SPLIT_EDGES
        after, next_path = store.settle(_small_star(_large_star(edges, split), split), "edges")
        store.remove(spark, path)
        edges, path, before, mark = after, next_path, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not found after {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), path


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(hashed), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
