"""N-gram Jaccard join: rare-first prefix filtering, exact, without any pair of a group twice.

1. Each task turns its documents into sets of hashed word n-grams, collapses equal sets, and sends
   the sorted n-grams of a block of documents to ranges of the hash space, as packed arrays.
2. A range counts in how many sets each n-gram is and answers every block with those that are in
   two or more. An n-gram in one set only can't be in an intersection: it counts in a set's
   size, and as rarest of all it stands first in the order (frequency, hash).
3. A set of n can only be linked if its least frequent n - ceil(t n) + 1 n-grams, its prefix, hold
   one that a partner's prefix holds. Sets whose prefix is all single n-grams are done.
4. Star rounds: in every list of sets that share a prefix n-gram, sets outside the list's largest
   component are compared with one of that component's sets, a few lists for each set and round.
   Links make components, so that lists of similar sets shrink to one component and need no pairs.
5. Last, wherever a list still meets several components, every set outside the largest is compared
   with those it could link to: with a whole component at once, both packed in blocks of sets,
   where its lists hold much of that component; else as pairs, which pass the length and
   positional filters in the join, arise in one shared list, and are verified once (suffix filter,
   then the intersection). Pairs inside one component need no test: they change no component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lodestrand.llm import store
from lodestrand.llm.components import connected

WORDS, PERCENT = 5, 75
#: N-grams in a block of documents that is packed together.
BLOCK = 1_000_000
#: Star rounds at most, ended earlier by one that ties under 1% of the sets; lists a set is compared in in a round.
ROUNDS, CHOICES = 4, 4
#: Sets in a block that is compared with another block; n-grams by which two sets agree on one shared list.
PACK, SKETCH = 64, 16
#: Fixed odd multipliers of the words' places.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text; of the whole sequence if it is shorter; none without words.

    Words are runs of characters other than space and U+0009 to U+000D, after lower-casing A-Z.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out + h[i : len(parts) - n + 1 + i] * _ODD[i % 8] + np.uint64(i)) if i == n - 1 or i % 8 == 7 else out + h[i : len(parts) - n + 1 + i] * _ODD[i % 8]
    return np.unique(out)


def _planes(a: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first: high bytes of small numbers pack well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(hashes: np.ndarray, *rest: np.ndarray) -> bytes:
    """Sorted hashes as differences, and 32-bit arrays as long as they."""
    data = [_planes(np.diff(hashes, prepend=np.uint64(0))), *(_planes(r.astype(np.uint32)) for r in rest)]
    return np.uint64(len(hashes)).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(data))


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.uint64)[0])
    data = zstandard.ZstdDecompressor().decompress(blob[8:]) if n else b""
    if not n:
        return [np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)]
    out = [np.cumsum(_unplanes(data[: 8 * n], np.uint64), dtype=np.uint64)]
    return out + [_unplanes(data[i : i + 4 * n], np.uint32) for i in range(8 * n, len(data), 4 * n)]


def _need(n: int, percent: int) -> int:
    """The least intersection of a set of n with a set that it links to."""
    return -(-percent * n // 100)


class _Block:
    """Sets of some documents; equal sets once."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.ids: list[list] = []
        self.empty: list = []
        self.size = 0

    def add(self, ident, grams: np.ndarray) -> None:
        if not len(grams):
            self.empty.append(ident)
            return
        key = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
        if (i := self.at.get(key)) is None:
            self.at[key] = len(self.sets)
            self.sets.append(grams)
            self.ids.append([ident])
            self.size += len(grams)
        else:
            self.ids[i].append(ident)

    def rows(self, block: int, keys: list[int]):
        """The row with what the block's sets are, then a row for each range of hashes."""
        yield -1 - block, block, None, list(self.at), [len(s) for s in self.sets], self.ids, self.empty
        if not self.sets:
            return
        hashes = np.concatenate(self.sets)
        owners = np.repeat(np.arange(len(self.sets), dtype=np.uint32), [len(s) for s in self.sets])
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        starts = np.searchsorted(hashes, np.array([(r << 64) // len(keys) for r in range(len(keys))], np.uint64))
        for key, a, b in zip(keys, starts, [*starts[1:], len(hashes)]):
            if a < b:
                yield key, block, pack(hashes[a:b], owners[a:b]), None, None, None, None


_SENT = "part bigint, block bigint, blob binary, keys array<binary>, sizes array<int>, ids array<array<bigint>>, empty array<bigint>"
_SENT_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
_NAMES = ["part", "block", "blob", "keys", "sizes", "ids", "empty"]


def _sender(words: int, keys: list[int], most: int):
    def run(batches):
        from pyspark import TaskContext

        from lodestrand.llm.ngram_join import _Block, _sent, ngram_set

        block, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(ident, ngram_set(text.as_py(), words))
                if block.size >= most:
                    yield from _sent(block.rows(number, keys))
                    block, number = _Block(), number + 1
        if block.sets or block.empty:
            yield from _sent(block.rows(number, keys))

    return run


def _range_keys(spark, n: int) -> list[int]:
    """A key for each of n ranges of hashes, each dealt to a shuffle partition of its own."""
    by = spark.range(20 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("k")).collect()
    return [r["k"] for r in by] if len(by) == n else list(range(n))


def _sent(rows):
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SENT_TYPES)], _NAMES)


def _answer(table: pa.Table) -> pa.Table:
    """Of a range: for every block, its n-grams that are in two or more sets, with how many."""
    if table.column("part")[0].as_py() < 0:
        return table
    got = [unpack(b.as_py()) for b in table.column("blob")]
    hashes = np.concatenate([g[0] for g in got])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered)))
    df = np.empty(len(hashes), np.uint32)
    df[order] = np.repeat(counts, counts)
    out, at = [], 0
    for (h, owner), block in zip(got, table.column("block").to_pylist()):
        mine = df[at : at + len(h)]
        at += len(h)
        if (some := mine > 1).any():
            out.append((0, block, pack(h[some], owner[some], mine[some]), None, None, None, None))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_SENT_TYPES)], _NAMES)


def _trimmed(answer):
    """``answer``, a function for applyInArrow, after which a worker keeps no freed memory."""

    def run(table: pa.Table) -> pa.Table:
        from lodestrand.llm.store import trim

        out, large = answer(table), table.nbytes > 1 << 18
        del table
        if large:
            trim()
        return out

    return run


_SETS = "digest binary, n int, ids array<bigint>, singles int, prefix binary, members binary"


def _assembler(percent: int):
    def run(table: pa.Table) -> pa.Table:
        from lodestrand.llm.ngram_join import _need, unpack

        head = next(r for r in table.select(["blob", "keys", "sizes", "ids", "empty"]).to_pylist() if r["blob"] is None)
        keys, sizes = head["keys"], head["sizes"]
        got = [unpack(b.as_py()) for b in table.column("blob") if b.is_valid]
        cols = [[], [], [], [], [], []]
        if got:
            h, owner, df = (np.concatenate([g[i] for g in got]) for i in range(3))
            order = np.lexsort((h, df, owner))
            h, owner = h[order], owner[order]
            starts = np.searchsorted(owner, np.arange(len(keys) + 1))
        else:
            h, starts = np.empty(0, np.uint64), np.zeros(len(keys) + 1, int)
        for i, (key, n, ids) in enumerate(zip(keys, sizes, head["ids"])):
            common = h[starts[i] : starts[i + 1]]
            singles, need = n - len(common), _need(n, percent)
            able = len(common) >= need
            row = (key, n, ids, singles, common[: n - need + 1 - singles].tobytes() if able else None, np.sort(common).tobytes() if able else None)
            for c, v in zip(cols, row):
                c.append(v)
        if head["empty"]:
            for c, v in zip(cols, (None, 0, head["empty"], 0, None, None)):
                c.append(v)
        kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["digest", "n", "ids", "singles", "prefix", "members"])

    return run


def _entries(batches):
    """A row for each n-gram of a prefix, with its place among the set's common n-grams."""
    names = ["h", "digest", "n", "singles", "at"]
    for batch in batches:
        for digest, n, singles, prefix in zip(*(c.to_pylist() for c in batch.columns)):
            h = np.frombuffer(prefix, np.uint64).view(np.int64)
            fill = lambda v, t: pa.array([v] * len(h), t)
            yield pa.RecordBatch.from_arrays([pa.array(h), fill(digest, pa.binary()), fill(n, pa.int32()), fill(singles, pa.int32()), pa.array(np.arange(len(h), dtype=np.int32))], names)


#: Cuts of the hash space for the suffix filter.
_CUTS = np.array([i << 60 for i in range(1, 16)], np.uint64)


def _verifier(percent: int):
    def run(batches):
        from lodestrand.llm.ngram_join import _CUTS

        for batch in batches:
            keep = []
            for na, a, nb, b in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
                total = na.as_py() + nb.as_py()
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                # suffix filter: equal n-grams lie in equal parts of the hash space
                parts = [np.diff(np.searchsorted(s, _CUTS), prepend=0, append=len(s)) for s in (x, y)]
                if (100 + percent) * int(np.minimum(*parts).sum()) < percent * total:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (total - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda x: nodes.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(f"members_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "members_a", "n_b", "members_b")
    return joined.mapInArrow(store.light(_verifier(percent)), "a binary, b binary")


def _block_verifier(percent: int):
    """Links between two blocks of sets: the members' n-grams are sorted once, each other set looks its own up."""

    def run(batches):
        for batch in batches:
            for ours, theirs in zip(batch.column(0), batch.column(1)):
                ours, theirs = ours.as_py(), theirs.as_py()
                sets = [np.frombuffer(t["members"], np.uint64) for t in theirs]
                sizes = np.array([t["n"] for t in theirs], np.int64)
                hashes = np.concatenate(sets)
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
                a, b = [], []
                for o in ours:
                    mine = np.frombuffer(o["members"], np.uint64)
                    low, high = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, side="right")
                    hits = owner[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())]
                    both = np.bincount(hits, minlength=len(sets))
                    for i in np.flatnonzero(100 * both >= percent * (sizes + o["n"] - both)):
                        a.append(o["digest"])
                        b.append(theirs[i]["digest"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _with_root(rows: DataFrame, forest: DataFrame | None) -> DataFrame:
    """Adds ``root``: the node's component, itself if it has none."""
    if forest is None:
        return rows.withColumn("root", F.col("digest"))
    return rows.join(forest.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def _live(entries: DataFrame, forest: DataFrame | None, turn: int) -> DataFrame:
    """Entries of the lists that meet several components, with ``main``: the list's largest component, its size in the list, and one of its sets, another each turn."""
    rows = _with_root(entries, forest)
    cells = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("digest", "n"), F.xxhash64("digest", F.lit(turn))).alias("p"))
    lists = cells.groupBy("h").agg(F.max_by(F.struct("root", "k", "p.digest", "p.n"), F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    return rows.join(store.detached(lists.where("roots > 1").select("h", "main"), "h"), "h")


def _stars(live: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): sets outside their lists' largest component with a set of it, in CHOICES lists."""
    outside = live.where(f"root <> main.root and 100L * least(n, main.n) >= {percent}L * greatest(n, main.n)")
    order = F.array_sort(F.collect_list(F.struct(F.xxhash64("h", F.lit(turn)).alias("o"), F.col("main.digest").alias("d"))))
    chosen = outside.groupBy("digest").agg(F.slice(F.array_distinct(F.transform(order, lambda x: x["d"])), 1, CHOICES).alias("ds"))
    return chosen.select("digest", F.explode("ds").alias("d")).select(F.least("digest", "d").alias("a"), F.greatest("digest", "d").alias("b")).distinct()


def _packed(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(root, name): sets (digest, root) in blocks of about PACK."""
    count = rows.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("c") / PACK).cast("bigint"))
    rows = rows.join(store.detached(count, "root"), "root").withColumn("part", part).join(nodes.select("digest", "n", "members"), "digest")
    return rows.groupBy("root", "part").agg(F.collect_list(F.struct("digest", "n", "members")).alias(name)).drop("part")


def _last_links(live: DataFrame, nodes: DataFrame, forest: DataFrame, tested: DataFrame, percent: int, paths: list[str]) -> DataFrame:
    """(a, b): links between components that remain."""
    outside = live.where("root <> main.root")
    sizes = forest.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    reach = outside.groupBy("digest", F.col("main.root").alias("root")).agg(F.sum("main.k").alias("met")).join(store.detached(sizes, "root"), "root", "left")
    reach, path = store.settle(reach.select("digest", "root", (F.col("met") >= F.coalesce("size", F.lit(1))).alias("dense")), "ngram-reach")
    paths.append(path)
    dense = reach.where("dense").select("digest", "root")
    members = _with_root(nodes.select("digest"), forest).join(store.detached(dense.select("root").distinct(), "root"), "root", "left_semi")
    blocks = _packed(dense, nodes, "ours").join(_packed(members, nodes, "theirs"), "root").select("ours", "theirs")
    links, path = store.settle(blocks.mapInArrow(store.light(_block_verifier(percent)), "a binary, b binary"), "ngram-links")
    paths.append(path)

    sketch = live.groupBy("digest").agg(F.slice(F.array_sort(F.collect_list("h")), 1, SKETCH).alias("sketch"))
    sided = live.join(sketch, "digest")
    thin = reach.where("not dense").select("digest", F.col("root").alias("main_root"), F.lit(True).alias("thin"))
    x = sided.where("root <> main.root").withColumn("main_root", F.col("main.root")).join(thin, ["digest", "main_root"], "left").withColumn("thin", F.coalesce("thin", F.lit(False))).alias("x")
    # n-grams before this one that both can hold, this one, and those behind it
    bound = "(least(x.at, y.at) + 1 + least(x.n - x.singles - x.at, y.n - y.singles - y.at) - 1)"
    meet = f"""x.h = y.h and x.root <> y.root and ((y.root = x.main_root and x.thin) or (y.root <> x.main_root and x.digest < y.digest))
        and 100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n) and {100 + percent}L * {bound} >= {percent}L * (x.n + y.n)
        and coalesce(x.h = array_min(array_intersect(x.sketch, y.sketch)), true)"""
    pairs = x.join(sided.alias("y"), F.expr(meet)).select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")).distinct()
    pairs, path = store.settle(pairs.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
    paths.append(path)
    return links.unionByName(_verified(pairs, nodes, percent))


def _grow(forest: DataFrame | None, links: DataFrame, paths: list[str]) -> DataFrame:
    """Components of the forest so far and more links."""
    edges = links if forest is None else links.unionByName(forest.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grown, path = connected(edges)
    paths.append(path)
    return grown


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``; ``doc_id`` is the identifier as bigint.

    Two rows link when 100 * intersection >= percent * union of their sets of word n-grams.
    component_id is the smallest identifier reachable by links. Null or empty text, or text without
    words, has 0 n-grams, links with nothing and is its own component. Rows with equal sets link. A
    null identifier takes part as a row, but never is a component's; a component of null identifiers
    only has component_id null. Rows that repeat an identifier are rows of their own. An empty table
    gives an empty result; only the two named columns are read. Texts are read whole.
    """
    spark = docs.sparkSession
    store.ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(store.light(_sender(words, _range_keys(spark, store.shuffle_parts(spark)), block)), _SENT)
    answered = sent.groupBy("part").applyInArrow(_trimmed(_answer), _SENT)
    sets, sets_path = store.settle(answered.groupBy("block").applyInArrow(_trimmed(_assembler(percent)), _SETS), "ngram-sets")
    first = [F.first(c).alias(c) for c in ("n", "singles", "prefix", "members")]
    nodes, nodes_path = store.settle(sets.where("prefix is not null").select("digest", "n", "singles", "prefix", "members").groupBy("digest").agg(*first), "ngram-nodes")
    entries = nodes.select("digest", "n", "singles", "prefix").mapInArrow(store.light(_entries), "h bigint, digest binary, n int, singles int, at int")
    paths, columns = [sets_path, nodes_path], entries.columns

    forest, tested, tied, n_nodes = None, None, 0, nodes.count()
    for turn in range(ROUNDS):
        live, path = store.settle(_live(entries, forest, turn), "ngram-live")
        paths.append(path)
        entries = live.select(*columns)  # a list of one component stays one
        stars = _stars(live, percent, turn)
        stars, path = store.settle(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"), "ngram-stars")
        paths.append(path)
        tested = stars if tested is None else tested.unionByName(stars)
        forest = _grow(forest, _verified(stars, nodes, percent), paths)
        before, tied = tied, forest.count()
        if 100 * (tied - before) < n_nodes:
            break
    live, path = store.settle(_live(entries, forest, ROUNDS), "ngram-live")
    paths.append(path)
    forest = _grow(forest, _last_links(live, nodes, forest, tested, percent, paths), paths)

    least = sets.where("digest is not null").select("digest", F.array_min(F.filter("ids", lambda x: x.isNotNull())).alias("low")).groupBy("digest").agg(F.min("low").alias("low"))
    rooted = _with_root(least, forest)
    roots = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_set = rooted.join(store.detached(roots, "root"), "root").select("digest", "component_id")
    # a set's copies are still lists, a few rows a set, when they are joined
    out = sets.select("digest", "n", "ids").join(of_set, "digest", "left").select(F.explode("ids").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.col("digest").isNull().alias("alone"), "component_id")
    done, _ = store.settle(out.select("doc_id", "n_shingles", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "ngram-components")
    store.remove(spark, *paths)
    return done


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the row of the smallest identifier of every component; all rows of a component without identifiers, and all rows that repeat a kept identifier, stay."""
    found = linked_sets(docs, id_col, text_col, words, percent)
    dropped = found.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select("doc_id").distinct()
    return docs.join(dropped, docs[f"`{id_col}`"].cast("bigint") == dropped["doc_id"], "left_anti")
