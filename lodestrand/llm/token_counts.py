"""Edit-aware token counts: a segment tree of pre-tokens per document.

The leaves hold runs of pre-tokens with the token count of each, the inner nodes the sums. An edit
re-splits from the last pre-token that can't depend on it until a new boundary meets an old one;
only pre-tokens that weren't there before are encoded, and only the sums above the touched leaves
change. A leaf that grows too long becomes a subtree; a tree that grows too deep is put together
anew from its leaves, whose counts stay. The edits of many documents go side by side, so that new
pre-tokens are encoded together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import bpe, store

#: What a pre-token's end can depend on: a run of white space gives back its last character if a
#: word follows, so the split at p is decided by the text before p + 2.
LOOKAHEAD = 2
LEAF = 64
#: Pieces remembered by a worker: two generations of these, some 60 MB each.
MAX_PIECES = 250_000


class _Node:
    """A leaf with ``pieces`` and the token count of each, or an inner node; sums of characters and tokens."""

    __slots__ = ("chars", "counts", "left", "pieces", "right", "tokens", "up")

    def fill(self, pieces: list[str], counts: list[int]) -> _Node:
        self.left = self.right = None
        self.pieces, self.counts, self.chars, self.tokens = pieces, counts, sum(map(len, pieces)), sum(counts)
        return self

    def join(self, left: _Node, right: _Node) -> _Node:
        self.pieces = self.counts = None
        self.left, self.right, self.chars, self.tokens = left, right, left.chars + right.chars, left.tokens + right.tokens
        left.up = right.up = self
        return self


def _over(nodes: list[_Node]) -> _Node:
    """A balanced tree over the nodes, in order."""
    while len(nodes) > 1:
        nodes = [_Node().join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def _grown(pieces: list[str], counts: list[int]) -> _Node:
    return _over([_Node().fill(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, max(1, len(pieces)), LEAF)])


class CountTree:
    """The pre-tokens of one text in leaves of about ``LEAF``; ``count`` is its number of tokens.

    ``encoded`` adds the characters of the pieces that were counted after the tree was built. ``of``: the
    tokens of all pieces of the text, if they are known.
    """

    def __init__(self, text: str, encoder: bpe.Encoder, pattern, of: dict[str, tuple[int, ...]] | None = None, pieces: list[str] | None = None):
        self.encoder, self.pattern, self.encoded = encoder, pattern, 0
        pieces = pattern.findall(text) if pieces is None else pieces
        of = encoder.learn(set(pieces)) if of is None else of
        self._root(_grown(pieces, list(map(len, map(of.__getitem__, pieces)))))

    def _root(self, node: _Node) -> None:
        self.root = node
        node.up = None

    @property
    def count(self) -> int:
        return self.root.tokens

    @property
    def length(self) -> int:
        return self.root.chars

    def _nodes(self) -> Iterator[_Node]:
        """The leaves in order."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.pieces is None:
                todo += (node.right, node.left)
            else:
                yield node

    @property
    def leaves(self) -> list[list[str]]:
        return [n.pieces for n in self._nodes()]

    def text(self) -> str:
        return "".join(chain.from_iterable(self.leaves))

    def _leaf_at(self, pos: int) -> tuple[_Node, int]:
        """The leaf that holds character ``pos`` and where it starts; at the end, the last leaf with text."""
        node, start = self.root, 0
        pos = max(0, min(pos, self.length - 1))
        while node.pieces is None:
            if pos < start + node.left.chars:
                node = node.left
            else:
                start += node.left.chars
                node = node.right
        return node, start

    @staticmethod
    def _next(node: _Node) -> _Node:
        while node is node.up.right:
            node = node.up
        node = node.up.right
        while node.pieces is None:
            node = node.left
        return node

    def prepare(self, start: int, end: int, new: str) -> tuple:
        """What replacing the characters from ``start`` up to ``end`` (both cut to the text) asks for; its last item: the pieces to count."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        leaf, base = self._leaf_at(max(0, start - LOOKAHEAD))
        touched, old, counts = [leaf], list(leaf.pieces), list(leaf.counts)
        stops = [base, *(base + x for x in accumulate(map(len, old)))]
        keep = max(0, bisect_right(stops, start - LOOKAHEAD) - 1)
        met = None
        while met is None:  # take leaves until the new split meets an old boundary behind the edit
            while not (closed := stops[-1] == self.length) and stops[-1] < end:
                self._more(touched, old, counts, stops)
            body, from_, shift = "".join(old[keep:]), stops[keep], len(new) - (end - start)
            text = body[: start - from_] + new + body[end - from_ :]
            made, pos, least = [], from_, start + len(new)
            safe = from_ + len(text) - (0 if closed else LOOKAHEAD)
            for m in self.pattern.finditer(text):
                stop = from_ + m.end()
                if stop > safe:
                    break
                made.append(m.group())
                pos = stop
                if pos >= least and stops[at := bisect_left(stops, pos - shift)] == pos - shift:
                    met = at
                    break
            if met is None:
                if closed:
                    met = len(old)
                else:
                    self._more(touched, old, counts, stops)
        had = dict(zip(old[keep:met], counts[keep:met]))
        return touched, old, counts, keep, met, made, had, {p for p in made if p not in had}

    def _more(self, touched: list, old: list, counts: list, stops: list) -> None:
        touched.append(self._next(touched[-1]))
        for p in touched[-1].pieces:
            old.append(p)
            stops.append(stops[-1] + len(p))
        counts += touched[-1].counts

    def apply(self, plan: tuple, of: dict[str, tuple[int, ...]]) -> None:
        """Does what was prepared; ``of`` has the tokens of the pieces to count."""
        touched, old, counts, keep, met, made, had, fresh = plan
        self.encoded += sum(map(len, fresh))
        pieces = old[:keep] + made + old[met:]
        counts = counts[:keep] + [had[p] if p in had else len(of[p]) for p in made] + counts[met:]
        each = -(-len(pieces) // len(touched))
        for i, leaf in enumerate(touched):
            self._put(leaf, pieces[i * each : (i + 1) * each], counts[i * each : (i + 1) * each])

    def _put(self, leaf: _Node, pieces: list[str], counts: list[int]) -> None:
        chars, tokens = leaf.chars, leaf.tokens
        if len(pieces) <= 4 * LEAF:
            leaf.fill(pieces, counts)
        else:
            grown = _grown(pieces, counts)
            leaf.join(grown.left, grown.right)
        up, depth = leaf.up, 0
        while up is not None:
            up.chars += leaf.chars - chars
            up.tokens += leaf.tokens - tokens
            up, depth = up.up, depth + 1
        if leaf.pieces is None and depth > 64:
            self._root(_over(list(self._nodes())))

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` up to ``end`` (both cut to the text)."""
        plan = self.prepare(start, end, new)
        self.apply(plan, self.encoder.learn(plan[-1]))


def count_batch(texts: list[str], edits: list[list[dict]], encoder: bpe.Encoder, pattern) -> Iterator[tuple[int, CountTree]]:
    """Each text's count before its edits, and its tree after them; the first edits of all texts go together, then the second, and so on."""
    split = [pattern.findall(t) for t in texts]
    of = encoder.learn(set(chain.from_iterable(split)))
    trees = [CountTree("", encoder, pattern, of, s) for s in split]
    before = [t.count for t in trees]
    for turn in range(max(map(len, edits), default=0)):
        plans = [(t, t.prepare(e[turn]["start"] or 0, e[turn]["stop"] or 0, e[turn]["text"] or "")) for t, e in zip(trees, edits) if turn < len(e)]
        of = encoder.learn(set().union(*(plan[-1] for _, plan in plans)))
        for tree, plan in plans:
            tree.apply(plan, of)
    return zip(before, trees)


def _edits(column: pa.ListArray) -> Iterator[list[dict]]:
    """Each row's edits without nulls, by whole columns of their parts."""
    parts = column.flatten()
    names = ("start", "stop", "text")
    flat = [dict(zip(names, x)) if known else None for known, *x in zip(parts.is_valid().to_pylist(), *(parts.field(n).to_pylist() for n in names))]
    at = 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield [e for e in flat[at : at + n] if e is not None]
        at += n


def count_with_edits(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Per row: id, ``n_tokens`` (before), ``n_edits``, ``n_tokens_after``, ``encoded_chars``, ``text_sha256``.

    edits_col: an array of (start, stop, text) structs, applied in order, each in the characters of the
    text as the edits before it left it; places outside the text are cut to it. Null edits, or one that
    is null, change nothing; a null replacement is empty. Null text counts as empty. encoded_chars:
    characters of the pre-tokens that the edits caused to be counted, those not among the ones they replace. text_sha256: of the edited text. Rows that
    repeat an identifier are counted each; an empty table gives an empty result; further columns are
    not read.
    """
    spark = docs.sparkSession
    store.ship(spark)
    ranks = bpe.vocabulary(spark, ranks_path)
    key = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    names = [id_col, "n_tokens", "n_edits", "n_tokens_after", "encoded_chars", "text_sha256"]

    def run(batches):
        from lodestrand.llm.bpe import batched, codec
        from lodestrand.llm.token_counts import MAX_PIECES, _edits, count_batch

        encoder, split = codec(ranks.value, pattern, MAX_PIECES)[0], regex.compile(pattern)
        for batch in batches:
            rows, asked = [], _edits(batch.column(2))
            for texts in batched(x.as_py() or "" for x in batch.column(1)):
                edits = [next(asked) for _ in texts]
                for (before, tree), done in zip(count_batch(texts, edits, encoder, split), edits):
                    rows.append((before, len(done), tree.count, tree.encoded, hashlib.sha256(tree.text().encode()).hexdigest()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    schema = f"`{id_col}` {key}, n_tokens bigint, n_edits int, n_tokens_after bigint, encoded_chars bigint, text_sha256 string"
    edits = F.col(edits_col).cast("array<struct<start:bigint,stop:bigint,text:string>>")
    return docs.select(F.col(id_col), F.col(text_col).cast("string"), edits).mapInArrow(run, schema)


def scripted_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edits): four edits of each document at places hashed from its identifier: insert, delete, replace, append."""
    n = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    at = lambda tag: F.pmod(F.crc32(F.concat_ws(":", F.lit(tag), name).cast("binary")), n + 1)
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("stop"), F.lit(t).alias("text"))
    zero = F.lit(0).cast("bigint")
    script = F.array(
        edit(at("insert"), at("insert"), " a new passage,\n\n  twice  spaced, isn't it?"), edit(at("delete"), at("delete") + 40, ""),
        edit(at("replace"), at("replace") + 7, "Été 2025"), edit(zero + (1 << 40), zero + (1 << 40), " end\n"),
    )
    return docs.select(F.col(id_col), F.col(text_col), script.alias("edits"))
