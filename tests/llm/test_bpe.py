import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def made():
    with open(PATH, "rb") as f:
        data = f.read()
    encoder, decoder = bpe.codec(data, P.PATTERN)
    return encoder, decoder, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})


ODD = ["", " ", "   ", "a", "it's we'll", "\n\n  x", "é日本🙂", "<|endoftext|>", "a" * 5000, "=" * 3000, "\x00\x01", "​﻿", " tail   ", "x\r\n\ty"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(made, text):
    encoder, decoder, reference = made
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and decoder.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(made, text):
    encoder, decoder, reference = made
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and decoder.decode(ids) == text


def test_pairs_against_the_definition(made):
    fst, rng = made[0].fst, random.Random(1)
    keys = sorted(fst.bytes_of)
    for _ in range(20_000):
        a, b = rng.choice(keys[: 3000 if rng.random() < 0.5 else None]), rng.choice(keys[: 3000 if rng.random() < 0.5 else None])
        assert fst._apart(a, b) == (bpe.merge_by_rank(fst.bytes_of[a] + fst.bytes_of[b], fst.ranks) == [a, b])


def test_small_tables_change_nothing(made):
    with open(PATH, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    small = bpe.Encoder(ranks, P.PATTERN, max_pieces=3)
    small.fst.max_states, small.fst.max_pairs = 5, 3
    text = "Several words, several thousand words: internationalisation's wordplay " * 3
    assert small.encode(text) == made[2].encode_ordinary(text)


def test_lookahead_is_bounded(made):
    """Tokens come out while the piece is read: no state holds more bytes than a few longest tokens."""
    fst = made[0].fst
    state = fst.states[0]
    for byte in b"internationalisation" * 40:
        state, _ = fst._step(state, byte)
        assert max(sum(len(fst.bytes_of[t]) for t in path) + len(rest) for path, rest in zip(state[1::2], state[2::2])) < 130


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=20))
def test_utf8_in_pieces(data, cuts):
    stream, out, at = bpe.Utf8Stream(), [], 0
    for c in cuts:
        out.append(stream.feed(data[at : at + c]))
        assert len(stream.waiting) <= 3
        at += c
    out += [stream.feed(data[at:]), stream.close()]
    assert "".join(out) == data.decode("utf-8", "replace")


def test_column(spark, made):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "again"), (None, "x" * 100_000), (4, "Ünï")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "2 as ids")
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.encode_column(df, PATH, P.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = made[2].encode_ordinary(t or "")
        r = got[i, len(ids)]
        assert r["ids"] == ids and r["exact"]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_column(df.limit(0), PATH, P.PATTERN).count() == 0


# --- edits -------------------------------------------------------------------------------------------

PIECES = ["a", "be", "th ", "in", "g", " ", "  ", "A", "1", "23", ".", "..", "-", "é", "日", "🙂", "\n", "\n\n", "\t", "'s", "'", "s", "word word ", "    "]


def test_edits_against_counting_anew(made):
    encoder, _, reference = made
    rng, split = random.Random(3), regex.compile(P.PATTERN)
    text = lambda n: "".join(rng.choice(PIECES) for _ in range(n))
    for _ in range(150):
        s = text(rng.choice([0, 1, 5, 60, 600, 1500]))
        tree = token_counts.CountTree(s, encoder, split)
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(-2, len(s) + 2)
            b, new = a + rng.choice([0, 0, 1, 2, 30, 500]), text(rng.choice([0, 1, 2, 9]))
            low = max(0, min(a, len(s)))
            s = s[:low] + new + s[max(low, min(b, len(s))) :]
            tree.replace(a, b, new)
            assert tree.text() == s and tree.count == len(reference.encode_ordinary(s)) and [p for x in tree.leaves for p in x] == split.findall(s)


def test_only_the_touched_region_is_encoded(made):
    tree = token_counts.CountTree("some words here " * 5000, made[0], regex.compile(P.PATTERN))
    tree.replace(40_000, 40_003, "other")
    assert 0 < tree.encoded < 40


def test_no_more_reaches_the_transducer_than_is_reported(made):
    """Long words aren't remembered, large inserts grow the tree: neither counts again what it had."""
    encoder, sent = made[0], []
    many, one = encoder.fst.encode_many, encoder.fst.encode
    spied = bpe.Encoder(encoder.fst.ranks, P.PATTERN, max_pieces=10)
    spied.fst.encode_many = lambda pieces: sent.extend(pieces) or many(pieces)
    spied.fst.encode = lambda piece: sent.append(piece) or one(piece)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    for text, edits in (
        (" ".join(word(100) for _ in range(60)), [(3000, 3001, "x")]),
        (" ".join(word(7) for _ in range(20_000)), [(50_000, 50_000, " ".join(word(7) for _ in range(400))), (10, 12, "q"), (50_100, 90_000, "")]),
    ):
        tree = token_counts.CountTree(text, spied, regex.compile(P.PATTERN))
        for a, b, new in edits:
            sent.clear()
            before = tree.encoded
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert sum(map(len, sent)) <= tree.encoded - before <= len(new) + 250
        assert tree.text() == text and tree.count == len(made[2].encode_ordinary(text))


def test_trees_stay_shallow(made):
    tree, text = token_counts.CountTree("", made[0], regex.compile(P.PATTERN)), ""
    for _ in range(150):
        new = "a b c d e f " * 60
        tree.replace(len(text), len(text), new)
        text += new
    node, depth = tree.root, 0
    while node.pieces is None:
        node, depth = node.right, depth + 1
    assert tree.text() == text and depth <= 80


def test_a_piece_that_is_a_token(made):
    """A rank file with a token that no merges lead to: tiktoken finds it when it is the whole piece."""
    ranks = {bytes((i,)): i for i in range(256)} | {b"abc": 256, b"de": 257}
    encoder = bpe.Encoder(ranks, P.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abc abc", "abcde", "dede xabc", ""):
        assert encoder.encode(text) == reference.encode_ordinary(text) == encoder.many([text, "de"])[0]


def test_counts_column(spark, made):
    rows = [(1, "one two three", [(4, 7, "2"), None, (0, 0, None)]), (2, None, [(0, 5, "new")]), (3, "same", None), (3, "", []), (None, "x", [(-5, 99, "")])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, edits array<struct<start:bigint,stop:bigint,text:string>>").selectExpr("*", "0 as n_tokens")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_edits"], r["n_tokens_after"], r["text_sha256"]) for r in token_counts.count_with_edits(df, PATH, P.PATTERN).collect())
    n, sha = lambda t: len(made[2].encode_ordinary(t)), lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, n("one two three"), 2, n("one 2 three"), sha("one 2 three")), (2, 0, 1, n("new"), sha("new")), (3, n("same"), 0, n("same"), sha("same")), (3, 0, 0, 0, sha("")), (0, 1, 1, 0, sha(""))]
    assert got == sorted(want)


def test_scripted_edits_query(spark, made):
    from lodestrand.llm import queries

    got = {r["doc_id"]: r for r in queries.op8_edit_token_counts(spark, "/root/testdata/sf0.001").collect()}
    source = token_counts.scripted_edits(queries.table(spark, "/root/testdata/sf0.001", "documents")).collect()
    for row in source:
        s = row["text"] or ""
        assert got[row["doc_id"]]["n_tokens"] == len(made[2].encode_ordinary(s))
        for e in row["edits"]:
            a = max(0, min(e["start"], len(s)))
            s = s[:a] + e["text"] + s[max(a, min(e["stop"], len(s))) :]
        assert got[row["doc_id"]]["n_tokens_after"] == len(made[2].encode_ordinary(s)) and got[row["doc_id"]]["text_sha256"] == hashlib.sha256(s.encode()).hexdigest()
