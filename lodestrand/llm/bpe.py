"""Byte-level BPE as a lazily determinised finite-state transducer, with streaming decoding.

BPE splits a string in one way only, and a sequence of tokens is that split exactly when each two
neighbours are (merging their joined bytes gives the two back). So every prefix of a string has one
split, and the transducer only has to know the tokens that may still turn out to be next. It reads
byte by byte. Its state is the token emitted last and a set of hypotheses: tokens that are split
off but not certain, and bytes behind them that begin some token. A byte lengthens each
hypothesis, ends a token where the bytes are one that can stand behind the token before it, and
ends the hypothesis where no token begins so. As soon as all hypotheses agree on their next token
it is emitted; tokens have a longest length, so the lookahead is bounded. States and transitions
are made when first met and kept in tables of bounded size; the distinct new pieces of some texts
go through the transducer side by side.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import store


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file: base 64, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """The definition: join the neighbours of the least rank, leftmost first, until none can be, or ``stop`` parts are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    return [ranks[p] for p in merged(piece, ranks)]


class _Moves:
    """(state << 8 | byte) to next state and output, in an open hash table that is read and filled by whole arrays."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.goal, self.emit = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        at, last = self._slots(keys), len(self.keys) - 1
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & last
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, goal: np.ndarray, emit: np.ndarray) -> None:
        """Adds keys that differ and aren't there."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, goal, emit = (np.concatenate(x) for x in ((self.keys[old], keys), (self.goal[old], goal), (self.emit[old], emit)))
            self.__init__(max(self.bits, int(2 * len(keys)).bit_length()))
        self.n += len(keys)
        at, todo, last = self._slots(keys), np.arange(len(keys)), len(self.keys) - 1
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.goal[at[won]], self.emit[at[won]] = keys[won], goal[won], emit[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & last

    def below(self, n: int) -> _Moves:
        """The moves from and to the first ``n`` states."""
        some = np.flatnonzero((self.keys >= 0) & (self.keys >> 8 < n) & (self.goal < n))
        out = _Moves()
        out.put(self.keys[some], self.goal[some], self.emit[some])
        return out


class Transducer:
    """Bytes in, token ids out.

    Many pieces are read side by side. Where there are more than ``max_states`` states between two calls, a
    fifth of them and more is forgotten: those met first, which are the commonest, stay.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, max_pairs: int = 120_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {r: t for t, r in ranks.items()}
        # a token's last merge; a token that its own merges don't rebuild never appears
        self.halves: dict[int, tuple[int, int]] = {}
        self.real = {t: r for t, r in ranks.items() if len(t) == 1 or self._halve(t, r)}
        # what the bytes of a hypothesis may be: a token (its rank, else -1), whether a longer token begins so, and the bytes
        self.known = {t[:i]: (-1, True, t[:i]) for t in self.real for i in range(1, len(t))}
        self.known |= {t: (r, t in self.known, t) for t, r in self.real.items()}
        self.real = None
        self.single = [bytes((i,)) for i in range(256)]
        self.pairs: dict[tuple[int, int], bool] = {}
        # a state: the last token emitted (-1: none, or no hypothesis follows it at once), then tokens and bytes of each hypothesis
        self.index: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._clear()

    def _clear(self) -> None:
        self.index.clear()
        self.states.clear()
        self.moves = _Moves()
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_of: dict[tuple[int, ...], int] = {(): 0}
        self.forgotten = 0
        self._state((-1, (), b""))

    def _forget(self) -> None:
        """Leaves four fifths of ``max_states`` states if there are more, and none but the first after many forgotten ones, as texts may have changed."""
        if len(self.states) <= self.max_states:
            return
        keep = max(1, self.max_states * 4 // 5)
        self.forgotten += len(self.states) - keep
        if self.forgotten > 20 * self.max_states:
            self._clear()
            return
        for state in self.states[keep:]:
            del self.index[state]
        del self.states[keep:]
        self.moves = self.moves.below(keep)

    def _state(self, state: tuple) -> int:
        if (at := self.index.get(state)) is None:
            at = self.index[state] = len(self.states)
            self.states.append(state)
        return at

    def _output(self, tokens: tuple[int, ...]) -> int:
        if (at := self.output_of.get(tokens)) is None:
            at = self.output_of[tokens] = len(self.outputs)
            self.outputs.append(tokens)
        return at

    def _make(self, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Goals and outputs of new moves, which are kept."""
        goal, emit = [], []
        for key in keys:
            state, tokens = self._step(self.states[key >> 8], key & 255)
            goal.append(self._state(state))
            emit.append(self._output(tokens))
        made = np.array(goal, np.int32), np.array(emit, np.int32)
        self.moves.put(np.array(keys, np.int64), *made)
        return made

    def _halve(self, token: bytes, rank: int) -> bool:
        parts = merged(token, self.ranks, 2)
        if len(parts) != 2:
            return False
        self.halves[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are side by side."""
        if a < 0:
            return True
        if (found := self.pairs.get((a, b))) is None:
            found = self._apart(a, b)
            if len(self.pairs) < self.max_pairs:
                self.pairs[a, b] = found
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Goes back through the merges of both, latest first: at no time may the parts beside the border have been joined before the merge that came next there.

        Of merges of one rank the left one comes first: one inside ``a`` before that over the border, this before one inside ``b``.
        """
        limit, of, ranks, halves = 1 << 62, self.bytes_of, self.ranks, self.halves
        while True:
            over = ranks.get(of[a] + of[b])
            if over is not None and over < limit:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is not None and (right is None or a > b):
                limit, a = a, left[1]
            elif right is not None:
                limit, b = b + 1, right[0]
            else:
                return True

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after one more byte, and the tokens that are certain now."""
        last, more, known = state[0], self.single[byte], self.known
        kept, ended = [], None
        for i in range(1, len(state), 2):
            if (found := known.get(state[i + 1] + more)) is None:
                continue
            path, (rank, longer, rest) = state[i], found
            if rank >= 0 and ended is None:
                before = path[-1] if path else last
                fits = self.pairs.get((before, rank))
                if self.compatible(before, rank) if fits is None else fits:
                    ended = (*path, rank)  # the one split up to here
            if longer:
                kept += (path, rest)
        if ended is not None:
            kept += (ended, b"")
        elif not kept:
            raise ValueError("the ranks lack a single byte")
        first = kept[0]
        if len(kept) == 2:  # all its tokens are certain
            return (first[-1] if first else last, (), kept[1]), first
        paths, n = kept[::2], 0
        while n < len(first) and not [1 for p in paths if len(p) <= n or p[n] != first[n]]:
            n += 1
        if n:
            last, paths = first[n - 1], [p[n:] for p in paths]
            kept[::2] = paths
        return (last if () in paths else -1, *kept), first[:n]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece of any length, without the table."""
        out: list[int] = []
        state = self.states[0]
        for byte in piece:
            state, tokens = self._step(state, byte)
            out += tokens
        return out + list(self._end(state))

    @staticmethod
    def _end(state: tuple) -> tuple[int, ...]:
        """What is left at the end of a piece: the hypothesis without open bytes."""
        return state[state.index(b"", 1) - 1]

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of every piece. A round reads one byte of each piece that goes on, the longest first."""
        self._forget()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        at, lanes, outs = np.zeros(len(pieces), np.int64), [], []
        for i in range(int(sizes[0]) if len(sizes) else 0):
            live = np.searchsorted(-sizes, -i)
            keys = at[:live] << 8 | data[starts[:live] + i]
            slots = self.moves.find(keys)
            goal, emit = self.moves.goal[slots], self.moves.emit[slots]
            if len(new := np.flatnonzero(slots < 0)):
                some, back = np.unique(keys[new], return_inverse=True)
                goal[new], emit[new] = (x[back] for x in self._make(some.tolist()))
            at[:live] = goal
            lanes.append(np.flatnonzero(emit))
            outs.append(emit[lanes[-1]])
        stops, back = np.unique(at, return_inverse=True)
        lanes.append(np.arange(len(pieces)))
        outs.append(np.array([self._output(self._end(self.states[k])) for k in stops.tolist()], np.int32)[back])
        lane = np.concatenate(lanes)
        turn = np.argsort(lane, kind="stable")
        said = list(map(self.outputs.__getitem__, np.concatenate(outs)[turn].tolist()))
        size = np.fromiter(map(len, said), np.int64, len(said))
        ends = np.cumsum(np.bincount(lane[turn], size, len(pieces))).astype(np.int64).tolist()
        tokens, found, begin = tuple(chain.from_iterable(said)), [()] * len(pieces), 0
        for i, end in zip(order.tolist(), ends):
            found[i] = tokens[begin:end]
            begin = end
        return found


class Encoder:
    """Splits texts by a pattern and sends each piece through the transducer.

    Short pieces are remembered in two generations of ``max_pieces`` each: when the younger is full it
    becomes the older, and the older goes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 100_000, longest_kept: int = 64):
        self.fst, self.split, self.iter = Transducer(ranks), regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.max_pieces, self.longest_kept = max_pieces, longest_kept
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.long: list[str] = []

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of all ``pieces``, among others, until the next call; each new one is encoded once."""
        for p in self.long:
            self.known.pop(p, None)
        missing = pieces.difference(self.known)
        if self.known and len(self.known) + len(missing) > self.max_pieces:
            self.older, self.known = self.known, {}
            missing = pieces
        older = self.older
        self.known.update({p: older[p] for p in missing if p in older})
        short, self.long = [], []
        for p in missing.difference(older):
            (short if len(p) <= self.longest_kept else self.long).append(p)
        for i in range(0, len(short), 50_000):
            some = short[i : i + 50_000]
            self.known.update(zip(some, self._encoded([p.encode("utf-8") for p in some])))
        self.known.update((p, self._alone(p.encode("utf-8"))) for p in self.long)
        return self.known

    def _alone(self, piece: bytes) -> tuple[int, ...]:
        whole = self.fst.ranks.get(piece)
        return tuple(self.fst.encode(piece)) if whole is None else (whole,)

    def _encoded(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """A piece that is a token is that token, whether or not merges lead there; the others go through the transducer."""
        whole = list(map(self.fst.ranks.get, pieces))
        rest = iter(self.fst.encode_many([p for p, r in zip(pieces, whole) if r is None]))
        return [next(rest) if r is None else (r,) for r in whole]

    def many(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; the distinct pieces of all of them are learned together."""
        split = [self.split(t) for t in texts]
        of = self.learn(set(chain.from_iterable(split))).__getitem__
        return [list(chain.from_iterable(map(of, pieces))) for pieces in split]

    def encode(self, text: str) -> list[int]:
        """The ids of a text of any length, some pieces at a time."""
        found, ids = (m.group() for m in self.iter(text)), []
        while pieces := list(islice(found, 200_000)):
            ids += chain.from_iterable(map(self.learn(set(pieces)).__getitem__, pieces))
        return ids


def batched(texts: Iterable[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of about ``chars`` characters; a longer text is alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the text that is complete; up to three bytes wait.

    The state is the waiting bytes. ``ill`` counts malformed sequences, each replaced by U+FFFD as in
    Python's ``replace``.
    """

    def __init__(self):
        self.waiting, self.ill = b"", 0

    @staticmethod
    def _open(data: bytes) -> int:
        """How many of the last bytes start a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # some second bytes are never right
                c = data[-back + 1]
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                if not low <= c <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self._open(data)
        self.waiting = data[cut:]
        return self._text(data[:cut])

    def close(self) -> str:
        data, self.waiting = self.waiting, b""
        return self._text(data)

    def _text(self, data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            text = data.decode("utf-8", "replace")
            self.ill += text.count("�") - data.count("�".encode())
            return text


class Decoder:
    """Ids to text in pieces of ``step`` tokens."""

    def __init__(self, ranks: dict[bytes, int], step: int = 4096):
        self.bytes_of, self.step = {r: t for t, r in ranks.items()}, step
        self.decimal = {r: str(r) for r in ranks.values()}

    def stream(self, ids: list[int]):
        utf8, of = Utf8Stream(), self.bytes_of.__getitem__
        for at in range(0, len(ids), self.step):
            yield utf8.feed(b"".join(map(of, ids[at : at + self.step])))
        yield utf8.close()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.stream(ids))


_CODECS: dict[tuple, tuple[Encoder, Decoder]] = store.held("bpe")


def codec(rank_file: bytes, pattern: str, max_pieces: int = 100_000) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a vocabulary, one per worker process."""
    key = (hashlib.sha256(rank_file).digest(), pattern, max_pieces)
    if key not in _CODECS:
        _CODECS.clear()
        ranks = load_ranks(rank_file)
        _CODECS[key] = Encoder(ranks, pattern, max_pieces), Decoder(ranks)
    return _CODECS[key]


def vocabulary(spark: SparkSession, path: str):
    """The rank file, read through Spark where the driver's own disk lacks it, as a broadcast (its size is checked)."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except FileNotFoundError:
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    if len(data) > 64 << 20:
        raise ValueError("a rank file of more than 64 MB isn't broadcast")
    return spark.sparkContext.broadcast(data)


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``exact`` and, if asked for, ``ids``.

    ids_sha256 is that of the decimal ids joined by one space, decoded_sha256 that of the bytes decoded
    from the ids; ``exact`` tells whether they are the text again. Null text counts as empty: no
    tokens, the hashes of nothing. Texts of any length are encoded whole, one at a time. Rows that
    repeat an identifier are encoded each; further columns are not read.
    """
    spark = docs.sparkSession
    store.ship(spark)
    ranks = vocabulary(spark, ranks_path)
    key = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids

    def run(batches):
        from lodestrand.llm.bpe import batched, codec

        encoder, decoder = codec(ranks.value, pattern)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            texts = (x.as_py() or "" for x in batch.column(1))
            for text, ids in ((t, i) for some in batched(texts) for t, i in zip(some, encoder.many(some) if len(some) > 1 else [encoder.encode(some[0])])):
                said, back = " ".join(map(decoder.decimal.__getitem__, ids)), decoder.decode(ids)
                cols[0].append(len(ids))
                cols[1].append(hashlib.sha256(said.encode()).hexdigest())
                cols[2].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                cols[3].append(back == text)
                if with_ids:
                    cols[4].append(ids)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(cols[: 4 + with_ids], kinds))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "exact", "ids"][: len(arrays)])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(store.light(run, "bpe"), schema)
