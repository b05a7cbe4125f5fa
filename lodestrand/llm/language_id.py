"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from the seed and its code point. A trigram
binds its letters' vectors, each permuted (rotated) by its place, by multiplication. A text's
vector bundles (adds) those of its trigrams, a language's prototype those of its labelled texts;
a text gets the language of the prototype with the largest cosine.

A bundle is a sum over trigrams, so a text's vector is its trigram counts times the matrix of
trigram vectors, computed for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import store

DIM, SEED, UNKNOWN = 1024, 20240611, "und"
#: Prototypes come to the driver; so many languages at most.
MAX_LANGUAGES = 1000


class Profiles:
    """Trigram vectors of one seed and dimension; letters and trigrams are numbered as they are met.

    At most ``max_grams`` trigrams are held; when a text needs more the table starts anew, which
    changes no result as every vector depends only on seed and letters.
    """

    def __init__(self, dim: int = DIM, seed: int = SEED, max_grams: int = 12_000):
        self.dim, self.seed, self.max_grams = dim, seed, max_grams
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.letters = [self._letter(0x20)]  # symbol 0 is the gap between words
        self._start()

    def _letter(self, point: int) -> np.ndarray:
        return np.random.default_rng([self.seed, point]).integers(0, 2, self.dim, dtype=np.int8) * np.int8(2) - np.int8(1)

    def _start(self) -> None:
        self.row_of: dict[int, int] = {}
        self.rows = np.zeros((1024, self.dim), np.int8)

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol_of[points]
        if (out < 0).any():
            for point in np.unique(points[out < 0]):
                if chr(point).isalpha():
                    self.symbol_of[point] = len(self.letters)
                    self.letters.append(self._letter(int(point)))
                else:
                    self.symbol_of[point] = 0
            out = self.symbol_of[points]
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of the letters and single gaps of a text, as numbers with their counts; none if it has no letter."""
        s = self.symbols(text)
        if not s.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int64)  # one gap for a run
        codes = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
        return np.unique(codes, return_counts=True)

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the matrix for the trigrams, made where new."""
        get = self.row_of.get
        out = np.fromiter((get(c, -1) for c in codes.tolist()), np.int64, len(codes))
        for i in np.flatnonzero(out < 0):
            code = int(codes[i])
            if (at := len(self.row_of)) == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            a, b, c = (self.letters[(code >> shift) & 0x1FFFFF] for shift in (42, 21, 0))
            self.rows[at] = np.roll(a, 2) * np.roll(b, 1) * c
            out[i] = self.row_of[code] = at
        return out

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A vector for each (trigrams, counts)."""
        out = np.zeros((len(counted), self.dim))
        at = 0
        while at < len(counted):
            if len(self.row_of) > self.max_grams:
                self._start()
            some, places = at, []
            while at < len(counted) and (not places or len(self.row_of) <= self.max_grams) and at - some < 128:
                places.append(self.place(counted[at][0]))
                at += 1
            used = np.unique(np.concatenate(places)) if places else np.empty(0, np.int64)
            if len(used):
                dense = np.zeros((len(places), len(used)), np.float32)
                for i, p in enumerate(places):
                    dense[i, np.searchsorted(used, p)] = counted[some + i][1]
                out[some:at] = dense @ self.rows[used].astype(np.float32)
        return out


_PROFILES: dict[tuple[int, int], Profiles] = store.held("language_id")


def profiles(dim: int, seed: int) -> Profiles:
    if (dim, seed) not in _PROFILES:
        _PROFILES.clear()
        _PROFILES[dim, seed] = Profiles(dim, seed)
    return _PROFILES[dim, seed]


def evidence(counts: np.ndarray) -> float:
    """The number of equally frequent trigrams that would tell as much: the square of the sum of the counts by the sum of their squares; 0 for none."""
    n = counts.astype(np.float64)
    return float(n.sum() ** 2 / (n @ n)) if len(n) else 0.0


def _bundled(texts: Iterator[str], made: Profiles, chars: int = 2 << 20) -> Iterator[tuple[np.ndarray, float]]:
    """Bundles of the texts in order with their evidence, some millions of characters at a time."""
    held, size = [], 0
    for text in texts:
        held.append(made.grams(text))
        size += len(text) + made.dim  # a vector takes room too
        if size >= chars:
            yield from zip(made.bundle(held), [evidence(n) for _, n in held])
            held, size = [], 0
    yield from zip(made.bundle(held), [evidence(n) for _, n in held])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes from all rows with non-null text and language: each task bundles its texts by language, the sums are added by Spark."""
    store.ship(labelled.sparkSession)

    def run(batches):
        from lodestrand.llm.language_id import profiles

        made, sums = profiles(dim, seed), {}
        totals: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, counts = made.grams(text.as_py())
                if not len(codes):
                    continue
                # letters' numbers differ between workers, so what leaves a worker is a vector
                total = totals.setdefault(lang, {})
                for c, n in zip(codes.tolist(), counts.tolist()):
                    total[c] = total.get(c, 0) + n
                if len(total) > made.max_grams:
                    sums[lang] = sums.get(lang, 0) + made.bundle([_arrays(total)])[0]
                    totals[lang] = {}
        for lang, total in totals.items():
            if total:
                sums[lang] = sums.get(lang, 0) + made.bundle([_arrays(total)])[0]
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(vector.astype(np.float64))], ["lang", "i", "v"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(store.light(run, "language_id"), "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    vectors: dict[str, np.ndarray] = {}
    for lang, i, v in parts.limit(MAX_LANGUAGES * dim + 1).collect():
        vectors.setdefault(lang, np.zeros(dim))[i] = v
    if len(vectors) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return vectors


def _arrays(total: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and a struct ``language``: ``lang_pred``, ``score``, ``evidence``.

    score: the cosine with the chosen prototype, at least 0; evidence: see :func:`evidence`. ``und`` with score 0 if the text is null or
    has no letter, or nothing was learned; of equal cosines the language that sorts first. Whole
    texts of any length are read, once each. Columns of any name are kept; an empty table gives an
    empty result.
    """
    store.ship(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in names]).reshape(len(names), dim)

    def run(batches):
        from lodestrand.llm.language_id import _bundled, profiles

        made = profiles(dim, seed)
        for batch in batches:
            lang, score, known = [], [], []
            for vector, told in _bundled((x.as_py() or "" for x in batch.column(batch.num_columns - 1)), made):
                known.append(told)
                size = np.linalg.norm(vector)
                if not size or not names:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cosines = matrix @ vector / size
                best = int(np.argmax(cosines.round(12)))
                lang.append(names[best])
                score.append(float(min(1.0, max(0.0, cosines[best]))))
            found = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], ["lang_pred", "score", "evidence"])
            columns = [*batch.columns[:-1], found]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    # columns go by place, as names may be anything
    placed = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in placed.schema], T.StructField(f"c{len(docs.columns)}", T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())]))])
    texts = placed.select("*", F.col(f"c{docs.columns.index(text_col)}").cast("string").alias("text"))
    return texts.mapInArrow(store.light(run, "language_id"), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([*docs.columns, "language"])])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """:func:`predict` for all ``docs``, learned from those of them that have a language and aren't held out."""
    learn = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    return predict(docs, train(learn, text_col, lang_col, dim, seed), text_col, dim, seed)
