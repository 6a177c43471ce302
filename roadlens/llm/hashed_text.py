"""Hashed text features and the small sparse fits that the text classifiers share.

Features of a text: for each distinct word, the word and its beginnings (vocabularies inflect at
the end); for each token, its shape (letters, digits and marks, runs collapsed), as a share of all
tokens; and how much of the text repeats itself.  All are hashed into one weight vector.

Fits run on a bounded sample of labelled documents, chosen by a hash of the id; scoring runs over all documents in
Arrow batches.  Weights are broadcast: their size is fixed by ``BITS``.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_bits, whole_text

BITS = 18
#: Bound on the labelled documents of a fit.
MAX_LABELLED = 4_000
#: Features seen in fewer labelled documents than this are left out.
LEAST_DOCS = 3
#: Features that a fit chooses per category or grade.
CHOSEN = 600
BEGINNINGS = (4, 5, 6, 7, 8)
SHAPE_WEIGHT = 10.0
REMEMBERED = 300_000

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_SHAPES = [(re.compile(r"[^\W\d_a-z]*[a-z][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w])\1*"), r"\1")]
_MASK = (1 << BITS) - 1


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 7 & _MASK


def normal(word: str) -> str:
    return word.strip(_MARKS).lower()


def shape(word: str) -> str:
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


def word_slots(word: str) -> list[int]:
    """Slots of a normalised word: itself and its beginnings."""
    if not word:
        return []
    return [slot("=" + word)] + [slot("^" + word[:k]) for k in BEGINNINGS if len(word) >= k]


def repeat_slots(words: list[str]) -> list[int]:
    """Slots for how many three-word windows are new, and how often a word follows itself."""
    windows = len(words) - 2
    new = len(set(zip(words, words[1:], words[2:]))) / windows if windows > 0 else 1.0
    again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
    return [slot(f"new:{int(new * 10)}"), slot(f"again:{int(again * 10)}")]


def features(text: str, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; never empty."""
    words = text.split()
    slots = [0]
    values = [1.0]
    for w in {normal(w) for w in words}:
        own = word_slots(w)
        slots += own
        values += [1.0] * len(own)
    if shapes:
        slots += [slot("#" + shape(w)) for w in words]
        values += [SHAPE_WEIGHT / max(1, len(words))] * len(words)
        own = repeat_slots(words)
        slots += own
        values += [1.0] * len(own)
    at, where = np.unique(np.array(slots, np.int64), return_inverse=True)
    return at, np.bincount(where, weights=values)


class _Numbers(dict):
    """Keys numbered as they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class _Rows:
    """Rows of numbers that grow at the end."""

    def __init__(self, width: int):
        self.data, self.n = np.zeros((1024, width)), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), self.data.shape[1]))
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : need] = rows
        self.n = need


class Scorer:
    """Scores of texts under weights of shape (slots, outputs).  A word is looked up once: its number leads to the number of its
    normal form, to the score of that form with its beginnings, and to the score of its shape; a text is sums over rows."""

    def __init__(self, weights: np.ndarray, shapes: bool):
        self.weights, self.shapes = weights, shapes
        self._forget()

    def _forget(self) -> None:
        self.words, self.normals = _Numbers(), _Numbers()
        self.normal_of = np.zeros(1024, np.int64)
        self.word_scores, self.form_scores = _Rows(self.weights.shape[1]), _Rows(self.weights.shape[1])

    def _learn(self, fresh: list[str], from_: int) -> None:
        """Rows of words that are new, numbered from ``from_`` on."""
        if len(self.words) > len(self.normal_of):
            self.normal_of = np.concatenate([self.normal_of, np.zeros(max(len(self.words), len(self.normal_of)) - len(self.normal_of) + len(self.words), np.int64)])
        known = len(self.normals)
        forms = [normal(w) for w in fresh]
        self.normal_of[from_ : from_ + len(fresh)] = [self.normals[f] for f in forms]
        new = list(itertools.islice(reversed(self.normals), len(self.normals) - known))[::-1]
        if new:
            self.word_scores.add(self._sums([word_slots(f) for f in new]))
        if self.shapes:
            self.form_scores.add(self.weights[[slot("#" + shape(w)) for w in fresh]])

    def _sums(self, slots: list[list[int]]) -> np.ndarray:
        ends = np.cumsum([0] + [len(x) for x in slots])
        rows = np.zeros((ends[-1] + 1, self.weights.shape[1]))
        rows[1:] = self.weights[[k for x in slots for k in x]]
        total = np.cumsum(rows, axis=0)
        return total[ends[1:]] - total[ends[:-1]]

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        score = self.weights[0].astype(float)
        if words:
            if len(self.words) >= REMEMBERED:
                self._forget()
            before = len(self.words)
            ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            if len(self.words) > before:
                self._learn(list(itertools.islice(reversed(self.words), len(self.words) - before))[::-1], before)
            score += self.word_scores.data[np.unique(self.normal_of[ids])].sum(axis=0)
            if self.shapes:
                score += SHAPE_WEIGHT * self.form_scores.data[ids].sum(axis=0) / len(words)
                score += self.weights[_repeats(ids)].sum(axis=0)
        elif self.shapes:
            score += self.weights[repeat_slots(words)].sum(axis=0)
        return score


def _repeats(ids: np.ndarray) -> list[int]:
    """``repeat_slots`` of words given by numbers."""
    windows = len(ids) - 2
    u = ids.astype(np.uint64)
    new = len(np.unique(u[:-2] * np.uint64(0x9E3779B97F4A7C15) + u[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + u[2:])) / windows if windows > 0 else 1.0
    again = int((ids[1:] == ids[:-1]).sum()) / max(1, len(ids) - 1)
    return [slot(f"new:{int(new * 10)}"), slot(f"again:{int(again * 10)}")]


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], shapes: bool, bound: int = MAX_LABELLED):
    """(Design, label matrix) of at most ``bound`` labelled documents: those whose id hashes lowest, so a
    sample does not depend on the order of rows.  Only this sample's features reach the driver."""
    rows = labels.select("doc_id", *columns).dropna().withColumn("__h", hash_bits(F.col("doc_id").cast("string"), 15))
    chosen = rows.orderBy("__h", "doc_id", *columns).limit(bound)

    def featurize(texts: pa.Array) -> pa.Array:
        found = [features(t, shapes) for t in texts.to_pylist()]
        return pa.array([a.astype("<i4").tobytes() + v.astype("<f4").tobytes() for a, v in found], pa.binary())

    featurize.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    text = docs.select("doc_id", whole_text().alias("__text"))
    # a bounded table (``bound`` ids and labels)
    joined = text.join(F.broadcast(chosen), "doc_id").select("__h", "doc_id", *columns, F.arrow_udf(featurize, T.BinaryType())(F.col("__text")).alias("x"))
    found = sorted(joined.collect(), key=lambda r: (r["__h"], r["doc_id"], bytes(r["x"])))
    y = np.array([[float(r[c]) for c in columns] for r in found]).reshape(len(found), len(columns))
    return Design([bytes(r["x"]) for r in found]), y


class Design:
    """Sparse rows, pruned to features of LEAST_DOCS rows or more, with room for dense columns."""

    def __init__(self, packed: list[bytes]):
        self.n = len(packed)
        slots = [np.frombuffer(p, "<i4", len(p) // 8) for p in packed]
        seen = np.zeros(1 << BITS, np.int32)
        for at in slots:
            seen[at] += 1  # a row's slots are distinct
        kept = seen >= min(LEAST_DOCS, max(self.n, 1))
        masks = [kept[at] for at in slots]
        none = [np.empty(0, np.int32)]
        at = np.concatenate([a[m] for a, m in zip(slots, masks)] + none)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [int(m.sum()) for m in masks])
        self.value = np.concatenate([np.frombuffer(p, "<f4", len(p) // 8, len(p) // 2)[m] for p, m in zip(packed, masks)] + [np.empty(0, np.float32)])
        self.slots = np.flatnonzero(kept & (seen > 0))
        number = np.zeros(1 << BITS, np.int32)
        number[self.slots] = np.arange(len(self.slots))
        self.column = number[at]

    def take(self, rows: np.ndarray) -> "Design":
        """The rows where the mask is set, over the same columns."""
        part = object.__new__(Design)
        keep = rows[self.row]
        part.n, part.slots = int(rows.sum()), self.slots
        part.row = (np.cumsum(rows) - 1)[self.row[keep]]
        part.value, part.column = self.value[keep], self.column[keep]
        return part

    def select(self, marks: list[np.ndarray], most: int) -> "Design":
        """The ``most`` columns that tell each of the 0/1 marks apart best (chi-squared of presence), and the bias."""
        count = np.bincount(self.column, minlength=len(self.slots)).astype(float)
        chosen = self.slots == 0
        for y in marks:
            yes, n = y.sum(), self.n
            if 0 < yes < n:
                hit = np.bincount(self.column, weights=y[self.row], minlength=len(self.slots))
                spread = count * (n - count) * yes * (n - yes)
                chi = np.divide(n * (hit * n - count * yes) ** 2, spread, out=np.zeros_like(count), where=spread > 0)
                chosen[np.argsort(-chi, kind="stable")[:most]] = True
        part = object.__new__(Design)
        keep = chosen[self.column]
        part.n, part.slots = self.n, self.slots[chosen]
        part.row, part.value = self.row[keep], self.value[keep]
        part.column = (np.cumsum(chosen) - 1)[self.column[keep]]
        return part

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * r[self.row], minlength=len(self.slots))

    def spread(self, w: np.ndarray) -> np.ndarray:
        full = np.zeros(1 << BITS)
        full[self.slots] = w
        return full


def minimize(gradient, start: np.ndarray, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Adam over the whole sample; ``gradient(x)`` is that of the mean loss."""
    x, m, v = start.astype(float).copy(), np.zeros_like(start, float), np.zeros_like(start, float)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (1 - t / (steps + 1)) ** 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
