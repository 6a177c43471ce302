"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

A text is cut by the tokenizer's pattern; each match is encoded on its own.  For one match the
leaves of a segment tree hold, at byte position i, the rank of the pair formed by the token that
starts at i and its right neighbour; a node holds the least rank below it, so the walk from the root
to the first child with the least rank finds the leftmost pair of least rank.  A merge changes
three leaves: the merged token's, its live left neighbour's and the one that vanishes; each costs
one path to the root.  Nodes have 32 children, so most words are one node.  A match of n bytes so takes O(n log n), also where it is a whole long text.

The vocabulary (fixed size, about 1 MB) is read once on the driver and broadcast.  Encoded pieces
are remembered per Python worker in two bounded generations.

Defined cases: null text encodes like the empty one (no tokens); decoding null ids gives null;
ids out of the vocabulary fail the decoding; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

#: Pieces remembered per generation and worker, and the longest piece remembered (characters).
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: Children per node of the segment tree.
FAN = 32
_NONE = 1 << 30


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """The rank of every pair of bytes, at 256 * first + second."""
    return [ranks.get(bytes((a, b)), _NONE) for a in range(256) for b in range(256)]


def merge_piece(piece: bytes, ranks: dict[bytes, int], singles: list[int], pairs: list[int]) -> list[int]:
    """Token ids of one pattern match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank = ranks.get
    leaves = [pairs[256 * a + b] for a, b in zip(piece, piece[1:])]
    leaves.append(_NONE)
    token = [singles[b] for b in piece]
    end = list(range(1, n + 1))  # of the token that starts here
    prev = list(range(-1, n))  # start of the live left neighbour
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    root, inner, down = levels[-1], levels[1:], levels[-2::-1]
    while (least := min(root)) != _NONE:
        i = root.index(least)
        for below in down:
            i = below.index(least, i * FAN)
        gone = end[i]
        stop = end[i] = end[gone]
        token[i] = least  # a pair's rank is the merged token's id
        prev[stop] = i
        left = prev[i]
        leaves[gone] = _NONE
        leaves[i] = rank(piece[i : end[stop]], _NONE) if stop < n else _NONE
        if left >= 0:
            leaves[left] = rank(piece[left:stop], _NONE)
        if inner:
            for at in (gone, i, left) if left >= 0 else (gone, i):
                below = leaves
                for level in inner:
                    at //= FAN
                    lowest = min(below[at * FAN : at * FAN + FAN])
                    if level[at] == lowest:
                        break
                    level[at] = lowest
                    below = level
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = end[i]
    return out


class Encoder:
    """Text -> ids as a little-endian int32 byte string."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = parse_ranks(rank_file)
        self.singles = [self.ranks[bytes((b,))] for b in range(256)]
        self.pairs = byte_pairs(self.ranks)
        self.find = regex.compile(pattern).findall
        self.inner_space = regex.compile(r"(?<=\s) (?:\s|\Z)").search
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _remember(self, part: str, ids: bytes) -> bytes:
        if len(part) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[part] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """One pattern match."""
        known = self.young.get(piece) or self.old.get(piece)
        if known is not None:
            return known
        return self._remember(piece, array("i", merge_piece(piece.encode(), self.ranks, self.singles, self.pairs)).tobytes())

    def _part(self, part: str) -> bytes:
        """A part between single spaces that is not among the young."""
        known = self.old.get(part)
        if known is None:
            pieces = self.find(part)
            if len(pieces) == 1:
                return self._piece(part)
            known = b"".join([self._piece(p) for p in pieces])
        return self._remember(part, known)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or self.inner_space(text):
            # a run of white space (of any kind) is cut by what follows it: leave the text whole
            return b"".join([self._piece(p) for p in self.find(text)])
        # Elsewhere every space follows a word, or is the last of its run and so goes with the word
        # behind it: a match ends before it, and the parts that begin at spaces can be encoded, and
        # remembered, on their own.
        first, *words = text.split(" ")
        out = [self._part(first)] if first else []
        for word in words:
            part = " " + word
            known = self.young.get(part)
            out.append(self._part(part) if known is None else known)
        return b"".join(out)


def parse_ranks(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}


class BPE:
    """Columns that encode, count and decode by a vocabulary file.

    ``BPE(spark, path, pattern)``; ``encode(col)`` gives array<int>, ``count(col)`` long,
    ``decode(col)`` binary.  No shuffle; memory: one Arrow batch and the remembered pieces."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self._file = spark.sparkContext.broadcast(f.read())
        self._key = (path, pattern)

    def _encoder(self):
        shared, key = self._file, self._key
        return lambda: _worker_encoder(key, shared)

    def encode(self, text: str = "text") -> Column:
        encoder = self._encoder()

        def ids(texts: pa.Array) -> pa.Array:
            encode = encoder().encode
            return _lists([encode(t) for t in texts.to_pylist()])

        ids.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        # declared as not deterministic so that Spark evaluates it once where several columns use its result
        return F.arrow_udf(ids, T.ArrayType(T.IntegerType())).asNondeterministic()(whole_text(text))

    def round_trip(self, text: str = "text") -> Column:
        """struct(ids, decoded): the ids of a text and the bytes that these ids decode to, in one pass through
        one Python worker (``decode(encode(...))`` has a worker for each)."""
        encoder, shared, key = self._encoder(), self._file, self._key

        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder_ = encoder()
            for texts in batches:
                ids = _lists([encoder_.encode(t) for t in texts.to_pylist()])
                yield pa.StructArray.from_arrays([ids, _decode(ids, _worker_tokens(key, shared))], names=["ids", "decoded"])
            pa.default_memory_pool().release_unused()  # the worker lives on: what this task is done with goes back

        both.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
        return F.arrow_udf(both, kind).asNondeterministic()(whole_text(text))

    def count(self, text: str = "text") -> Column:
        encoder = self._encoder()

        def length(texts: pa.Array) -> pa.Array:
            encode = encoder().encode
            return pa.array([len(encode(t)) // 4 for t in texts.to_pylist()], pa.int64())

        length.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(length, T.LongType())(whole_text(text))

    def decode(self, ids: str = "ids") -> Column:
        shared, key = self._file, self._key

        def text(lists: pa.Array) -> pa.Array:
            return _decode(lists, _worker_tokens(key, shared))

        text.__annotations__ = {"lists": pa.Array, "return": pa.Array}
        return F.arrow_udf(text, T.BinaryType())(F.col(ids))


def _lists(blobs: list[bytes]) -> pa.Array:
    """Packed ids of each text -> list<int32>."""
    offsets = np.fromiter(itertools.accumulate((len(b) // 4 for b in blobs), initial=0), np.int32, len(blobs) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def _decode(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """The bytes of each list: the taken tokens lie one behind the other, so a list's bytes are those between its bounds."""
    bounds = lists.offsets.to_numpy()
    ids = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    if ids.null_count:
        raise ValueError("null among the ids to decode")
    _, ends, data = tokens.take(ids).buffers()
    offsets = np.frombuffer(ends, np.int32, len(ids) + 1)[bounds - bounds[0]]
    known = pa.array(lists.is_valid().to_numpy(zero_copy_only=False)).buffers()[1] if lists.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(lists), [known, pa.py_buffer(offsets), data])


_ENCODERS: dict[tuple, Encoder] = {}
_TOKENS: dict[tuple, pa.Array] = {}


def _worker_encoder(key, shared) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shared.value, key[1])
    return _ENCODERS[key]


def _worker_tokens(key, shared) -> pa.Array:
    if key not in _TOKENS:
        ranks = parse_ranks(shared.value)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        _TOKENS[key] = pa.array(tokens, pa.binary())
    return _TOKENS[key]
