"""Periodic runs of words: suffix-tree LCE, Lyndon-root candidates, extension in both directions.

A run is a stretch of consecutive words that repeats itself with smallest period q (words q apart are the same), is
``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words long or more, and cannot be extended by a neighbouring word.

1. *Stretches.*  A run of 24 words and three periods has its every word inside some ``GRAM``-word window that the run
   contains twice.  Windows are hashed; stretches of text covered by windows that occur again in the same
   stretch are kept, and narrowed until nothing changes.  Every run lies whole within one such stretch, so
   this loses none (a hash collision only adds a stretch), and texts that repeat nothing build no tree.
2. *Trees.*  For each stretch Ukkonen's algorithm builds the suffix tree of its words and that of its reversal.  The
   Euler tour visits the leaves in the order of the suffixes; the least depth between two
   visits is the depth of their lowest common ancestor, so a range-minimum table answers longest common extensions (LCE) in
   constant time, here for all positions at once.
3. *Lyndon roots.*  Under an order of the words and under its reverse, the longest Lyndon word that begins at i ends where
   the next smaller suffix begins.  Every run has such a word as root, in one of both orders, so 2n
   candidates hold all runs.  Each is extended to the right by LCE in the tree of the text and to the left by LCE in the
   tree of its reversal.

Rows are independent: one pass over the documents in Arrow batches, no shuffle, memory linear in the longest text.

Defined cases: a null or empty text has no words, no runs, and collapses to the empty text; repeated rows get equal answers;
a null doc_id is a row like others; columns of the input pass through, save those named like a column made here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: A run of 24 words and three periods holds each of its windows of this many words' starts at most a period apart.
GRAM = 16
_BLOCK = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def suffix_tree(s: list[int]):
    """Ukkonen's suffix tree of s, whose last symbol occurs once: (start, end, children) by node, root 0."""
    n = len(s)
    start, end, link, kids = [0], [0], [0], [{}]
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        fresh = 0
        while rest:
            if not length:
                edge = i
            here = kids[node]
            child = here.get(s[edge])
            if child is None:
                here[s[edge]] = len(start)
                start.append(i), end.append(n), link.append(0), kids.append(None)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                at = start[child]
                span = end[child] - at
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[at + length] == c:
                    if fresh:
                        link[fresh] = node
                    length += 1
                    break
                split = len(start)
                here[s[edge]] = split
                start.append(at), end.append(at + length), link.append(0), kids.append({s[at + length]: child, c: split + 1})
                start[child] = at + length
                start.append(i), end.append(n), link.append(0), kids.append(None)
                if fresh:
                    link[fresh] = split
                fresh = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, end, kids


def leaf_tour(tree, n: int, descending: bool = False) -> tuple[list[int], list[int]]:
    """The Euler tour's leaves: suffixes in order of their words (the end of the text before any word, in both orders), and the
    least depth on the way from the leaf before."""
    start, end, kids = tree
    leaves, dips = [], []
    stack = [(0, 0, 0)]
    while stack:
        node, depth, dip = stack.pop()
        below = kids[node]
        depth += end[node] - start[node]
        if below is None:
            leaves.append(n - depth)
            dips.append(dip)
            continue
        order = sorted(below, reverse=not descending)  # a stack: last in, first out
        if descending and order[0] == -1:
            order.append(order.pop(0))
        first = order[-1]
        stack += [(below[k], depth, dip if k == first else depth) for k in order]
    return leaves, dips


class RangeMinimum:
    """Minima of a[l..r] for many (l, r) at once: blocks with running minima, a sparse table over the blocks."""

    def __init__(self, a: np.ndarray):
        blocks = -(-len(a) // _BLOCK)
        self.a = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        self.a[: len(a)] = a
        by = self.a.reshape(blocks, _BLOCK)
        self.head = np.minimum.accumulate(by, axis=1).reshape(-1)
        self.tail = np.minimum.accumulate(by[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [by.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            w = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-w], self.table[-1][w:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        x, y = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.tail[lo], self.head[hi])
        same = np.flatnonzero(x == y)
        if len(same):
            a, z = lo[same], hi[same]
            least = self.a[a]
            for k in range(1, _BLOCK):
                least = np.minimum(least, self.a[np.minimum(a + k, z)])
            out[same] = least
        width = y - x - 1
        for k, level in enumerate(self.table):
            use = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
            if len(use):
                out[use] = np.minimum(out[use], np.minimum(level[x[use] + 1], level[y[use] - (1 << k)]))
        return out


class Extensions:
    """LCE of pairs of different positions of a text, by its suffix tree."""

    def __init__(self, s: list[int]):
        self.tree = suffix_tree(s + [-1])
        leaves, dips = leaf_tour(self.tree, len(s) + 1)
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.dips = RangeMinimum(np.array(dips, np.int32))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p, q = self.rank[i], self.rank[j]
        return self.dips(np.minimum(p, q) + 1, np.maximum(p, q))


def next_smaller(rank: list[int]) -> list[int]:
    """For each position the next one of smaller rank (the length where there is none)."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def maximal_runs(s: list[int]) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of s, by its Lyndon roots."""
    n = len(s)
    ahead = Extensions(s)
    behind = Extensions(s[::-1])
    i = np.arange(n)
    found = set()
    for descending in (False, True):
        rank = np.empty(n + 1, np.int64)
        rank[leaf_tour(ahead.tree, n + 1, descending)[0]] = np.arange(n + 1)
        j = np.array(next_smaller(rank[:n].tolist()))
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        inside = np.flatnonzero(j < n)
        right[inside] = ahead(i[inside], j[inside])
        left[1:] = behind(n - i[1:], n - j[1:])
        period, start, length = j - i, i - left, j - i + left + right
        runs = np.flatnonzero((length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period))
        found.update(zip(start[runs].tolist(), length[runs].tolist(), period[runs].tolist()))
    return found


def repeating_stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the stretches that can hold runs."""
    if len(codes) < LEAST_WORDS:
        return []
    h, w = (codes.astype(np.uint64) + np.uint64(1)) * _MIX, 1
    while w < GRAM:
        h = (h[:-w] ^ (h[:-w] >> np.uint64(31))) * _MIX + h[w:] * np.uint64(2 * w + 1)
        w *= 2
    at, part = np.arange(len(h)), np.zeros(len(h), np.int64)
    while len(at):
        order = np.lexsort((h[at], part))
        same = (np.diff(h[at][order]) == 0) & (np.diff(part[order]) == 0)
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if again.all():
            break
        at = at[again]
        part = np.cumsum(np.diff(at, prepend=at[:1]) > GRAM)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(part)) + 1
    return [(int(x[0]), int(x[-1]) + GRAM) for x in np.split(at, cut)]


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    names: dict = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    out = []
    for a, z in repeating_stretches(codes):
        if z - a >= LEAST_WORDS:
            out += [(a + s, n, p) for s, n, p in maximal_runs(codes[a:z].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what any run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


def strongest(runs: list[tuple[int, int, int]]):
    """The run of greatest exact length/period; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType()),
])
_RUN_ARROW = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN_ARROW)), ("strongest", _RUN_ARROW), ("collapsed", pa.string())])


def _named(run):
    return None if run is None else dict(zip(("start", "length", "period"), run))


def find_runs(docs: DataFrame, rewrite: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs + ``n_words`` (long), ``runs`` (array of start, length, period, by start and period), ``strongest`` (the run of
    greatest length/period, or null) and ``collapsed`` (the words left after every run but its first period is dropped, joined by
    one space).  ``rewrite`` (id as text, words) -> words may change the words before runs are looked for."""

    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for key, text in zip(ids.to_pylist(), texts.to_pylist()):
            words = text.split()  # bytes: the six ASCII white-space characters
            if rewrite is not None:
                words = rewrite(key, words)
            runs = runs_of(words)
            rows.append({"n_words": len(words), "runs": [_named(r) for r in runs], "strongest": _named(strongest(runs)), "collapsed": b" ".join(collapse(words, runs)).decode("utf-8")})
        return pa.array(rows, _FOUND_ARROW)

    run.__annotations__ = {"ids": pa.Array, "texts": pa.Array, "return": pa.Array}
    made = _FOUND.fieldNames()
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    found = docs.select(*kept, F.arrow_udf(run, _FOUND)(F.col("doc_id").cast("string"), whole_text().cast("binary")).alias("__found"))
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != "__found"], *[F.col(f"__found.{c}").alias(c) for c in made])
