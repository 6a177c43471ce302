"""Plain-Python counterparts of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for k in range(3)}
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered),
        "n_upper_words": sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in ws),
    }


def kept(text):
    m = measures(text)
    n = m["n_words"]
    bad = [n < 50, 100 * m["n_repeat_words"] > 50 * n, 10 * m["n_symbols"] > n, 100 * m["n_dup_lines"] > 40 * m["n_lines"], 2 * m["word_chars"] < 5 * n, m["word_chars"] > 15 * n, 100 * m["n_upper_words"] > 40 * n]
    return bad, not any(bad)


def bits(text, digits=8):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def chunks(text):
    """[(start, lines)] of a text."""
    lines = text.split("\n")
    h = [bits(x) for x in lines]
    r = [31 * a + b for a, b in zip(h, h[1:] + [0])]
    starts = [0] + [i for i in range(2, len(lines) - 1) if r[i] < r[i - 1] and r[i] <= r[i + 1]]
    return [lines[a:b] for a, b in zip(starts, starts[1:] + [len(lines)])]


def dedup_lines(docs):
    """{id: text} -> {id: text}, ids in ascending order: chunks and pairs of neighbouring lines that an earlier place has go."""
    seen, pairs, out = set(), set(), {}
    for i in sorted(docs):
        if docs[i] is None:
            out[i] = None
            continue
        lines, lost, at = docs[i].split("\n"), set(), 0
        for chunk in chunks(docs[i]):
            body = "\n".join(chunk)
            if len(chunk) > 1 and words(body):
                lost |= set(range(at, at + len(chunk))) if body in seen else set()
                seen.add(body)
            at += len(chunk)
        for k, pair in enumerate(zip(lines, lines[1:])):
            if words("\n".join(pair)):
                lost |= {k, k + 1} if pair in pairs else set()
                pairs.add(pair)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in lost)
    return out


def shingles(text, n=5):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1)))


def components(sets, percent=75):
    """{id: set} -> {id: least id reachable}."""
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """{source: size} -> {source: target}, by sharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    full = set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def shards(docs, n):
    """[(doc_id, text)] -> [(doc_id, size, shard, slot)] in order of (hash of the text, id)."""
    rows = sorted(((bits(t or "", 15), i if i is not None else math.inf, i, len((t or "").encode()) + 16) for i, t in docs), key=lambda r: r[:2])
    total, start, out, slots = sum(r[3] for r in rows), 0, [], Counter()
    for _, _, i, size in rows:
        s = start * n // total
        out.append((i, size, s, slots[s]))
        slots[s] += 1
        start += size
    return out
