"""Runs against a search of all periods, and the query against plain Python."""

import hashlib
import random
import zlib

import brute
from pyspark.sql import functions as F

from roadlens.llm import periodic_runs, queries
from roadlens.llm.common import table

SF = "/root/testdata/sf0.001"


def all_runs(w):
    out, n = set(), len(w)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            x = w[s : i + p]
            if len(x) >= max(24, 3 * p) and i > s and not any(x[q:] == x[:-q] for q in range(1, p)):
                out.add((s, len(x), p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng, n):
    for _ in range(n):
        k, words = rng.choice([1, 2, 3, 5, 50]), []
        while len(words) < rng.randint(0, 150):
            unit = [rng.randint(0, k) for _ in range(rng.randint(1, 12))]
            words += (unit * rng.choice([1, 1, 2, 4, 9]))[: rng.randint(1, 80)]
        yield words


def test_runs_are_those_of_a_full_search():
    for words in texts(random.Random(5), 600):
        want = all_runs(words)
        assert periodic_runs.runs_of(words) == want
        if words:
            assert sorted(periodic_runs.maximal_runs(words), key=lambda r: (r[0], r[2])) == want


def test_range_minimum():
    rng = random.Random(3)
    for n in (1, 5, 16, 17, 200, 1000):
        a = periodic_runs.np.array([rng.randint(0, 50) for _ in range(n)], periodic_runs.np.int32)
        least = periodic_runs.RangeMinimum(a)
        lo = periodic_runs.np.array([rng.randrange(n) for _ in range(300)])
        hi = periodic_runs.np.array([rng.randrange(x, n) for x in lo.tolist()])
        assert least(lo, hi).tolist() == [a[x : y + 1].min() for x, y in zip(lo.tolist(), hi.tolist())]


def expected(doc_id, text):
    words = brute.words(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_matches_plain_python(spark):
    # the full search is quadratic: texts of up to 3,000 words here
    docs = [r for r in table(spark, SF, "documents").collect() if len(brute.words(r.text)) < 3000]
    assert len(docs) > 150
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    for r in docs:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
    assert sum(v[1] > 0 for v in got.values()) > 5


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b " * 20, "x"), (3, "á\tb " * 30 + "end", "x"), (3, "á\tb " * 30 + "end", "x"), (4, "one " * 24, "x"), (5, "one " * 23, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string").withColumn("source", F.lit("s"))
    out = periodic_runs.find_runs(docs)
    assert out.columns == ["doc_id", "text", "source", "n_words", "runs", "strongest", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in out.collect()]
    last = (3, 61, [(0, 60, 2)], (0, 60, 2), "á b end")
    assert got == [(1, 0, [], None, ""), (2, 0, [], None, ""), (None, 40, [(0, 40, 2)], (0, 40, 2), "a b"), last, last, (4, 24, [(0, 24, 1)], (0, 24, 1), "one"), (5, 23, [], None, " ".join(["one"] * 23))]
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
