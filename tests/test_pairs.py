"""Near-duplicate keys lose no pair, and long chains of links come out as one component."""

import random

from pyspark.sql import functions as F

from roadlens.operators import dedup as D
from roadlens.operators.components import connected_components
from roadlens.operators.dedup import simhash_near_dups


def test_simhash_pairs_match_brute_force(spark):
    rng = random.Random(3)
    hashes = []
    for _ in range(60):
        h = rng.getrandbits(64)
        hashes.append(h)
        for _ in range(rng.randint(0, 6)):
            g = h
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                g ^= 1 << bit
            hashes.append(g)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = {(r.a, r.b): r.distance for r in simhash_near_dups(spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long")).collect()}
    want = {(i, j): bin(hashes[i] ^ hashes[j]).count("1") for i in range(len(hashes)) for j in range(i + 1, len(hashes))}
    want = {p: d for p, d in want.items() if d <= 4}
    distinct = {p: d for p, d in want.items() if d and all(hashes.index(hashes[k]) == k for k in p)}
    assert {p: d for p, d in got.items() if d} == distinct
    assert all(want[p] == d for p, d in got.items())


def test_a_chain_of_1000_links_and_a_star(spark):
    rng = random.Random(5)
    ids = list(range(1001))
    chain = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(ids, ids[1:])]
    star = [(5000, 5000 + k) for k in range(1, 3000)]
    rng.shuffle(chain)
    vertices = spark.createDataFrame([(i,) for i in ids + [b for _, b in star] + [5000, 9999]], "id long")
    edges = spark.createDataFrame(chain + star + [(7, 7)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(vertices, edges).collect()}
    assert {got[i] for i in ids} == {0} and {got[b] for _, b in star} == {5000} and got[9999] == 9999


def test_components_match_brute_force_and_keep_isolated_ids(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)]
    parent = {i: i for i in range(301)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = connected_components(spark.range(301), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: r.component for r in got} == {i: root(i) for i in range(301)}
    assert connected_components(spark.range(3), spark.createDataFrame([], "src long, dst long")).count() == 3


def _plans(spark, run, monkeypatch, kept):
    """Tables that ``run`` writes and what it returns, with every static size estimate far below the broadcast limit."""
    seen = []
    monkeypatch.setattr(D, "materialize", lambda df, f=D.materialize: seen.append(df) or f(df))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        seen.append(run())
        return [df._jdf.queryExecution().executedPlan().toString() for df in seen if kept in df._jdf.queryExecution().optimizedPlan().toString()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_simhash_keys_are_never_broadcast(spark, monkeypatch):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("simhash"))
    plans = _plans(spark, lambda: D.simhash_near_dups(docs), monkeypatch, "Generate explode(array(")
    assert plans and all("SortMergeJoin" in p for p in plans)


def test_minhash_keys_are_never_broadcast(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.split(F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")), " ").alias("tokens"))
    plans = _plans(spark, lambda: D.minhash_near_dups(docs), monkeypatch, "Generate explode(keys")
    assert plans and all("SortMergeJoin" in p for p in plans)


def test_minhash_pairs_match_brute_force_in_many_blocks(spark, monkeypatch):
    """Near-equal sets of several blocks, copies, a null id, an id with two sets and sets below the threshold."""
    monkeypatch.setattr(D, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    sets = {i: sorted(set(base) - set(rng.sample(base, rng.randrange(0, 8))) | {f"x{rng.randrange(40)}" for _ in range(rng.randrange(0, 6))}) for i in range(70)}
    sets |= {100 + i: [f"u{(i * 7 + j) % 50}" for j in range(20)] for i in range(20)}
    rows = [(i, s) for i, s in sets.items()] + [(200, sets[3]), (201, sets[100]), (None, sets[5]), (300, base), (300, base[:59]), (4, sets[4])]
    got = sorted((r.a, r.b, round(r.jaccard, 9)) for r in D.minhash_near_dups(spark.createDataFrame(rows, "doc_id long, tokens array<string>")).collect())
    first = {}
    for i, s in rows:
        if i is not None:
            first[frozenset(s)] = min(i, first.get(frozenset(s), i))
    want = [(first[frozenset(s)], i, 1.0) for i, s in rows if i is not None and i != first[frozenset(s)]]
    for s, a in first.items():
        for t, b in first.items():
            if a < b and len(s & t) / len(s | t) >= 0.8:
                want.append((a, b, round(len(s & t) / len(s | t), 9)))
    assert got == sorted(want)


def test_minhash_moves_a_set_once_a_cell(spark, monkeypatch):
    """300 near-equal sets make 44,850 pairs; their tokens are moved once per pair of blocks."""
    monkeypatch.setattr(D, "BLOCK", 150)
    real = D._cell_pairs
    counted = spark.sparkContext.accumulator(0)

    def counting(threshold):
        inner = real(threshold)
        return lambda pairs, sets: (counted.add(sets.num_rows), inner(pairs, sets))[1]

    monkeypatch.setattr(D, "_cell_pairs", counting)
    rows = [(i, [f"w{j}" for j in range(100) if j != i % 100] + [f"x{i}"]) for i in range(300)]
    got = D.minhash_near_dups(spark.createDataFrame(rows, "doc_id long, tokens array<string>")).count()
    assert got == 300 * 299 // 2 and counted.value <= 300 * 8


def test_tokens_of_sets_without_a_candidate_are_not_moved(spark, monkeypatch):
    d = spark.range(20_000).withColumnRenamed("id", "u")
    wanted = spark.range(0, 20_000, 100).withColumnRenamed("id", "u")
    left = D._marked(d, wanted, "u")
    assert left.join(wanted, "u").count() == 200 and left.count() < 260
    assert D._marked(d, wanted.limit(0), "u").count() == 0
    kept = []
    monkeypatch.setattr(D, "_marked", lambda *a, keep=D._marked: kept.append(keep(*a)) or kept[-1])
    rows = [(i, [f"w{i}x{j}" for j in range(12)]) for i in range(300)] + [(300 + i, [f"v{j}" for j in range(12)] + [f"x{i}"]) for i in range(4)]
    got = sorted((r.a, r.b) for r in D.minhash_near_dups(spark.createDataFrame(rows, "doc_id long, tokens array<string>")).collect())
    assert got == [(300 + i, 300 + j) for i in range(4) for j in range(i + 1, 4)]
    assert kept[0].count() < 10


def test_sets_with_odd_tokens_and_an_id_of_two_sets(spark):
    odd = ['"', "\\", "a\nb", "é", "\U0001f600", "", " ", "[1]", "\t", "null"]
    rows = [(1, odd + ["p"]), (2, odd + ["q"]), (2, ["only", "two"]), (3, ["only", "two"]), (4, odd + ["p"])]
    got = sorted((r.a, r.b, round(r.jaccard, 6)) for r in D.minhash_near_dups(spark.createDataFrame(rows, "doc_id long, tokens array<string>")).collect())
    assert got == [(1, 2, round(10 / 12, 6)), (1, 4, 1.0), (2, 3, 1.0)]
