"""LSH forest against all pairs in plain Python; regions, ascent and odd rows."""

from random import Random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import lsh_forest

SCHEMA = "doc_id long, text string"


def copies(rng, base, n, change):
    """Texts that differ from the base in some words each."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(change):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 10**9)}"
        out.append(" ".join(words))
    return out


def corpus(rng):
    texts = []
    for g in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([30, 90, 200]))]
        texts += copies(rng, base, rng.randint(1, 9), rng.choice([1, 2, 3, 5]))
    texts += [texts[0], texts[0].upper(), "two words", "two  words", "two\twords", "one", "", " \n", None]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def expected(docs, width=3, percent=85):
    sets = {i: brute.shingles(t, width) for i, t in docs}
    comp = brute.components(sets, percent)
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i, _ in docs)


@pytest.mark.parametrize("seed,region", [(1, 512), (2, 512), (3, 4)])
def test_groups_match_all_pairs(spark, monkeypatch, seed, region):
    monkeypatch.setattr(lsh_forest, "REGION", region)  # small: regions go deeper, and equal labels are cut
    docs = corpus(Random(seed))
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, SCHEMA))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == expected(docs)


def test_ascent_finds_what_neighbours_miss(spark, monkeypatch):
    rng = Random(9)
    base = [f"w{k}" for k in range(120)]
    docs = list(enumerate(copies(rng, base, 60, 3)))
    monkeypatch.setattr(lsh_forest, "TILE_CLASSES", 16)
    df = spark.createDataFrame(docs, SCHEMA)
    want = expected(docs)
    assert sorted(tuple(r) for r in lsh_forest.near_duplicates(df).collect()) == want
    signed = lsh_forest.signatures(df)
    places = lsh_forest.regions(signed.select("cid", "sig"))
    near = lsh_forest.neighbours(places)
    assert 0 < near.count() < 60  # one neighbour a class at most


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    hit = []
    for _ in range(200):
        both, x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (340, 30, 30))
        a, b = np.concatenate([both, x]), np.concatenate([both, y])
        hit.append((lsh_forest.minhash(np.sort(a)) == lsh_forest.minhash(np.sort(b))).mean())
    assert abs(np.mean(hit) - 0.85) < 0.01 and np.std(hit) < 0.04


def test_odd_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, "only here now then"), (7, "x" * 100_000), (7, "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")).withColumn("size", F.lit(1))
    got = sorted((tuple(r) for r in lsh_forest.near_duplicates(df).collect()), key=str)
    want = [(1, 48, 1, True), (5, 48, 1, False), (5, 48, 5, True), (None, 48, 1, False), (None, 2, None, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert got == sorted(want, key=str)
    assert lsh_forest.near_duplicates(df.limit(0)).collect() == []
